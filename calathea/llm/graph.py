"""Connected components of an edge table, by distributed label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component), by vectorised minimum hooking."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[i], root[j]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if not (low < high).any():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition thinned to a star for each local component."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 1_000_000:
            b, a = union_find(a, b)
            a, b = a[a != b], b[a != b]
    if len(a):
        b, a = union_find(a, b)
        keep = a != b
        yield pa.record_batch({"a": pa.array(a[keep]), "b": pa.array(b[keep])})


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, label) for each node with an edge; edges: long columns a, b; label: the smallest node of the component.

    Each round thins the edges of a partition to local stars, then moves every node's edges to its smallest
    neighbour (large-star, small-star). Rounds end when the edges are stars already; each writes its edges to the
    shared folder. No vertex's neighbourhood is ever gathered in one task: only minima are, with partial sums.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    edges = cut(edges.mapInArrow(_forest, "a long, b long").distinct(), "cc")
    for _ in range(limit):
        # b's smallest neighbour; every other neighbour of b hangs on it as well
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("b").agg(F.min("a").alias("low")).select("b", F.least("low", "b").alias("low"))
        moved = both.join(low, "b").select(F.least("a", "low").alias("a"), F.greatest("a", "low").alias("b"))
        own = low.where("low <> b").select(F.col("low").alias("a"), "b")
        after = cut(moved.where("a <> b").unionByName(own).mapInArrow(_forest, "a long, b long").distinct(), "cc")
        tops = after.select(F.col("a").alias("b")).distinct().join(after.select("b").distinct(), "b", "left_semi")
        twice = after.groupBy("b").count().where("count > 1")
        edges = after
        if tops.isEmpty() and twice.isEmpty():
            break
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    )
