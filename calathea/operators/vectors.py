"""Vectors: exact search, neighbour edges, components, centroids, assignment.

Searches scan the table once for each block of queries: the queries travel to the data, about MAX_QUERIES at a time, and
each partition keeps its best. Scores are summed in double precision in one order.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ranges
from .durable import written

MAX_QUERIES = 4_096
_HITS = "query long, id long, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _scan(keys: np.ndarray, vectors: np.ndarray, k: int | None, least: float | None, own: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column(0).to_numpy(), _matrix(batch.column(1))
            out = []
            for s in range(0, len(v), 4096):
                rough = vectors @ v[s : s + 4096].T
                for i in range(len(keys)):
                    score = rough[i]
                    at = np.flatnonzero(score >= least - 1e-9) if least is not None else np.arange(len(score))
                    if k is not None and len(at) > k:
                        floor = np.partition(score[at], len(at) - k)[len(at) - k]
                        at = at[score[at] >= floor - 1e-9]
                    if not own:
                        at = at[ids[s + at] != keys[i]]
                    exact = (v[s + at] * vectors[i]).sum(axis=1)
                    out.append((np.full(len(at), keys[i]), ids[s + at], exact))
            q, i, x = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.record_batch({"query": pa.array(q), "id": pa.array(i), "score": pa.array(x)})

    return run


def search(vectors: DataFrame, key: str, vec: str, queries: DataFrame, k: int, least: float | None = None, own: bool = False) -> DataFrame:
    """(query, id, score, rank): the k most similar of each query vector, ties to the smaller id.

    `queries` (key, vector) go through the table in blocks of about MAX_QUERIES, a scan for each; the vectors of a block
    travel to every task. Without `own` the query's id is left out.
    """
    n = queries.count()
    parts = max(1, -(-n // MAX_QUERIES))
    found = []
    for part in range(parts):
        asked = queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part).toArrow()
        if asked.num_rows:
            run = _scan(asked.column(0).to_numpy().astype(np.int64), _matrix(asked.column(1).combine_chunks()), k + (not own), least, own)
            hits = vectors.select(F.col(key).cast("long"), F.col(vec)).mapInArrow(run, _HITS)
            ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
            found.append(ranked if parts == 1 else written(ranked, "hits"))
    if not found:
        return vectors.sparkSession.createDataFrame([], _HITS + ", rank int")
    return functools.reduce(DataFrame.unionByName, found)


def _best(a: np.ndarray, b: np.ndarray, same: tuple[np.ndarray, np.ndarray] | None, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of each row's k largest products of at least `least`, with all that may be as large but for rounding.
    The products are single where their error is bounded, and no pair is lost to it. `same`: ids; equal ones are no pair."""
    far = [float(np.sqrt((x * x).sum(axis=1).max())) for x in (a, b)]
    single = all(x < 1e15 for x in far)  # false for what is not finite
    room = (a.shape[1] + 4) * 2.0**-24 * far[0] * far[1] + 1e-37 if single else 1e-9
    left, right = (x.astype(np.float32) if single else x for x in (a, b))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    # a slice of the product at a time
    for s in range(0, len(a), 256):
        rough = left[s : s + 256] @ right.T
        if not single:
            rough[np.isnan(rough)] = -np.inf
        if same is not None:
            rough[same[0][s : s + 256, None] == same[1]] = -np.inf
        floor = np.full(len(rough), least)
        if len(b) > k:
            floor = np.maximum(floor, np.partition(rough, len(b) - k, axis=1)[:, len(b) - k])
        at, of = np.divmod(np.flatnonzero(rough >= (floor - 3 * room).astype(rough.dtype)[:, None]), len(b))
        out.append((at + s, of))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _pairs(k: int, least: float) -> Callable:
    """Of two blocks, or of one with itself (then all of side 0): each row's best rows of the other."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, v = table.column("id").to_numpy(), _matrix(table.column("vec").combine_chunks())
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        own = len(side) > 0 and table.column("i")[0] == table.column("j")[0]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for x, y in [(a, a)] if own else [(a, b), (b, a)]:
            if len(x) and len(y):
                at, of = _best(v[x], v[y], (ids[x], ids[y]) if own else None, k, least)
                for s in range(0, len(at), 16_384):
                    p, q = x[at[s : s + 16_384]], y[of[s : s + 16_384]]
                    out.append((ids[p], ids[q], (v[p] * v[q]).sum(axis=1)))
        q, i, x = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query": pa.array(q), "id": pa.array(i), "score": pa.array(x)})

    return run


def neighbour_edges(vectors: DataFrame, key: str, vec: str, k: int = 15, least: float = 0.65, block: int = 4_096) -> DataFrame:
    """(query, id, score, rank): each row's k nearest at `least` or above, among all rows; exact.

    Rows are cut into blocks by hash; each two blocks are a task that multiplies two bounded matrices and keeps k a row
    of either. Beyond 16 blocks, they grow up to four times as large before there are more of them, as a row is sent
    once for each block. The work is that of all pairs, as exact neighbours of every row need; an approximate index is
    in `neighbours`.
    """
    total = vectors.count()
    n = max(1, min(16, -(-total // block)), -(-total // (4 * block)))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("vec"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("own"))
    # the block of the smaller number is side 0
    sent = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    sent = sent.select("id", "vec", (F.col("own") > F.col("other")).cast("int").alias("side"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    found = sent.groupBy("i", "j").applyInArrow(_pairs(k, least), _HITS)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).where((F.col("rank") <= k) & (F.col("score") >= least))


def components(edges: DataFrame, a: str, b: str, rounds: int = 50) -> DataFrame:
    """(node, component): smallest label over the edges' components; labels spread and jump until none changes.

    Each round is written to the shared folder.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct()
    cut = written
    both = cut(both)
    labels = cut(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        spread = labels.join(near, "x").select("x", "label", F.least("label", "near").alias("low"))
        jump = spread.select(F.col("x").alias("low"), F.col("low").alias("next"))
        after = cut(spread.join(jump, "low").select("x", F.col("label").alias("was"), F.least("low", "next").alias("label")))
        labels = after.select("x", "label")
        if after.where("was <> label").isEmpty():
            return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))
    raise RuntimeError("components did not converge")


def centroids(vectors: DataFrame, group: str, vec: str, unit: bool = True) -> DataFrame:
    """(group, n, centroid): mean of the (unit) vectors of each group, at length one."""
    own = S.l2_normalise(F.col(vec)) if unit else F.transform(F.col(vec), lambda x: x.cast("double"))
    flat = vectors.select(group, F.posexplode(own).alias("at", "x"))
    mean = flat.groupBy(group, "at").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    rows = mean.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("c"))
    return rows.select(group, "n", S.l2_normalise(F.col("c")).alias("centroid"))


def assign(vectors: DataFrame, key: str, vec: str, centres: DataFrame, group: str, limit: int = 1_000) -> DataFrame:
    """(key, group, score): the best centre of each vector, ties to the smaller group; exact. Centres go to the vectors
    `limit` at a time, a scan for each; for very many, ``neighbours.search`` finds all but a few by an index."""

    def of(few: list) -> DataFrame:
        table = F.array(*(F.struct(F.lit(r[group]).alias("g"), F.array(*map(F.lit, r["centroid"])).alias("c")) for r in few))
        scored = F.transform(table, lambda t: F.struct(F.negative(S.dot(F.col(vec), t["c"])).alias("s"), t["g"].alias("g")))
        # the least of the negated scores, and of equal ones the smallest group
        best = F.array_min(F.filter(scored, lambda x: x["s"].isNotNull()))
        return vectors.select(key, best.alias("b")).select(key, F.col("b.g").alias(group), F.negative("b.s").alias("score"))

    few = centres.select(group, "centroid").orderBy(group).limit(limit + 1).collect()
    if len(few) <= limit:
        return of(few)
    table = written(ranges.running(centres.select(group, "centroid"), [], [group], "__at", "__of"), "centres")
    blocks = -(-table.count() // limit)
    found = [written(of(table.where((F.col("__at") > b * limit) & (F.col("__at") <= (b + 1) * limit)).collect()), "assigned") for b in range(blocks)]
    least = F.min(F.struct(F.negative("score").alias("s"), F.col(group).alias("g"))).alias("b")
    best = functools.reduce(DataFrame.unionByName, found).where("score is not null").groupBy(key).agg(least)
    return vectors.select(key).join(best, key, "left").select(key, F.col("b.g").alias(group), F.negative("b.s").alias("score"))


def _best_of(keys: np.ndarray, groups: list, vectors: np.ndarray) -> Callable:
    names, number = np.unique(np.array(groups, dtype=object).astype(str), return_inverse=True)
    first = [groups[int(np.flatnonzero(number == k)[0])] for k in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v, out = _matrix(batch.column(1)), np.full((len(names), batch.num_rows), -np.inf)
                for i, g in enumerate(number.tolist()):
                    np.maximum(out[g], (v * vectors[i]).sum(axis=1), out=out[g])
                for k, g in enumerate(first):
                    yield pa.record_batch({"grp": pa.array([str(g)] * batch.num_rows), "id": batch.column(0), "score": pa.array(out[k])})

    return run


def best_anchor(vectors: DataFrame, key: str, vec: str, anchors: DataFrame, anchor_key: str, group: str, k: int, excluded: DataFrame | None = None) -> DataFrame:
    """(group, key, score, rank): the k rows nearest to each group, by their best similarity to any of its anchors,
    excluded rows left out. Anchors go to the rows MAX_QUERIES at a time, a scan for each. A row is reduced to its best
    score of each group where it is scanned, and a group's best rows to k before they are shuffled."""
    kind = dict(anchors.dtypes)[group]
    rows = vectors if excluded is None else vectors.join(excluded, key, "left_anti")
    table = written(anchors.select(F.col(anchor_key).cast("long").alias("k"), F.col(vec).alias("v"), F.col(group).alias("g")), "anchors")
    blocks = max(1, -(-table.count() // MAX_QUERIES))
    ranked = W.partitionBy(group).orderBy(F.desc("score"), key)
    found = []
    for b in range(blocks):
        # of blocks by hash, some are a little larger
        asked = table.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).toArrow()
        if asked.num_rows:
            run = _best_of(asked.column(0).to_numpy(), asked.column(2).to_pylist(), _matrix(asked.column(1).combine_chunks()))
            best = rows.select(F.col(key).cast("long"), F.col(vec)).mapInArrow(run, "grp string, id long, score double")
            best = best.select(F.col("grp").cast(kind).alias(group), F.col("id").alias(key), "score")
            best = best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            found.append(best if blocks == 1 else written(best, "anchored"))
    if not found:
        return rows.sparkSession.createDataFrame([], f"{group} {kind}, {key} long, score double, rank int")
    if len(found) == 1:
        return found[0]
    # a row that is among a group's k best is so in the block that its best anchor is in
    best = functools.reduce(DataFrame.unionByName, found).groupBy(group, key).agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def cluster_table(members: DataFrame, cluster: str, key: str, vec: str, asset: str, ts: str, least: int = 2, shown: int = 4) -> tuple[DataFrame, DataFrame]:
    """Clusters of at least `least` members: (cluster, size, assets, days, first, last, centroid, shown: the members
    nearest to the centroid), and (key, cluster, cos) of their members. Days are of UTC; unknown times count for none."""
    big = members.groupBy(cluster).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")
    rows = members.join(big, cluster)
    centre = centroids(rows, cluster, vec, unit=False).select(cluster, "centroid")
    near = rows.join(centre, cluster).select(key, cluster, S.dot(F.col(vec), F.col("centroid")).alias("cos"))
    best = near.withColumn("__r", F.row_number().over(W.partitionBy(cluster).orderBy(F.desc("cos"), key))).where(F.col("__r") <= shown)
    best = best.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(key).alias("k")))), lambda x: x["k"]).alias("shown"))
    day = F.to_date(F.timestamp_seconds(F.floor(F.col(ts) / 86_400) * 86_400))
    facts = rows.groupBy(cluster).agg(F.count("*").alias("size"), F.count_distinct(asset).alias("assets"), F.count_distinct(F.floor(F.col(ts) / 86_400)).alias("days"), F.min(day).alias("first"), F.max(day).alias("last"))
    return facts.join(centre, cluster).join(best, cluster), near


def nearest_person(members: DataFrame, cluster: str, key: str, vec: str, cos: str, persons: DataFrame, person: str, sample: int = 60, sure: float = 0.45) -> DataFrame:
    """(cluster, person, score, confident): the person whose centroid is nearest to the mean of the members nearest to
    each cluster's own; the score goes with it, as the nearest person is often no match."""
    first = members.withColumn("__r", F.row_number().over(W.partitionBy(cluster).orderBy(F.desc(cos), key))).where(F.col("__r") <= sample)
    means = centroids(first, cluster, vec, unit=False).select(cluster, "centroid")
    found = assign(means, cluster, "centroid", persons, person)
    return found.select(cluster, person, "score", (F.col("score") >= sure).alias("confident"))


def uncertain(score: Column, low: float = 0.5, high: float = 0.6) -> Column:
    """Whether a similarity is in the band that is neither a match nor none."""
    return (score >= low) & (score < high)
