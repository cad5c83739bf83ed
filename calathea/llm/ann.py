"""Nearest neighbours by inner product with a hierarchical k-means tree and best-bin-first search.

Index. The tree is fitted on at most SAMPLE distinct vectors, lifted by one coordinate so that the largest inner
product is the smallest distance; every row is indexed: each distinct vector descends to a leaf, and keeps the ids of
its rows. Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest, ties going to the smaller id,
so no more are carried; that loses nothing. Consecutive leaves make blocks of about BLOCK vectors, a larger leaf several;
a block that more than QUERIES queries visit is worked off in as many parts, each with the block's vectors.
Search. Each distinct query walks the tree with a priority queue, nearest node first, up to a number of leaves. The
number is calibrated: for a sample of queries the true neighbours are found by a scan of everything, and leaf visits
widen until their recall reaches RECALL. Blocks then score their queries against the leaves these visit; scores are
recomputed in double precision on the original vectors, in one order of summation, so equal vectors score equal.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part; with fewer than k candidates all are returned; equal ids are rows of their own; a null id takes no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import column, cut

SAMPLE, CALIBRATION, RECALL = 20_000, 256, 0.96
BRANCH, LEAF, BLOCK, QUERIES = 12, 32, 4_096, 4_096


@dataclass
class Tree:
    """Nodes in arrays; children of node i are child[first[i]:first[i] + count[i]], none for a leaf."""

    centre: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray
    lift: float

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def raised(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(0, self.lift**2 - (x * x).sum(axis=1))
        return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest child at each node."""
        x, at, out = self.raised(x), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.count[node]:
                out[rows] = self.leaf[node]
                continue
            kids = np.arange(self.first[node], self.first[node] + self.count[node])
            near = (x[rows] @ self.centre[kids].T * -2 + (self.centre[kids] ** 2).sum(axis=1)).argmin(axis=1)
            todo += [(int(kids[k]), rows[near == k]) for k in np.unique(near)]
        return out

    def visit(self, q: np.ndarray, limit: int) -> list[int]:
        """Leaves for a query, best bin first."""
        q, queue, out = np.append(q, 0.0), [(0.0, 0)], []
        while queue and len(out) < limit:
            _, node = heapq.heappop(queue)
            if not self.count[node]:
                out.append(int(self.leaf[node]))
                continue
            a, b = self.first[node], self.first[node] + self.count[node]
            gap = ((self.centre[a:b] - q) ** 2).sum(axis=1)
            for k, d in enumerate(gap.tolist()):
                heapq.heappush(queue, (d, int(a) + k))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ centre.T * -2 + (centre**2).sum(axis=1)).argmin(axis=1)
        for c in range(k):
            if (own == c).any():
                centre[c] = x[own == c].mean(axis=0)
    return (x @ centre.T * -2 + (centre**2).sum(axis=1)).argmin(axis=1)


def build(sample: np.ndarray, lift: float, branch: int = BRANCH, leaf: int = LEAF, seed: int = 1) -> Tree:
    """Hierarchical k-means of the sample; nodes of up to `leaf` vectors, or of equal ones, are leaves."""
    rng = np.random.default_rng(seed)
    rest = np.sqrt(np.maximum(0, lift**2 - (sample**2).sum(axis=1)))
    x = np.concatenate([sample, rest[:, None]], axis=1)
    centre, first, count, number, leaves = [x.mean(axis=0)], [0], [0], [-1], 0
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop(0)
        parts = []
        if len(rows) > leaf:
            own = _kmeans(x[rows], min(branch, len(rows)), rng)
            parts = [rows[own == c] for c in np.unique(own)]
        if len(parts) < 2:
            continue
        first[node], count[node] = len(centre), len(parts)
        for p in parts:
            todo.append((len(centre), p))
            centre.append(x[p].mean(axis=0))
            first.append(0)
            count.append(0)
            number.append(-1)
    stack = [0]  # numbers in depth-first order: near leaves get near numbers
    while stack:
        node = stack.pop()
        if count[node]:
            stack += range(first[node] + count[node] - 1, first[node] - 1, -1)
        else:
            number[node], leaves = leaves, leaves + 1
    return Tree(np.array(centre), np.array(first), np.array(count), np.array(number), lift)


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def _leaves(tree: Tree) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.assign(_matrix(batch.column(1)))
                yield pa.record_batch([batch.column(0), pa.array(leaf), batch.column(1)], names=["cid", "leaf", "vec"])

    return run


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest and of all that are as large but for rounding."""
    if len(score) <= k:
        return np.arange(len(score))
    floor = np.partition(score, len(score) - k)[len(score) - k]
    return np.flatnonzero(score >= floor - 1e-9 * max(1.0, abs(floor)))


_FOUND = "q long, cid long, leaf long, score double"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    c = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.zeros(0)] * 4
    return pa.record_batch([pa.array(x.astype(t)) for x, t in zip(c, (np.int64, np.int64, np.int64, np.float64), strict=True)], names=["q", "cid", "leaf", "score"])


def _scan(queries: np.ndarray, names: np.ndarray, k: int) -> Callable:
    """The k best of each partition for a bounded set of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, leaf, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            rows = []
            for s in range(0, len(v), 65536):
                score = queries @ v[s : s + 65536].T
                for i in range(len(queries)):
                    at = _best(score[i], k)
                    rows.append((np.full(len(at), names[i]), cid[s + at], leaf[s + at], score[i][at]))
            yield _found(rows)

    return run


def _walks(tree: Tree, limit: int, block_of: dict[int, list[int]]) -> Callable:
    """Queries dealt to the blocks that hold the leaves they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, blocks, rows, leaves = _matrix(batch.column(1)), [], [], []
            for i in range(len(x)):
                to: dict[int, list[int]] = {}
                for leaf in tree.visit(x[i], limit):
                    for b in block_of.get(leaf, ()):
                        to.setdefault(b, []).append(leaf)
                blocks += to
                leaves += to.values()
                rows += [i] * len(to)
            at = pa.array(rows, pa.int64())
            yield pa.record_batch([pa.array(blocks, pa.int64()), batch.column(0).take(at), pa.nulls(len(rows), pa.int64()), batch.column(1).take(at), pa.array(leaves, pa.list_(pa.int64()))], names=["block", "cid", "leaf", "vec", "leaves"])

    return run


def _score(k: int) -> Callable:
    """A block: its queries against the vectors of the leaves that each visits."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        leaf = table.column("leaf")
        index = table.filter(leaf.is_valid())
        asked = table.filter(leaf.is_null())
        if not index.num_rows or not asked.num_rows:
            return pa.Table.from_batches([_found([])])
        v, q = (_matrix(t.column("vec").combine_chunks()) for t in (index, asked))
        cid, leaf, names = index.column("cid").to_numpy(), index.column("leaf").to_numpy(), asked.column("cid").to_numpy()
        order = np.argsort(leaf, kind="stable")
        v, cid, leaf = v[order], cid[order], leaf[order]
        visits = asked.column("leaves").to_pylist()
        by_leaf: dict[int, list[int]] = {}
        for i, own in enumerate(visits):
            for x in own:
                by_leaf.setdefault(x, []).append(i)
        kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in visits]
        for x, who in by_leaf.items():
            a, b = np.searchsorted(leaf, [x, x + 1])
            if a < b:
                score = q[who] @ v[a:b].T
                for row, i in enumerate(who):
                    at = _best(score[row], k)
                    kept[i].append((a + at, score[row][at]))
        rows = []
        for i, parts in enumerate(kept):
            if parts:
                at, score = (np.concatenate(x) for x in zip(*parts, strict=True))
                at = at[_best(score, k)]
                exact = (v[at] * q[i]).sum(axis=1)
                rows.append((np.full(len(at), names[i]), cid[at], leaf[at], exact))
        return pa.Table.from_batches([_found(rows)])

    return run


def _some(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows by keyed hash, or all if fewer. A bound on the hash keeps all but about twice as many from being sorted."""
    share = min(1.0, (2 * n + 100) / max(1, rows.count()))
    drawn = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))
    return rows.where(drawn < share).orderBy(drawn, key).limit(n)


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row whose id is divisible by `every`, among all other rows."""
    rows = vectors.select(column(vectors, id_col).cast("long").alias("id"), column(vectors, vec_col).cast("array<double>").alias("vec"))
    sound = "id is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vec, x -> x <> 0)"
    # -0.0 and 0.0 are equal components
    rows = cut(rows.where(sound).withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))), "vectors")
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    rows = rows.where(F.size("vec") == common.n)

    first = rows.withColumn("nth", F.row_number().over(W.partitionBy("vec").orderBy("id"))).where(f"nth <= {k + 1}")
    classes = first.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("cid"), "vec", "ids")
    # equal ids with unlike vectors would share a class id: number such classes on by their vectors
    classes = cut(classes.withColumn("cid", F.xxhash64("vec")), "classes")
    lift = classes.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0] ** 0.5
    picked = _matrix(_some(classes, "cid", 1, SAMPLE).select("vec").toArrow().column("vec").combine_chunks())
    tree = build(picked, lift)
    index = cut(classes.select("cid", "vec").mapInArrow(_leaves(tree), "cid long, leaf long, vec array<double>"), "index")

    asked = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.xxhash64("vec").alias("q"), "vec")
    distinct = cut(asked.groupBy("q").agg(F.first("vec").alias("vec")), "queries")
    trial = _some(distinct, "q", 2, CALIBRATION).toArrow()
    if not trial.num_rows:
        return empty
    names, points = trial.column("q").to_numpy(), _matrix(trial.column("vec").combine_chunks())
    truth = index.mapInArrow(_scan(points, names, k), _FOUND)
    truth = truth.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "cid"))).where(f"nth <= {k}").toArrow()
    limit = calibrated(tree, names, points, truth.column("q").to_numpy(), truth.column("leaf").to_numpy(), RECALL)

    sizes = dict(index.groupBy("leaf").count().collect())  # a row for each leaf, and the sample bounds those
    block_of, block, held = {}, 0, 0
    for leaf in range(tree.leaves):
        n = sizes.get(leaf, 0)
        if held and held + n > BLOCK:
            block, held = block + 1, 0
        parts = max(1, -(-n // BLOCK))
        block_of[leaf] = list(range(block, block + parts))
        block, held = block + parts - 1, held + n
        if parts > 1:
            block, held = block + 1, 0
    table = rows.sparkSession.createDataFrame([(leaf, b[0], len(b)) for leaf, b in block_of.items()], "leaf long, start long, parts int")
    placed = index.join(F.broadcast(table), "leaf").select((F.col("start") + F.pmod("cid", "parts")).alias("block"), "cid", "leaf", "vec", F.lit(None).cast("array<long>").alias("leaves"))
    walks = cut(distinct.select("q", "vec").mapInArrow(_walks(tree, limit, block_of), "block long, cid long, leaf long, vec array<double>, leaves array<long>"), "walks")
    shares = walks.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).alias("shares"))
    placed = placed.join(shares, "block").withColumn("share", F.explode(F.sequence(F.lit(0), (F.col("shares") - 1).cast("int"))))
    walks = walks.join(shares, "block").withColumn("share", F.pmod("cid", "shares").cast("int"))
    both = placed.select(walks.columns).unionByName(walks)
    found = both.groupBy("block", "share").applyInArrow(_score(k + 1), _FOUND)

    nearest = W.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    best = found.select("q", "cid", "score").join(classes.select("cid", "ids"), "cid")
    best = best.withColumn("nth", F.row_number().over(nearest)).where(f"nth <= {k + 1}")
    spread = best.select("q", "score", "cid", F.explode("ids").alias("vec_id"))
    top = spread.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(f"nth <= {k + 1}")
    lists = cut(top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score", "cid"))).alias("list")), "lists")
    own = asked.select("query_id", "q").join(lists, "q")
    # the query's own row goes once: that of its id among those of its vector
    at = F.array_position(F.transform("list", lambda x: (x["vec_id"] == F.col("query_id")) & (x["cid"] == F.col("q"))), True)
    others = F.slice(F.filter("list", lambda x, i: (i + 1) != at), 1, k)
    return own.select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def calibrated(tree: Tree, names: np.ndarray, points: np.ndarray, q: np.ndarray, leaf: np.ndarray, recall: float) -> int:
    """The least number of leaf visits that finds this share of the true neighbours."""
    limit = 4
    while True:
        limit = min(limit, tree.leaves)
        rank = np.full(len(q), tree.leaves)
        for name, x in zip(names.tolist(), points, strict=True):
            order = {v: n for n, v in enumerate(tree.visit(x, limit))}
            mine = np.flatnonzero(q == name)
            rank[mine] = [order.get(v, tree.leaves) for v in leaf[mine].tolist()]
        need = int(np.ceil(recall * len(q))) - 1
        found = int(np.sort(rank)[need]) + 1 if len(q) else 1
        if found <= limit or limit == tree.leaves:
            return min(found, tree.leaves)
        limit *= 2
