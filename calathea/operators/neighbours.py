"""Approximate neighbour edges without all pairs: tables of random hyperplanes, probed and verified.

Each table is a tree of random hyperplanes, each through the median of the sampled rows that reach it, so that crowded
regions are cut further until a bucket holds about `bucket` rows. A row lies in one bucket a table and asks those to
which the least sum of squared margins leads. The number of tables and of probes is calibrated: for a sample of rows the
true edges are found by a scan of everything, and the cheapest pair of numbers that finds the asked share of them is
taken. Candidates are then scored in double precision, in one order of summation.

What moves grows with the rows: each goes to tables x probes buckets, MOST at most. Where vectors have little structure, as
for any index, more probes are needed; then buckets are made larger, until so few of them do: what moves stays as it is, and
the work comes near that of all pairs. The sample is bounded; a bucket of more than HELD rows is worked off in parts,
each against each, so nothing is lost there. Rows of equal vectors are one row with its smallest ids.
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

from .durable import written

SAMPLE, CALIBRATION, TABLES, LEAST = 20_000, 256, 8, 8
#: Rows that a task of `_dealt` works on at a time, and copies of rows that it makes before it sends them off.
ROWS, COPIES = 512, 8_192
#: Buckets that a row is sent to, rows of a bucket that a task holds, tasks at least for large tables, and rows that are scored at a time.
MOST, HELD, TASKS, PIECE = 8, 131_072, 32, 1_024


@dataclass
class Planes:
    """One table: node i parts rows at offset[i] along normal[i]; children below and above, ~bucket for buckets."""

    normal: np.ndarray
    offset: np.ndarray
    below: list[int]
    above: list[int]

    @property
    def buckets(self) -> int:
        return len(self.offset) + 1

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.normal.T - self.offset if len(self.offset) else np.zeros((len(x), 0))

    def own(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each row."""
        margin, out = self.margins(x), np.zeros(len(x), np.int64)
        todo = [(0 if len(self.offset) else -1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
                continue
            up = margin[rows, node] > 0
            todo += [(self.below[node], rows[~up]), (self.above[node], rows[up])]
        return out

    def probes(self, margin: np.ndarray, most: int) -> list[int]:
        """Buckets for a row, by the sum of the squared margins of planes it is on the other side of."""
        queue, out, nth = [(0.0, 0, 0 if len(self.offset) else -1)], [], 0
        while queue and len(out) < most:
            cost, _, node = heapq.heappop(queue)
            if node < 0:
                out.append(~node)
                continue
            m = float(margin[node])
            near, far = (self.above, self.below) if m > 0 else (self.below, self.above)
            heapq.heappush(queue, (cost, nth, near[node]))
            heapq.heappush(queue, (cost + m * m, nth + 1, far[node]))
            nth += 2
        return out


def planes(sample: np.ndarray, rows: int, bucket: int, seed: int) -> Planes:
    """A table over a sample of `rows` rows; nodes of few sampled rows, or of equal ones, stay whole."""
    rng, normal, offset, below, above = np.random.default_rng(seed), [], [], [], []
    scale = rows / max(1, len(sample))
    todo, leaves = [(np.arange(len(sample)), None)], []
    while todo:
        own, up = todo.pop()
        h = rng.normal(size=sample.shape[1])
        h /= np.linalg.norm(h) or 1.0
        d = sample[own] @ h
        cut = float(np.median(d)) if len(d) else 0.0
        if len(own) * scale <= bucket or len(own) < 2 * LEAST or not (d > cut).any():
            leaves.append(up)
            continue
        node = len(offset)
        normal.append(h)
        offset.append(cut)
        below.append(0)
        above.append(0)
        if up:
            up[0][up[1]] = node
        todo += [(own[d <= cut], (below, node)), (own[d > cut], (above, node))]
    for n, up in enumerate(leaves):
        if up:
            up[0][up[1]] = ~n
    return Planes(np.array(normal).reshape(len(offset), sample.shape[1]), np.array(offset), below, above)


def calibrated(tables: list[Planes], points: np.ndarray, near: list[np.ndarray], share: float, most: int | None = None) -> tuple[int, int, float] | None:
    """(tables, probes, share found): the cheapest numbers that find this share of the true neighbours of these points; none
    if that takes more than `most` buckets."""
    asked = sum(map(len, near))
    if not asked:
        return 1, 1, 1.0
    never = np.iinfo(np.int64).max
    rank = np.full((len(tables), asked), never)
    for t, table in enumerate(tables):
        margin, at = table.margins(points), 0
        for i, found in enumerate(near):
            order = {b: n for n, b in enumerate(table.probes(margin[i], most or table.buckets))}
            rank[t, at : at + len(found)] = [order.get(b, never) for b in table.own(found).tolist()] if len(found) else []
            at += len(found)
    best = None
    for t in range(1, len(tables) + 1):
        first = np.sort(rank[:t].min(axis=0))
        last = int(first[max(0, int(np.ceil(share * asked)) - 1)])
        if last == never or (most and t * (last + 1) > most):
            continue
        probes = last + 1
        if best is None or t * probes < best[0] * best[1]:
            best = t, probes, float((first < probes).mean())
    return best


def _flat(vectors: pa.Array) -> np.ndarray:
    """As they are, in single or double precision."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return _flat(vectors).astype(np.float64)


_HITS = "query long, id long, score double"


def _hits(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[str, pa.Array]:
    parts = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0)] * 3
    return {n: pa.array(p.astype(t)) for n, p, t in zip(("query", "id", "score"), parts, (np.int64, np.int64, np.float64), strict=True)}


def _far(x: np.ndarray) -> float:
    """The length of the longest row."""
    return max((float(np.sqrt((y * y).sum(axis=1).max())) for y in (x[s : s + PIECE].astype(np.float64) for s in range(0, len(x), PIECE))), default=0.0)


def _least_of_best(at: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """Of each of n rows its k-th largest score, or -inf if it has fewer."""
    order = np.lexsort((-score, at))
    first = np.searchsorted(at[order], np.arange(n + 1))
    out, full = np.full(n, -np.inf), np.diff(first) >= k
    out[full] = score[order[first[:-1][full] + k - 1]]
    return out


def _best(q: np.ndarray, v: np.ndarray, far: float, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in q, in v) of each row's k largest products of at least `least`, with all that may be as large but for rounding.
    A piece of v after another; what is below a row's k best so far is passed over at once. The products are single where
    their error is bounded, and no pair is lost to it."""
    own = _far(q)
    single = far < 1e15 and own < 1e15  # false for what is not finite
    room = (q.shape[1] + 4) * 2.0 ** (-24 if single else -52) * own * far + 1e-37
    room, kind = 3 * room if np.isfinite(room) else 0.0, np.float32 if single else np.float64
    left, floor = q.astype(kind), np.full(len(q), least - room)
    at, of, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
    new, pending, space = [], 0, np.empty((len(q), PIECE), kind)
    for s in range(0, len(v), PIECE):
        right = v[s : s + PIECE].astype(kind, copy=False).T
        rough = np.matmul(left, right, out=space if right.shape[1] == PIECE else None)
        if not single:
            rough[np.isnan(rough)] = -np.inf
        width = rough.shape[1]
        if s == 0 and width > k:
            floor = np.maximum(floor, np.partition(rough, width - k, axis=1)[:, width - k] - room)
        bar = floor.astype(kind)
        some = np.flatnonzero(rough.max(axis=1) >= bar)
        rough = rough if len(some) == len(q) else rough[some]
        i, j = np.divmod(np.flatnonzero(rough >= bar[some, None]), width)
        new.append((some[i], j + s, rough[i, j]))
        pending += len(i)
        if pending > 2 * k * len(q) or s + PIECE >= len(v):
            at, of, score = (np.concatenate(c) for c in zip((at, of, score), *new, strict=True))
            floor = np.maximum(floor, _least_of_best(at, score, len(q), k) - room)
            keep = score >= floor[at]
            at, of, score, new, pending = at[keep], of[keep], score[keep], [], 0
    return at, of


def _scored(keys: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, far: float, k: int, least: float) -> tuple:
    """Each query's k best of these rows, and what equals them, with at least this score."""
    at, of = _best(q, v, far, k, least)
    exact = np.concatenate([np.zeros(0), *((v[of[s : s + COPIES]].astype(np.float64) * q[at[s : s + COPIES]]).sum(axis=1) for s in range(0, len(at), COPIES))])
    keep = (exact >= least) & (exact >= _least_of_best(at, exact, len(q), k)[at])
    return keys[at[keep]], ids[of[keep]], exact[keep]


def _scan(keys: np.ndarray, q: np.ndarray, k: int, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), _flat(batch.column(1))
            if len(ids) and len(keys):
                yield pa.record_batch(_hits([_scored(keys, q, ids, v, _far(v), k, least)]))

    return run


def _dealt(tables: list[Planes], probes: int, parts: dict[tuple[int, int], int], lies: bool, asks: bool, slices: int = 1) -> Callable:
    """Rows to the buckets that they ask, in all of a bucket's parts, and to the part of a bucket in which each lies. A part is
    there once for each slice of the rows that ask."""

    def sent(few: pa.RecordBatch, copies: list[tuple[int, int, int, int, bool, bool]]) -> pa.RecordBatch:
        at, table, bucket, part, held, asked = (list(c) for c in zip(*copies, strict=True))
        rows = pa.array(at, pa.int64())
        return pa.record_batch([pa.array(table, pa.int32()), pa.array(bucket, pa.int64()), pa.array(part, pa.int32()), pa.array(held, pa.bool_()), pa.array(asked, pa.bool_()), few.column(0).take(rows), few.column(1).take(rows)], names=["table", "bucket", "part", "lies", "asks", "cid", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in (batch.slice(s, ROWS) for batch in batches for s in range(0, batch.num_rows, ROWS)):
            cid, x, copies = few.column(0).to_numpy(), _matrix(few.column(1)), []
            turns = ((cid >> 20) % slices).tolist()
            for t, planes_ in enumerate(tables):
                own, margin = planes_.own(x).tolist(), planes_.margins(x)
                for i in range(len(x)):
                    for b in {own[i], *planes_.probes(margin[i], probes)} if asks else (own[i],):
                        n = parts.get((t, b), 1)
                        home = int(cid[i] % n) if lies and b == own[i] else -1
                        if asks:
                            copies += [(i, t, b, p * slices + turns[i], p == home, True) for p in range(n)]
                        if home >= 0:
                            copies += [(i, t, b, home * slices + s, True, False) for s in range(slices) if not asks or s != turns[i]]
                        if len(copies) >= COPIES:
                            yield sent(few, copies)
                            copies = []
            if copies:
                yield sent(few, copies)

    return run


def _met(k: int, least: float, block: int = 1_024) -> Callable:
    """What a part of a bucket holds, against all rows that ask it: rows in order of the parts, in each those that lie there
    first. These are held, and are of bounded number; those that only ask, however many, pass by them."""

    def asked(rows: pa.RecordBatch | pa.Table, ids: np.ndarray, v: np.ndarray, far: float) -> Iterator[pa.RecordBatch]:
        rows = pa.table(rows.columns, names=rows.schema.names) if isinstance(rows, pa.RecordBatch) else rows
        asking = rows.filter(rows.column("asks"))
        for s in range(0, asking.num_rows if len(ids) else 0, block):
            asks = asking.slice(s, block).combine_chunks()
            yield pa.record_batch(_hits([_scored(asks.column("cid").to_numpy(), _matrix(asks.column("vec").combine_chunks()), ids, v, far, k, least)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, v, far = None, [], None, None, 0.0

        def settled() -> tuple[pa.Table | None, np.ndarray, np.ndarray, float]:
            if not held:
                return None, np.zeros(0, np.int64), np.zeros((0, 0)), 0.0
            table = pa.Table.from_batches(held).combine_chunks()
            v = _flat(table.column("vec").combine_chunks())
            return table, table.column("cid").to_numpy(), v, _far(v)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in range(3)]
            turns = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for low, high in zip([0, *turns], [*turns, batch.num_rows], strict=True):
                now = tuple(int(c[low]) for c in columns)
                if now != key:
                    if held and ids is None:
                        own, ids, v, far = settled()
                        yield from asked(own, ids, v, far)
                    key, held, ids, v, far = now, [], None, None, 0.0
                rows = batch.slice(low, high - low)
                lying = rows.column(3).true_count
                if lying:
                    held.append(rows.slice(0, lying))
                if lying < rows.num_rows:
                    if ids is None:
                        own, ids, v, far = settled()
                        if own is not None:
                            yield from asked(own, ids, v, far)
                    yield from asked(rows.slice(lying), ids, v, far)
        if held and ids is None:
            own, ids, v, far = settled()
            yield from asked(own, ids, v, far)

    return run


def _sound(rows: DataFrame, key: str, vec: str, size: int | None = None) -> tuple[DataFrame, int]:
    """(rows (id, vec, cid) that take part, the length of their vectors)."""
    found = rows.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("vec"))
    found = found.where("id is not null and vec is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    found = written(found.withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))).withColumn("cid", F.xxhash64("vec")), "vectors")
    if size is None:
        common = found.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
        size = common.n if common else 0
    return found.where(F.size("vec") == size), size


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """(cid, vec, ids): distinct vectors with their smallest ids; each partition keeps so many of each."""
    first = rows.withColumn("nth", F.row_number().over(W.partitionBy("cid").orderBy("id"))).where(F.col("nth") <= keep)
    return written(first.groupBy("cid").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list("id")).alias("ids")), "classes")


def _lists(classes: DataFrame, asking: DataFrame | None, size: int, k: int, least: float, share: float, bucket: int) -> DataFrame:
    """(cid, list of (nth, id, score)): the k best of each asking class among all classes (the classes themselves, if no
    others ask)."""
    n, points_of = classes.count(), classes if asking is None else asking
    asks = n if asking is None else asking.count()
    drawn = F.shiftrightunsigned(F.xxhash64("cid", F.lit(7)), 11) / F.lit(float(1 << 53))
    some = lambda df, m, of: df.where(drawn < min(1.0, (2 * m + 100) / max(1, of))).orderBy(drawn, "cid").limit(m).select("cid", "vec").toArrow().combine_chunks()
    sample = some(classes, SAMPLE, n)
    drawn_rows = _matrix(sample.column("vec").combine_chunks()) if n else np.zeros((0, size))
    trial = some(points_of, CALIBRATION, asks)
    keys, points = trial.column("cid").to_numpy(), _matrix(trial.column("vec").combine_chunks())
    truth = classes.select("cid", "vec").mapInArrow(_scan(keys, points, k, least), _HITS)
    truth = truth.withColumn("nth", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("nth") <= k)
    truth = truth if asking is not None else truth.where("query <> id")
    truth = truth.join(classes.select(F.col("cid").alias("id"), "vec"), "id").toArrow().combine_chunks()
    asked, found = truth.column("query").to_numpy(), _matrix(truth.column("vec").combine_chunks()) if truth.num_rows else np.zeros((0, size))
    near = [found[asked == q] for q in keys.tolist()]
    # buckets of twice as many rows, until few enough are asked; one that holds all is
    while not (fit := calibrated(tables := [planes(drawn_rows, n, bucket, seed) for seed in range(TABLES)], points, near, share, MOST)):
        bucket *= 2
    count, probes, _ = fit
    tables = tables[:count]
    most = max(t.buckets for t in tables)
    # what lies in a bucket is there once a slice, so there are no more of them than make up what asks it
    slices = max(1, min(TASKS // sum(t.buckets for t in tables), asks // PIECE, count * probes * asks // max(1, n)))

    # a row for each bucket, of which the sample allows so many
    schema = "table int, bucket long, part int, lies boolean, asks boolean, cid long, vec " + dict(classes.dtypes)["vec"]
    held = classes.select("cid", "vec").mapInArrow(_dealt(tables, 1, {}, True, False), schema)
    crowded = held.groupBy("table", "bucket").count().where(F.col("count") > HELD).collect()
    parts = {(r.table, r.bucket): -(-r["count"] // HELD) for r in crowded}
    dealt = classes.select("cid", "vec").mapInArrow(_dealt(tables, probes, parts, True, asking is None, slices), schema)
    if asking is not None:
        dealt = dealt.unionByName(asking.select("cid", F.col("vec").cast(dict(classes.dtypes)["vec"]).alias("vec")).mapInArrow(_dealt(tables, probes, parts, False, True, slices), schema))
    place = ["table", "bucket", "part"]
    each = slices * max(parts.values(), default=1)
    tasks = min(count * most * each, max(TASKS, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    nth_place = (F.col("table") * most + F.col("bucket")) * each + F.col("part")
    hits = dealt.repartitionById(tasks, (nth_place % tasks).cast("int")).sortWithinPartitions(*place, F.desc("lies")).mapInArrow(_met(k, least), _HITS)
    # a pair that several tables found counts once; each task keeps its k best before they meet
    best = W.partitionBy("query").orderBy(F.desc("score"), "id")
    hits = hits.withColumn("nth", F.dense_rank().over(best)).where(F.col("nth") <= k).select("query", "id", "score").distinct()
    lists = hits.join(classes.select(F.col("cid").alias("id"), "ids"), "id").select("query", "score", F.explode("ids").alias("id"))
    lists = lists.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)
    return written(lists.groupBy(F.col("query").alias("cid")).agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("list")), "lists")


def edges(vectors: DataFrame, key: str, vec: str, k: int = 15, least: float = 0.65, share: float = 0.97, bucket: int = 2_048) -> DataFrame:
    """(query, id, score, rank): each row's k nearest by inner product at `least` or above, ties to the smaller id, all but
    about 1 - share of them. Rows without key or vector, and vectors with null or non-finite components, or of another
    length than most, take no part."""
    rows, size = _sound(vectors, key, vec)
    if size == 0:
        return vectors.sparkSession.createDataFrame([], f"{_HITS}, rank int")
    # of equal vectors, only the k + 1 smallest ids can be among anyone's nearest
    lists = _lists(_classes(rows, k + 1), None, size, k + 1, least, share, bucket)
    mine = rows.select(F.col("id").alias("query"), "cid").join(lists.hint("merge"), "cid")
    others = F.slice(F.filter("list", lambda x: x["id"] != F.col("query")), 1, k)
    return mine.select("query", F.posexplode(others).alias("at", "x")).select("query", "x.id", "x.score", (F.col("at") + 1).alias("rank"))


def search(vectors: DataFrame, key: str, vec: str, queries: DataFrame, k: int, least: float = -np.inf, share: float = 0.97, bucket: int = 2_048) -> DataFrame:
    """(query, id, score, rank): as `edges`, for queries (key, vec) that are not the table's rows, or are none of their own
    neighbours' concern: a query's own id counts. As many queries as there are; with k = 1 and a table of centres, it
    assigns each vector to its centre, however many there are."""
    rows, size = _sound(vectors, key, vec)
    if size == 0:
        return vectors.sparkSession.createDataFrame([], f"{_HITS}, rank int")
    asked, _ = _sound(queries, key, vec, size)
    distinct = written(asked.groupBy("cid").agg(F.first("vec").alias("vec")), "asking")
    lists = _lists(_classes(rows, k), distinct, size, k, least, share, bucket)
    mine = asked.select(F.col("id").alias("query"), "cid").join(lists.hint("merge"), "cid")
    return mine.select("query", F.posexplode("list").alias("at", "x")).select("query", "x.id", "x.score", (F.col("at") + 1).alias("rank"))
