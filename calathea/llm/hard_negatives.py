"""Hard negatives by vantage-point trees: rows of other labels whose scores lie in a window below a positive's.

A row's components become floor(256 * x); its score for an anchor is their integer inner product. Vectors are augmented
by one coordinate that gives all the same norm, so that a score is a distance (the anchor's coordinate is 0), larger
scores being nearer, and a window of scores is an annulus about the anchor.

Index. A vantage-point tree over at most SAMPLE sampled rows deals all rows into shards by the shells that hold them; a
shard of more than about BYTES is split by row. A task builds a balanced vantage-point tree over its shard, whose
shells have the true least and largest distances. Shards and leaves outside an annulus are never visited.
Search. Two passes, each exact: the positives (nearest rows of the anchor's label), then, for the annulus of each
positive, rows of other labels. A pass deals anchors to the shards that their annuli meet, having bounded these by the
best of SEED sampled rows; in a shard, an anchor's leaves are taken nearest first, in steps, and each step narrows the
annulus to the k-th best found, until no leaf left meets it. Anchors of a shard are shared out QUERIES at a time.
Where vectors have no structure no shell is missed, and the work is that of all anchors against all rows.

Defined results: rows with a null id or label, a null vector, or a null or non-finite component take no part; vectors of
different lengths have no score for each other; empty vectors all score 0; equal ids are rows of their own, and rows
with equal score and id are interchangeable; an anchor without positives, or a positive without rows in its window, has
no row. Scores beyond 64 bits are held at its bounds, and a product 256 * x beyond doubles at theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import column, cut

SAMPLE, SEED, BYTES, QUERIES, LEAF, BLOCK = 20_000, 2_048, 32 << 20, 16_384, 128, 1_024
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def scores(q: np.ndarray, x: np.ndarray, wide: bool) -> np.ndarray:
    """Integer inner products, exact; `wide` ones may exceed what doubles hold and are held at the bounds of 64 bits."""
    if not wide:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: [[int(v) for v in r] for r in m]
    rows = whole(x)
    return np.array([[min(HIGH, max(LOW, sum(a * b for a, b in zip(p, r, strict=True)))) for r in rows] for p in whole(q)], np.int64).reshape(len(q), len(x))


@dataclass
class Space:
    """The augmented space of vectors of one length."""

    lift: float
    wide: bool

    def rest(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.lift - (x * x).sum(axis=1)))

    def apart(self, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Distances of rows to one row."""
        gap = x - v
        return np.sqrt((gap * gap).sum(axis=1) + (self.rest(x) - self.rest(v[None])[0]) ** 2)

    def far(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Distances of anchors to rows."""
        return np.sqrt(np.maximum(0.0, (q * q).sum(axis=1)[:, None] + self.lift - 2 * (q @ v.T)))

    def window(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score at these distances, with room for rounding."""
        both = ((q * q).sum(axis=1) + self.lift)[:, None]
        room = 1e-9 * both + 1e-3
        return (both - high * high) / 2 - room, (both - low * low) / 2 + room


@dataclass
class Shells:
    """A vantage-point tree over a sample. Node i parts rows at radius[i] from vantage[i]; below are nodes, or leaves as ~leaf."""

    space: Space
    vantage: np.ndarray
    radius: np.ndarray
    inner: list[int]
    outer: list[int]

    @property
    def leaves(self) -> int:
        return len(self.radius) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(0 if len(self.radius) else -1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
                continue
            near = self.space.apart(x[rows], self.vantage[node]) <= self.radius[node]
            todo += [(self.inner[node], rows[near]), (self.outer[node], rows[~near])]
        return out

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest) score that a row of each leaf can have, by anchor and leaf."""
        shape = (len(q), self.leaves)
        if self.space.wide:
            return np.full(shape, -np.inf), np.full(shape, np.inf)
        low, high = np.zeros(shape), np.full(shape, np.inf)
        far = self.space.far(q, self.vantage) if len(self.radius) else None
        todo = [(0 if len(self.radius) else -1, np.zeros(len(q)), np.full(len(q), np.inf))]
        while todo:
            node, a, b = todo.pop()
            if node < 0:
                low[:, ~node], high[:, ~node] = a, b
                continue
            d, r = far[:, node], self.radius[node]
            todo += [(self.inner[node], np.maximum(a, d - r), np.minimum(b, d + r)), (self.outer[node], np.maximum(a, r - d), b)]
        return self.space.window(q, low, high)


def shells(sample: np.ndarray, space: Space, leaves: int, seed: int = 1) -> Shells:
    """Parts the largest node at its median until there are so many leaves; nodes of few or of equal rows stay whole."""
    rng, vantage, radius, inner, outer = np.random.default_rng(seed), [], [], [], []
    todo, done = [(np.arange(len(sample)), None)], []
    while todo and not space.wide and len(todo) + len(done) < leaves:
        at = max(range(len(todo)), key=lambda i: len(todo[i][0]))
        rows, up = todo.pop(at)
        best = None
        for v in rng.choice(rows, min(8, len(rows)), replace=False) if len(rows) >= 16 else ():
            d = space.apart(sample[rows], sample[v])
            if best is None or d.std() > best[0].std():
                best = d, v
        r = float(np.median(best[0])) if best else 0.0
        if not best or not (best[0] > r).any():
            done.append((rows, up))
            continue
        node = len(radius)
        vantage.append(sample[best[1]])
        radius.append(r)
        inner.append(0)
        outer.append(0)
        if up:
            up[0][up[1]] = node
        todo += [(rows[best[0] <= r], (inner, node)), (rows[best[0] > r], (outer, node))]
    for leaf, (_, up) in enumerate([*todo, *done]):
        if up:
            up[0][up[1]] = ~leaf
    return Shells(space, np.array(vantage) if vantage else np.zeros((0, sample.shape[1])), np.array(radius), inner, outer)


class Balanced:
    """A vantage-point tree over the rows of a shard: each node's rows are halved by rank, so equal rows part as well."""

    def __init__(self, x: np.ndarray, space: Space, leaf: int = LEAF):
        self.space, self.order, levels = space, np.arange(len(x)), []
        spans = [(0, len(x))]
        while not space.wide and spans and max(b - a for a, b in spans) > leaf:
            at, low, high, parts = [], [], [], []
            for a, b in spans:
                own = self.order[a:b]
                d = space.apart(x[own], x[own[0]])
                far = space.apart(x[own], x[own[d.argmax()]])  # the row that is farthest from any sees most
                at.append(own[d.argmax()])
                sort = np.argsort(far, kind="stable")
                self.order[a:b], far, mid = own[sort], far[sort], (b - a) // 2
                low += [far[0], far[mid]]
                high += [far[mid - 1], far[-1]]
                parts += [(a, a + mid), (a + mid, b)]
            levels.append((np.array(at), np.array(low), np.array(high)))
            spans = parts
        if space.wide:
            spans = [(a, min(a + leaf, len(x))) for a in range(0, len(x), leaf)]
        self.levels, self.spans, self.x = levels, spans, x[self.order]
        self.vantage = [x[at] for at, _, _ in levels]

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.space.wide:
            return np.full((len(q), len(self.spans)), -np.inf), np.full((len(q), len(self.spans)), np.inf)
        a, b = np.zeros((len(q), 1)), np.full((len(q), 1), np.inf)
        for v, (_, low, high) in zip(self.vantage, self.levels, strict=True):
            d = np.repeat(self.space.far(q, v), 2, axis=1)
            a, b = np.maximum(np.repeat(a, 2, axis=1), np.maximum(d - high, low - d)), np.minimum(np.repeat(b, 2, axis=1), d + high)
        return self.space.window(q, a, b)


@dataclass
class Asked:
    """Anchors with their windows of scores: low and high have a column for each window."""

    row: np.ndarray
    label: np.ndarray
    q: np.ndarray
    low: np.ndarray
    high: np.ndarray


@dataclass
class Found:
    """The k best of each anchor's windows so far."""

    k: int
    who: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], low: np.ndarray) -> None:
        """Takes rows in; low (by anchor and window) rises to the k-th best."""
        who, score, ids = (np.concatenate([a, *b]) for a, b in zip((self.who, self.score, self.id), zip(*parts, strict=True), strict=True))
        at = np.lexsort((ids, ~score, who))  # ~ turns the order round without overflow
        who, score, ids = who[at], score[at], ids[at]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        full = nth == self.k - 1
        flat = low.reshape(-1)
        flat[who[full]] = np.maximum(flat[who[full]], score[full])
        self.who, self.score, self.id = who[nth < self.k], score[nth < self.k], ids[nth < self.k]


def _among(x: np.ndarray, who: np.ndarray, asked: Asked, label: np.ndarray, row: np.ndarray, ids: np.ndarray, same: bool, wide: bool) -> list:
    """Rows in the windows of these anchors."""
    s = scores(asked.q[who], x, wide)
    fit = label[None, :] == asked.label[who][:, None]
    fit = fit & (row[None, :] != asked.row[who][:, None]) if same else ~fit
    out, windows = [], asked.low.shape[1]
    for j in range(windows):
        i, at = np.nonzero(fit & (s >= asked.low[who, j][:, None]) & (s <= asked.high[who, j][:, None]))
        out.append((who[i] * windows + j, s[i, at], ids[at]))
    return out


def traverse(tree: Balanced, asked: Asked, label: np.ndarray, row: np.ndarray, ids: np.ndarray, k: int, same: bool) -> Found:
    """The k best rows of each window: leaves nearest first, in steps that double, until none left meets the annulus."""
    found = Found(k)
    label, row, ids = label[tree.order], row[tree.order], ids[tree.order]
    least, most = tree.bounds(asked.q)
    order = np.argsort(-most, axis=1, kind="stable")
    at, step, lines = 0, 2, np.arange(len(asked.q))
    while at < len(tree.spans):
        leaf = order[:, at : at + step]
        top, low = most[lines[:, None], leaf], least[lines[:, None], leaf]
        meets = ((top[:, :, None] >= asked.low[:, None, :]) & (low[:, :, None] <= asked.high[:, None, :])).any(axis=2)
        who, col = np.nonzero(meets)
        leaf = leaf[who, col]
        by = np.argsort(leaf, kind="stable")
        who, leaf = who[by], leaf[by]
        cuts = [0, *(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1).tolist(), len(leaf)] if len(leaf) else []
        parts = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True) if cuts else ():
            a, b = tree.spans[leaf[i]]
            parts += _among(tree.x[a:b], who[i:j], asked, label[a:b], row[a:b], ids[a:b], same, tree.space.wide)
        if parts:
            found.add(parts, asked.low)
        at, step = at + step, step * 2
        if at < len(tree.spans) and not (most[lines, order[:, at]][:, None] >= asked.low).any():
            break
    return found


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), size)


def _lists(column: pa.Array, fill: int) -> np.ndarray:
    """Lists of up to some length as lines of a matrix."""
    lists = column.to_pylist()
    out = np.full((len(lists), max(map(len, lists), default=0)), fill, np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


@dataclass
class Forest:
    """A tree for each length of vectors, and the sampled rows (row, id, label, vector) of each for first bounds."""

    trees: dict[int, Shells]
    sample: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    start: dict[tuple[int, int], tuple[int, int]]

    def leaves(self) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size, leaf = batch.column("size").to_numpy(), np.zeros(batch.num_rows, np.int64)
                for n in np.unique(size).tolist():
                    at = np.flatnonzero(size == n)
                    leaf[at] = self.trees[n].assign(_matrix(batch.column("vec").take(pa.array(at)), n))
                yield pa.record_batch([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

        return run

    def routes(self, k: int, same: bool) -> Callable:
        """Anchors to the shards that their windows meet, which the sampled rows have narrowed."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(a, BLOCK)
                    size = batch.column("size").to_numpy()
                    for n in np.unique(size).tolist():
                        yield self._routed(batch.take(pa.array(np.flatnonzero(size == n))), n, k, same)

        return run

    def _routed(self, batch: pa.RecordBatch, n: int, k: int, same: bool) -> pa.RecordBatch:
        tree, (row, ids, label, x) = self.trees[n], self.sample[n]
        get = lambda c: batch.column(c).to_numpy()
        asked = Asked(get("row"), get("label"), _matrix(batch.column("vec"), n), _lists(batch.column("low"), HIGH), _lists(batch.column("high"), LOW))
        every, best = np.arange(batch.num_rows), Found(k)
        for b in range(0, len(x), 512):
            s = slice(b, b + 512)
            best.add(_among(x[s], every, asked, label[s], row[s], ids[s], same, tree.space.wide), asked.low)
        least, most = tree.bounds(asked.q)
        meets = ((most[:, :, None] >= asked.low[:, None, :]) & (least[:, :, None] <= asked.high[:, None, :])).any(axis=2)
        who, leaf = np.nonzero(meets)
        parts = [self.start.get((n, x), (0, 0)) for x in range(tree.leaves)]
        shard = [list(range(parts[x][0], sum(parts[x]))) for x in leaf.tolist()]
        at = pa.array(np.repeat(who, [len(x) for x in shard]))
        windows = [len(x) for x in batch.column("high").to_pylist()]
        low = pa.array([x[:w] for x, w in zip(asked.low.tolist(), windows, strict=True)], pa.list_(pa.int64()))
        columns = {"shard": pa.array([x for s in shard for x in s], pa.int64()), **{c: batch.column(c).take(at) for c in ("row", "id", "label", "size", "vec")}, "low": low.take(at), "high": batch.column("high").take(at), "mark": batch.column("mark").take(at)}
        return pa.record_batch(list(columns.values()), names=list(columns))

    def visit(self, k: int, same: bool) -> Callable:
        """A shard's rows (without windows) and the anchors dealt to it."""
        spaces = {n: t.space for n, t in self.trees.items()}

        def run(table: pa.Table) -> pa.Table:
            is_row, out = pc.is_null(table.column("low")), []
            rows, anchors = (table.filter(x).combine_chunks() for x in (is_row, pc.invert(is_row)))
            get = lambda t, c: t.column(c).to_numpy()
            if rows.num_rows and anchors.num_rows:
                n = rows.column("size")[0].as_py()
                tree = Balanced(_matrix(rows.column("vec").combine_chunks(), n), spaces[n])
                for a in range(0, anchors.num_rows, BLOCK):
                    part = anchors.slice(a, BLOCK)
                    one = lambda c, t=part: t.column(c).combine_chunks()
                    asked = Asked(get(part, "row"), get(part, "label"), _matrix(one("vec"), n), _lists(one("low"), HIGH), _lists(one("high"), LOW))
                    found = traverse(tree, asked, get(rows, "label"), get(rows, "row"), get(rows, "id"), k, same)
                    who, slot = np.divmod(found.who, asked.low.shape[1])
                    out.append((asked.row[who], get(part, "id")[who], slot, _lists(one("mark"), 0)[who, slot], asked.high[who, slot], found.id, found.score))
            parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 7
            return pa.table([pa.array(c.astype(np.int64)) for c in parts], names=_FOUND.replace(" long", "").split(", "))

        return run


_FOUND = "row long, anchor_id long, slot long, mark long, high long, id long, score long"
_ROWS = "row long, id long, label long, size int, vec array<double>"
_ASKED = f"{_ROWS}, low array<long>, high array<long>, mark array<long>"


def _search(placed: DataFrame, anchors: DataFrame, forest: Forest, k: int, same: bool) -> DataFrame:
    """The k best rows of each window of the anchors (row, id, label, size, vec, low, high, mark)."""
    dealt = cut(anchors.mapInArrow(forest.routes(k, same), f"shard long, {_ASKED}"), "dealt")
    shares = dealt.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares"))
    rows = placed.join(shares, "shard").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    none = F.lit(None).cast("array<long>")
    rows = rows.withColumns({"low": none, "high": none, "mark": none})
    asked = dealt.join(shares, "shard").withColumn("share", F.pmod(F.xxhash64("row"), F.col("shares")).cast("int"))
    both = rows.select(asked.columns).unionByName(asked).drop("shares")
    found = both.groupBy("shard", "share").applyInArrow(forest.visit(k, same), _FOUND)
    best = W.partitionBy("row", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, k: int = 5, positives: int = 5, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (id divisible by `every`)
    and each of its first `positives` rows of the same label, the first k rows of other labels whose score is at least
    80 % of the positive's and at most that."""
    spark = vectors.sparkSession
    most = F.lit(1.7976931348623157e308)
    times = lambda x: F.least(F.greatest(x * 256, -most), most)
    whole = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)
    rows = vectors.select(column(vectors, id_col).cast("long").alias("id"), column(vectors, label_col).cast("long").alias("label"), column(vectors, vec_col).cast("array<double>").alias("vec"))
    sound = "id is not null and label is not null and vec is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
    rows = rows.where(sound).withColumn("vec", F.transform("vec", lambda x: whole(times(x))))
    # a number for each row, lasting as soon as it is written
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.size("vec").alias("size"), "vec"), "vectors")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    peak = F.coalesce(F.array_max(F.transform("vec", F.abs)), F.lit(0.0))
    # a row for each length of vectors
    kinds = rows.groupBy("size").agg(F.count("*").alias("n"), F.max(norm).alias("lift"), F.max(peak).alias("peak")).collect()
    total = sum(r.n for r in kinds)
    share = min(1.0, (2 * SAMPLE + 100) / max(1, total))
    drawn = F.shiftrightunsigned(F.xxhash64("row", F.lit(1)), 11) / F.lit(float(1 << 53))
    picked = rows.where(drawn < share).orderBy(drawn, "row").limit(SAMPLE).toArrow().combine_chunks()
    trees, sample = {}, {}
    for r in kinds:
        own = picked.filter(pa.array(picked.column("size").to_numpy() == r["size"])).combine_chunks()
        x = _matrix(own.column("vec").combine_chunks() if own.num_rows else pa.array([], pa.list_(pa.float64())), r["size"])
        space = Space(r.lift, not r.peak * r.peak * max(1, r["size"]) < float(1 << 52))
        trees[r["size"]] = shells(x, space, max(1, -(-r.n // _rows(r.n, r["size"]))))
        sample[r["size"]] = tuple(own.column(c).to_numpy()[:SEED] for c in ("row", "id", "label")) + (x[:SEED],)
    forest = Forest(trees, sample, {})
    index = cut(rows.mapInArrow(forest.leaves(), f"{_ROWS}, leaf long"), "index")
    # a row for each leaf, of which the sample allows so many
    table, at = [], 0
    for r in index.groupBy("size", "leaf").count().orderBy("size", "leaf").collect():
        parts = -(-r["count"] // _rows(next(x.n for x in kinds if x["size"] == r["size"]), r["size"]))
        forest.start[r["size"], r.leaf] = at, parts
        table.append((r["size"], r.leaf, at, parts))
        at += parts
    shards = spark.createDataFrame(table, "size int, leaf long, start long, parts int")
    placed = index.join(F.broadcast(shards), ["size", "leaf"]).select((F.col("start") + F.pmod(F.xxhash64("row"), F.col("parts"))).alias("shard"), "row", "id", "label", "size", "vec")

    anchors = rows.where(F.col("id") % every == 0)
    lists = [F.array(F.lit(x).cast("long")) for x in (LOW, HIGH, 0)]
    first = _search(placed, anchors.select("*", *(x.alias(c) for x, c in zip(lists, ("low", "high", "mark"), strict=True))), forest, positives, True)
    near = first.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    # the least whole number that is 80 % of p or more is p less the floor of its fifth
    least = F.expr("transform(p.score, p -> p - (p div 5 - if(p < 0 and p % 5 <> 0, 1, 0)))")
    windows = anchors.join(near, "row").select("row", "id", "label", "size", "vec", least.alias("low"), F.col("p.score").alias("high"), F.col("p.id").alias("mark"))
    found = _search(placed, windows, forest, k, False)
    return found.select("anchor_id", F.col("mark").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("high").alias("positive_score"), F.col("score").alias("negative_score"))


def _rows(n: int, size: int) -> int:
    """Rows of a shard: a 64th of the table, within bounds of memory."""
    return max(1, min(max(1_024, n // 64), BYTES // (8 * max(1, size))))
