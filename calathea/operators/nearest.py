"""The nearest place of each point, by a tree that is split by counts.

Places are points of the unit sphere in space, where there are no poles and no meridian to care for, and the nearer chord
is the nearer place. A kd-tree over at most SAMPLE sampled places is split until a leaf stands for about LEAF of them, so
dense regions have small leaves; every place is dealt to its leaf, and the leaves keep the true bounds of what they hold.
A point first asks the leaf that it lies in, which bounds how far the nearest place can be; then all other leaves that
reach within that. No two rounds of it lose a point, wherever it is. A leaf's places meet the points that ask it in one
bounded matrix after another; crowded leaves are worked off in parts, and so are the points of a leaf that many ask.
Points of one location are looked up once; of places at one location the smallest counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .durable import written

SAMPLE, LEAF, ASKING = 50_000, 512, 50_000
#: Chords that are equal to the millimetre, and more.
ROOM = 4e-10


@dataclass
class Tree:
    """Node i parts space at cut[i] along axis[i]; children below and above, ~leaf for leaves."""

    axis: list[int]
    cut: list[float]
    below: list[int]
    above: list[int]
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def home(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(0 if self.axis else -1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
                continue
            up = x[rows, self.axis[node]] > self.cut[node]
            todo += [(self.below[node], rows[~up]), (self.above[node], rows[up])]
        return out

    def bound(self, low: np.ndarray, high: np.ndarray) -> None:
        """Takes the leaves' bounds (those of empty ones are infinitely far), and finds the nodes'."""
        n = len(self.axis)
        self.low, self.high = np.full((n + len(low), 3), np.inf), np.full((n + len(low), 3), np.inf)
        self.low[n:], self.high[n:] = low, high
        for node in range(n - 1, -1, -1):  # children are numbered after their parents
            kids = [self._row(k) for k in (self.below[node], self.above[node])]
            kids = [k for k in kids if np.isfinite(self.low[k]).all()]
            if kids:
                self.low[node], self.high[node] = self.low[kids].min(axis=0), self.high[kids].max(axis=0)

    def _row(self, node: int) -> int:
        return node if node >= 0 else len(self.axis) + ~node

    def within(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves whose bounds are within reach of a row."""
        rows_, leaves, todo = [], [], [(0 if self.axis else -1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            k = self._row(node)
            if not np.isfinite(self.low[k]).all():
                continue
            gap = np.maximum(0, np.maximum(self.low[k] - x[rows], x[rows] - self.high[k]))
            rows = rows[np.sqrt((gap * gap).sum(axis=1)) <= reach[rows] + ROOM]
            if node < 0:
                rows_.append(rows)
                leaves.append(np.full(len(rows), ~node))
            elif len(rows):
                todo += [(self.below[node], rows), (self.above[node], rows)]
        return np.concatenate(rows_ or [np.zeros(0, np.int64)]), np.concatenate(leaves or [np.zeros(0, np.int64)])


def tree_of(sample: np.ndarray, places: int, leaf: int) -> Tree:
    """Halves the widest axis at the median until a leaf stands for at most `leaf` places."""
    tree, scale = Tree([], [], [], []), places / max(1, len(sample))
    todo, leaves = [(np.arange(len(sample)), None)], []
    while todo:
        rows, up = todo.pop(0)
        own = sample[rows]
        axis = int(np.ptp(own, axis=0).argmax()) if len(own) else 0
        cut = float(np.median(own[:, axis])) if len(own) else 0.0
        if len(rows) * scale <= leaf or len(rows) < 4 or not (own[:, axis] > cut).any():
            leaves.append(up)
            continue
        node = len(tree.axis)
        tree.axis.append(axis)
        tree.cut.append(cut)
        tree.below.append(0)
        tree.above.append(0)
        if up:
            up[0][up[1]] = node
        todo += [(rows[own[:, axis] <= cut], (tree.below, node)), (rows[own[:, axis] > cut], (tree.above, node))]
    for n, up in enumerate(leaves):
        if up:
            up[0][up[1]] = ~n
    return tree


_XYZ = "x double, y double, z double"


def _space(rows: DataFrame, lat: str, lon: str) -> DataFrame:
    a, b = F.radians(F.col(lat)), F.radians(F.col(lon))
    return rows.withColumns({"x": F.cos(a) * F.cos(b), "y": F.cos(a) * F.sin(b), "z": F.sin(a)})


def _matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in ("x", "y", "z")], axis=1)


def _homes(tree: Tree) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("leaf", pa.array(tree.home(_matrix(batch))))

    return run


def _others(tree: Tree) -> Callable:
    """Of each location, the leaves within reach that it hasn't asked yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, leaf = tree.within(_matrix(batch), batch.column("reach").to_numpy())
            new = leaf != batch.column("leaf").to_numpy()[row]
            out = batch.take(pa.array(row[new]))
            yield out.set_column(out.schema.get_field_index("leaf"), "leaf", pa.array(leaf[new]))

    return run


def _nearest(block: int = 1 << 20) -> Callable:
    """The places of a leaf (of a part of it) that are as near as any there to a location, with their chord."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_place = table.column("is_place").to_numpy()
        spots, asks = (table.filter(pa.array(x)).combine_chunks() for x in (is_place, ~is_place))
        p, q, reach = _matrix(spots), _matrix(asks), asks.column("reach").to_numpy()
        rows, which, chords = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for s in range(0, len(q), step := max(1, block // max(1, len(p)))) if len(p) else ():
            gap = q[s : s + step, None, :] - p[None, :, :]
            d = np.sqrt((gap * gap).sum(axis=2))
            least = np.minimum(d.min(axis=1), reach[s : s + step])
            i, j = np.nonzero(d <= least[:, None] + ROOM)
            rows.append(s + i)
            which.append(j)
            chords.append(d[i, j])
        row, place = pa.array(np.concatenate(rows)), pa.array(np.concatenate(which))
        out = [asks.column(c).take(row).combine_chunks() for c in ("lat", "lon")] + [spots.column(c).take(place).combine_chunks() for c in ("lat", "lon", "place")]
        return pa.table([*out, pa.array(np.concatenate(chords))], names=["lat", "lon", "at_lat", "at_lon", "place", "chord"])

    return run


def _asked(spots: DataFrame, asks: DataFrame, kind: str) -> DataFrame:
    """Leaves in parts, each with its share of the locations that ask it."""
    shares = asks.groupBy("leaf").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("shares"))  # a row for each leaf
    places = spots.join(F.broadcast(shares), "leaf").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    places = places.withColumns({"is_place": F.lit(True), "reach": F.lit(0.0)})
    parts = spots.groupBy("leaf").agg((F.max("part") + 1).alias("parts"))
    points = asks.join(F.broadcast(shares), "leaf").withColumn("share", F.pmod(F.xxhash64("lat", "lon"), F.col("shares")).cast("int"))
    points = points.join(F.broadcast(parts), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    points = points.withColumns({"is_place": F.lit(False), "place": F.lit(None)})
    names = ["leaf", "part", "share", "is_place", "lat", "lon", "x", "y", "z", "place", "reach"]
    both = places.select(names).unionByName(points.select(names))
    return both.groupBy("leaf", "part", "share").applyInArrow(_nearest(), f"lat double, lon double, at_lat double, at_lon double, place {kind}, chord double")


def nearest_place(points: DataFrame, key: str, places: DataFrame, place: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(key, place, km): the nearest place of each point, to the millimetre, ties to the smaller place. Points and places
    without coordinates take no part; without places there are no rows."""
    sound = lambda df: df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))
    at = [F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")]
    own = sound(points.select(key, *at))
    spots = sound(places.select(F.col(place).alias("place"), *at)).groupBy("lat", "lon").agg(F.min("place").alias("place"))
    spots = written(_space(spots, "lat", "lon"), "places")
    kind = dict(spots.dtypes)["place"]

    n = spots.count()
    drawn = F.shiftrightunsigned(F.xxhash64("lat", "lon"), 11) / F.lit(float(1 << 53))
    sample = spots.where(drawn < min(1.0, (2 * SAMPLE + 100) / max(1, n))).orderBy(drawn, "lat", "lon").limit(SAMPLE).select("x", "y", "z").toArrow().combine_chunks()
    tree = tree_of(_matrix(sample), n, LEAF)
    spots = spots.mapInArrow(_homes(tree), f"lat double, lon double, place {kind}, {_XYZ}, leaf long")
    # a row for each leaf, of which the sample allows so many
    bounds = spots.groupBy("leaf").agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xyz")).collect()
    low, high = (np.full((len(tree.axis) + 1, 3), np.inf) for _ in range(2))
    for r in bounds:
        low[r.leaf], high[r.leaf] = [r[f"min_{c}"] for c in "xyz"], [r[f"max_{c}"] for c in "xyz"]
    tree.bound(low, high)
    parts = points.sparkSession.createDataFrame([(r.leaf, -(-r.n // (4 * LEAF))) for r in bounds], "leaf long, of int")
    spots = written(spots.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("lat", "lon"), F.col("of")).cast("int")).drop("of"), "leaves")

    asks = _space(own.select("lat", "lon").distinct(), "lat", "lon").mapInArrow(_homes(tree), f"lat double, lon double, {_XYZ}, leaf long")
    asks = written(asks, "asks")
    # a location whose own leaf is empty takes the whole globe for its reach
    first = written(_asked(spots, asks.withColumn("reach", F.lit(2.0)), kind), "first")
    reach = first.groupBy("lat", "lon").agg(F.min("chord").alias("reach"))
    again = asks.join(reach, ["lat", "lon"], "left").withColumn("reach", F.coalesce("reach", F.lit(2.0)))
    again = again.select("lat", "lon", "x", "y", "z", "leaf", "reach").mapInArrow(_others(tree), f"lat double, lon double, {_XYZ}, leaf long, reach double")
    second = _asked(spots, written(again, "again"), kind)
    km = F.round(S.haversine_km(F.col("lat"), F.col("lon"), F.col("at_lat"), F.col("at_lon")), 6)
    best = first.unionByName(second).groupBy("lat", "lon").agg(F.min(F.struct(km.alias("km"), "place")).alias("b"))
    return own.join(best, ["lat", "lon"]).select(key, F.col("b.place").alias(place), F.col("b.km").alias("km"))
