"""Clusters of a map's points over its zooms: a pyramid in which every cluster knows the one that holds it.

From the finest zoom to the coarsest, the items of the zoom below (points, or clusters of them) are gathered in cells as
wide as the radius, then cells merge greedily: of all cells that are still open, those that no greater one (by number
of points, then the smaller id) is near to become hubs and take the open cells within the radius of their centres; rounds go
on until none is open. What a hub holds is a cluster at the weighted centre of its points if it has enough of them; else
its items stay as they are. A cell has at most eight cells about it, so no place is too dense, and each round settles
all hubs at once, wherever they are.

Coordinates are those of the square web map; latitudes beyond its edges lie on them. Points without a place or a key
take no part. A cluster's id is the least key among its points, so ids are unique within a zoom.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .durable import written

#: The edge of the web map.
EDGE = 85.0511287798066


def _projected(points: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """(id, x, y, n): points on the map, which is one unit wide and high."""
    points = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    s = F.sin(F.radians(F.least(F.lit(EDGE), F.greatest(F.lit(-EDGE), F.col(lat)))))
    x, y = F.col(lon) / 360 + 0.5, 0.5 - 0.25 * F.log((1 + s) / (1 - s)) / math.pi
    rows = points.select(F.col(key).cast("long").alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(1).cast("long").alias("n"))
    return rows.where("id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)")


def _hubs(cells: DataFrame, reach: float) -> DataFrame:
    """(cx, cy, hub): of each cell (cx, cy, id, x, y, n), the id of the cell that takes it."""
    side = F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1))))
    near = cells.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("x").alias("xa"), F.col("y").alias("ya"), "cx", "cy").withColumn("dx", side).withColumn("dy", side)
    near = near.select("a", "na", "xa", "ya", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    pairs = near.join(cells.select("cx", "cy", F.col("id").alias("b"), F.col("n").alias("nb"), "x", "y"), ["cx", "cy"]).where("a <> b")
    pairs = pairs.where((F.col("xa") - F.col("x")) ** 2 + (F.col("ya") - F.col("y")) ** 2 <= reach * reach)
    # for each cell, the near ones that come before it
    before = (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    pairs = written(pairs.select("a", "b", "nb", before.alias("before")), "near")
    open_, done = written(cells.select("id"), "open"), None
    while not open_.isEmpty():
        alive = pairs.join(open_.select(F.col("id").alias("a")), "a").join(open_.select(F.col("id").alias("b")), "b")
        hubs = written(open_.join(alive.where("before").select(F.col("a").alias("id")), "id", "left_anti"), "hubs")
        # a cell near to several hubs goes to the greatest
        first = F.row_number().over(W.partitionBy("a").orderBy(F.desc("nb"), "b"))
        taken = alive.join(hubs.select(F.col("id").alias("b")), "b").withColumn("first", first).where("first = 1").select(F.col("a").alias("id"), F.col("b").alias("hub"))
        settled = written(hubs.select("id", F.col("id").alias("hub")).unionByName(taken), "settled")
        done = settled if done is None else done.unionByName(settled)
        open_ = written(open_.join(settled, "id", "left_anti"), "open")
    return cells.select("cx", "cy", "id").join(done, "id").select("cx", "cy", "hub") if done is not None else cells.select("cx", "cy", F.col("id").alias("hub"))


def pyramid(points: DataFrame, key: str, least_zoom: int = 0, most_zoom: int = 18, radius: float = 88, extent: int = 512, least: int = 3, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(zoom, id, n, lat, lon, parent): the items of each zoom, and the id of the item of the zoom above that holds each
    (null at the coarsest)."""
    items, levels = written(_projected(points, key, lat, lon), "points"), []
    for zoom in range(most_zoom, least_zoom - 1, -1):
        reach = radius / (extent * 2**zoom)
        placed = items.withColumn("cx", F.floor(F.col("x") / reach)).withColumn("cy", F.floor(F.col("y") / reach))
        total = F.sum("n")
        weighted = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
        cells = written(placed.groupBy("cx", "cy").agg(F.min("id").alias("id"), weighted("x"), weighted("y"), total.alias("n")), "cells")
        hubs = written(_hubs(cells, reach), "hubs")
        sizes = cells.drop("id").join(hubs, ["cx", "cy"]).groupBy("hub").agg(total.alias("size"))
        # whether an item's hub has enough points, and which item of this zoom it is then in
        held = placed.join(hubs, ["cx", "cy"]).join(sizes, "hub").withColumn("enough", F.col("size") >= least)
        held = written(held.select("id", "x", "y", "n", "hub", "enough"), "held")
        merged = held.where("enough").groupBy("hub").agg(F.min("id").alias("own"), weighted("x"), weighted("y"), total.alias("n"))
        merged = written(merged, "merged")
        parents = held.where("enough").select("id", "hub").join(merged.select("hub", F.col("own").alias("parent")), "hub").select("id", "parent")
        parents = parents.unionByName(held.where("not enough").select("id", F.col("id").alias("parent")))
        if levels:
            levels[-1] = levels[-1].join(written(parents, "parents"), "id")
        items = written(merged.select(F.col("own").alias("id"), "x", "y", "n").unionByName(held.where("not enough").select("id", "x", "y", "n")), "items")
        levels.append(items.withColumn("zoom", F.lit(zoom)))
    levels[-1] = levels[-1].withColumn("parent", F.lit(None).cast("long"))
    found = levels[0].select("zoom", "id", "x", "y", "n", "parent")
    for level in levels[1:]:
        found = found.unionByName(level.select(found.columns))
    back = F.degrees(2 * F.atan(F.exp((1 - 2 * F.col("y")) * math.pi)) - math.pi / 2)
    return found.select("zoom", "id", "n", back.alias("lat"), ((F.col("x") - 0.5) * 360).alias("lon"), "parent")
