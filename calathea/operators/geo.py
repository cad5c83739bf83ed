"""Derivations over geotagged series: homes, trips, stops, dense cells, masking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import windows
from .nearest import nearest_place as nearest_place


def near_any(rows: DataFrame, centres: Sequence[tuple[float, float]], km: float, lat: str = "lat", lon: str = "lon", name: str = "near") -> DataFrame:
    """Whether a point is within a radius of any of a few configured centres; the test is an expression, not a join."""
    tests = [S.haversine_km(F.col(lat), F.col(lon), F.lit(a), F.lit(b)) <= km for a, b in centres]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return rows.withColumn(name, out)


def home_distance(rows: DataFrame, residences: Sequence[dict], lat: str = "lat", lon: str = "lon", month: str = "ym") -> DataFrame:
    """`home` and `dist`: whether a residence active in the month holds the point, and the least distance to one."""
    homes, dists = F.lit(False), []
    for r in residences:
        active = (F.col(month) >= r["start"]) & (F.lit(r.get("end")).isNull() | (F.col(month) <= F.lit(r.get("end"))))
        d = S.haversine_km(F.col(lat), F.col(lon), F.lit(r["lat"]), F.lit(r["lon"]))
        homes = homes | F.coalesce(active & (d <= r.get("radius_km", 40)), F.lit(False))
        dists.append(F.when(active, d))
    return rows.withColumn("home", homes).withColumn("dist", F.least(*dists) if len(dists) > 1 else dists[0] if dists else F.lit(None).cast("double"))


def home_model(rows: DataFrame, metres: float = 400, lat: str = "lat", lon: str = "lon", day: str = "day", area: str = "area") -> DataFrame:
    """(lat, lon, days, area): the cell with most distinct days, its centroid and its modal area."""
    cells = rows.withColumn("__y", S.grid_cell(F.col(lat), metres)).withColumn("__x", S.grid_cell(F.col(lon), metres))
    found = cells.groupBy("__y", "__x").agg(F.count_distinct(day).alias("days"), F.avg(lat).alias("lat"), F.avg(lon).alias("lon"))
    best = found.orderBy(F.desc("days"), "__y", "__x").limit(1)
    areas = cells.join(F.broadcast(best.select("__y", "__x")), ["__y", "__x"]).where(F.col(area).isNotNull()).groupBy(area).count().orderBy(F.desc("count"), area).limit(1)
    return best.select("lat", "lon", "days").crossJoin(areas.select(area))  # one row each


def home_and_suburbs(rows: DataFrame, key: str, latest: int = 8_000, metres: float = 400, near_km: float = 8.0, least_days: int = 3, lat: str = "lat", lon: str = "lon", day: str = "day", area: str = "area") -> DataFrame:
    """(lat, lon, days, area, suburbs): the home of the latest rows. Its place is the centroid of the cell with most
    distinct days, its area the one with most rows; suburbs are that and the areas whose centroid is within `near_km` and
    which at least `least_days` days have. Ties go to the smaller cell and area; rows without a place take no part."""
    some = rows.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).orderBy(F.desc(key)).limit(latest)
    cells = some.groupBy(S.grid_cell(F.col(lat), metres).alias("__y"), S.grid_cell(F.col(lon), metres).alias("__x"))
    cells = cells.agg(F.count_distinct(day).alias("days"), F.avg(lat).alias("lat"), F.avg(lon).alias("lon"))
    home = cells.agg(F.min(F.struct(F.negative("days").alias("d"), "__y", "__x", "lat", "lon")).alias("h")).select("h.lat", "h.lon", F.negative("h.d").alias("days")).where("lat is not null")
    areas = some.where(F.coalesce(area, F.lit("")) != "").groupBy(F.col(area).alias("area")).agg(F.count("*").alias("n"), F.count_distinct(day).alias("__days"), F.avg(lat).alias("__lat"), F.avg(lon).alias("__lon"))
    # one row beside each area
    placed = areas.crossJoin(F.broadcast(home)).withColumn("near", (S.haversine_km(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon")) <= near_km) & (F.col("__days") >= least_days))
    found = placed.agg(F.min(F.struct(F.negative("n").alias("n"), "area"))["area"].alias("area"), F.collect_set(F.when(F.col("near"), F.col("area"))).alias("near"))
    suburbs = F.array_sort(F.array_distinct(F.concat("near", F.when(F.col("area").isNotNull(), F.array("area")).otherwise(F.array().cast("array<string>")))))
    return home.crossJoin(F.broadcast(found)).select("lat", "lon", "days", "area", suburbs.alias("suburbs"))  # one row each


def trips(rows: DataFrame, group: Sequence[str], ts: str, dist: str, away_km: float = 60, gap: float = 172_800, least: int = 40, lat: str = "lat", lon: str = "lon", title: str = "title", score: str = "score", tie: str = "id") -> DataFrame:
    """Trips: runs of frames away from home without a longer gap; frames, days, bounds, modal title and best frame."""
    away = rows.where(F.col(ts).isNotNull() & (F.col(ts) != 0) & (F.col(dist) > away_km))
    chained = windows.chains(away, group, ts, tie, gap, "trip")
    keys = [*group, "trip"]
    out = chained.groupBy(*keys).agg(
        F.count("*").alias("frames"), F.count_distinct(F.floor(F.col(ts) / 86400)).alias("days"), F.min(ts).alias("start"), F.max(ts).alias("end"),
        F.avg(lat).alias("lat"), F.avg(lon).alias("lon"), F.min(lat).alias("south"), F.max(lat).alias("north"),
        F.max_by(tie, F.struct(score, F.negative(tie))).alias("hero"),
    ).where(F.col("frames") >= least)
    names = chained.groupBy(*keys, title).count()
    top = names.groupBy(*keys).agg(F.min_by(title, F.struct(F.negative("count"), title)).alias("title"))
    return out.join(top, keys, "left")


def stops(rows: DataFrame, group: Sequence[str], order: Sequence[str], place: str, ts: str) -> DataFrame:
    """(group, run, place, n, middle): runs of one place, with the time at the middle of each."""
    numbered = windows.runs(rows, group, order, place)
    w = W.partitionBy(*group, "run")
    at = numbered.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    return at.groupBy(*group, "run").agg(F.first(place).alias(place), F.count("*").alias("n"), F.max(F.when(F.col("__i") == F.floor(F.col("__n") / 2), F.col(ts))).alias("middle"))


def dense_cells(rows: DataFrame, metres: float = 150, least: int = 50, lat: str = "lat", lon: str = "lon", day: str = "day", home: str = "home") -> DataFrame:
    """(cell_y, cell_x, day, n): cells with many frames on a day, not over half of them at home."""
    cells = rows.withColumn("cell_y", S.grid_cell(F.col(lat), metres)).withColumn("cell_x", S.grid_cell(F.col(lon), metres))
    found = cells.groupBy("cell_y", "cell_x", day).agg(F.count("*").alias("n"), F.count_if(F.col(home)).alias("__h"))
    return found.where((F.col("n") >= least) & (F.col("__h") * 2 <= F.col("n"))).drop("__h")


def masked(rows: DataFrame, centres: Sequence[tuple[float, float]], km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points within a radius of a centre lose their coordinates."""
    near = near_any(rows, centres, km, lat, lon, "__near")
    hide = lambda c: F.when(~F.col("__near"), F.col(c))
    return near.withColumn(lat, hide(lat)).withColumn(lon, hide(lon)).drop("__near")
