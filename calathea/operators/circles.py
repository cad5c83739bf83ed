"""Points in any of a large table of circles: a cover of cells at many levels, equi-joins on cells, an exact test after them.

The globe is cut into 2 ** level bands of latitude, and each band into as many cells as keep them about as wide as high,
so few near the poles. A circle takes the finest level whose bands are no lower than its diameter and covers the cells
that it may touch: a handful at any radius and place, over a pole and across the 180th meridian as well. A point has one
cell at each level that some circle takes, of which there are at most LEVELS. Nothing is compared but points and
circles of one cell, and of these what the exact distance says is taken. Points of one place are looked up once, and a
place stops at its first circle where only that is asked.

Where a point asks for a circle of its month (`at_home`), circles are cut finer, and most of a circle's cells lie within it
whole. Such a cell holds its points in the circle's months without a distance. Only points of other months meet the circles
whose edge crosses their cell, and of these only such as last beyond the months that the cell has already. So the denser
circles lie, the fewer are compared.

Points without a place are in no circle; circles without a centre or radius, or with a negative one, hold nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .durable import written

LEVELS = 24
#: Room for rounding, in degrees.
ROOM = 1e-7
#: Levels by which `at_home` cuts circles finer: a diameter is 4 to 8 cells.
FINER = 3
_KM = 6371.0088


def _width(level: Column) -> Column:
    return F.lit(180.0) / F.pow(F.lit(2.0), level)


def _around(level: Column, band: Column) -> Column:
    """How many cells go round the globe in a band."""
    low = F.lit(-90.0) + band * _width(level)
    least = F.when(level == 0, F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(low + _width(level))))
    return F.greatest(F.lit(1), F.floor(F.pow(F.lit(2.0), level + 1) * F.cos(F.radians(least)))).cast("long")


def cells_of_points(points: DataFrame, levels: Sequence[int], lat: str, lon: str) -> DataFrame:
    """The points with `level`, `band` and `cell`, a row for each level."""
    at = points.withColumn("level", F.explode(F.array(*(F.lit(x) for x in levels)) if levels else F.array().cast("array<int>")))
    last = F.pow(F.lit(2.0), F.col("level")).cast("long") - 1
    at = at.withColumn("band", F.least(last, F.floor((F.col(lat) + 90) / _width(F.col("level")))))
    around = _around(F.col("level"), F.col("band"))
    east = F.col(lon) + 180 - F.floor((F.col(lon) + 180) / 360) * 360
    return at.withColumn("cell", F.pmod(F.floor(east / (360 / around)), around))


def cells_of_circles(circles: DataFrame, lat: str, lon: str, km: str, finer: int = 0) -> DataFrame:
    """The circles with `level`, `band` and `cell`, a row for each cell that they may touch, so many levels finer."""
    sound = circles.where(F.col(lat).between(-90, 90) & F.col(lon).isNotNull() & ~F.isnan(lon) & (F.col(km) >= 0) & ~F.isnan(km))
    reach = F.degrees(F.least(F.col(km) / _KM, F.lit(3.2))) + ROOM
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.floor(F.log2(F.lit(180.0) / (reach * 2))) + finer)).cast("int")
    at = sound.withColumn("__reach", reach).withColumn("level", level)
    last = F.pow(F.lit(2.0), F.col("level")).cast("long") - 1
    band = lambda x: F.greatest(F.lit(0), F.least(last, F.floor((x + 90) / _width(F.col("level")))))
    at = at.withColumn("band", F.explode(F.sequence(band(F.col(lat) - F.col("__reach")), band(F.col(lat) + F.col("__reach")))))
    # how far the circle goes east and west; over a pole it goes all around
    spread = F.sin(F.radians("__reach")) / F.cos(F.radians(lat))
    polar = (F.abs(lat) + F.col("__reach") >= 90) | (spread >= 1)
    at = at.withColumn("__side", F.when(polar, F.lit(360.0)).otherwise(F.degrees(F.asin(spread)) + ROOM)).withColumn("__around", _around(F.col("level"), F.col("band")))
    side = lambda sign: F.floor((F.col(lon) + 180 + sign * F.col("__side")) / (360 / F.col("__around")))
    whole = side(1) - side(-1) + 1 >= F.col("__around")
    span = F.sequence(F.when(whole, F.lit(0)).otherwise(side(-1)), F.when(whole, F.col("__around") - 1).otherwise(side(1)))
    at = at.withColumn("cell", F.explode(span)).withColumn("cell", F.pmod("cell", "__around"))
    return at.drop("__reach", "__side", "__around")


def _holds_cell(lat: str, lon: str, km: str) -> Column:
    """Whether a circle surely holds its whole cell: where that is within a quarter of the globe, its farthest place is a corner."""
    width, around = _width(F.col("level")), _around(F.col("level"), F.col("band"))
    low = F.lit(-90.0) + F.col("band") * width
    bands = F.greatest(F.lit(-90.0), low - ROOM), F.least(F.lit(90.0), low + width + ROOM)
    sides = F.col("cell") * (360 / around) - 180 - ROOM, (F.col("cell") + 1) * (360 / around) - 180 + ROOM
    off = [F.pmod(side - F.col(lon) + 180, F.lit(360.0)) - 180 for side in sides]
    far = F.greatest(*(S.haversine_km(F.col(lat), F.col(lon), band, F.col(lon) + x) for band in bands for x in off))
    return (around >= 4) & (F.greatest(*map(F.abs, off)) < 90) & (far <= F.col(km) - 0.001)


def _merged(times: Column) -> Column:
    """Times (start, till (open, end)) as few that don't overlap."""
    joins = lambda a, x: a["till"]["open"] | (x["start"] <= a["till"]["end"])
    last = lambda a: F.element_at(a, -1)
    longer = lambda a, x: F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["till"], x["till"]).alias("till"))
    rest = F.array_sort(times)
    return F.aggregate(F.slice(rest, 2, F.size(rest)), F.slice(rest, 1, 1), lambda a, x: F.when(joins(last(a), x), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(longer(a, x)))).otherwise(F.concat(a, F.array(x))))


def _sides(points: DataFrame, circles: DataFrame, keep: Sequence[str], more: Sequence[str], lat: str, lon: str, radius: str) -> tuple[DataFrame, DataFrame]:
    """Places (distinct, with columns `keep`) and circles (with columns `more`) by cell."""
    own = circles.select(F.col(lat).alias("__lat"), F.col(lon).alias("__lon"), F.col(radius).alias("__km"), *(F.col(c).alias(f"__{c}") for c in more))
    cover = written(cells_of_circles(own, "__lat", "__lon", "__km"), "cover")
    levels = sorted(r.level for r in cover.select("level").distinct().collect())
    places = points.where(F.col(lat).between(-90, 90) & F.col(lon).isNotNull() & ~F.isnan(lon)).select(lat, lon, *keep).distinct()
    return cells_of_points(places, levels, lat, lon), cover


def _holds(lat: str, lon: str) -> Column:
    return S.haversine_km(F.col(lat), F.col(lon), F.col("__lat"), F.col("__lon")) <= F.col("__km")


def in_any(points: DataFrame, circles: DataFrame, lat: str = "lat", lon: str = "lon", radius: str = "radius_km", name: str = "near") -> DataFrame:
    """The points with `near`: whether a circle of the table holds them."""
    places, cover = _sides(points, circles, [], [], lat, lon, radius)
    same = [places[c] == cover[c] for c in ("level", "band", "cell")]
    held = places.join(cover, [*same, _holds(lat, lon)], "left_semi").select(lat, lon).distinct().withColumn("__near", F.lit(True))
    return points.join(held, [lat, lon], "left").withColumn(name, F.coalesce("__near", F.lit(False))).drop("__near").select(*points.columns, name)


def pairs(points: DataFrame, key: str, circles: DataFrame, circle: str, lat: str = "lat", lon: str = "lon", radius: str = "radius_km") -> DataFrame:
    """(key, circle, km): every circle that holds a point, with the distance to its centre."""
    places, cover = _sides(points, circles, [], [circle], lat, lon, radius)
    met = places.join(cover, ["level", "band", "cell"]).where(_holds(lat, lon))
    found = met.select(lat, lon, F.col(f"__{circle}").alias(circle), S.haversine_km(F.col(lat), F.col(lon), F.col("__lat"), F.col("__lon")).alias("km"))
    return points.select(key, lat, lon).join(found, [lat, lon]).select(key, circle, "km")


def at_home(points: DataFrame, homes: DataFrame, month: str = "ym", lat: str = "lat", lon: str = "lon", title: str = "title", radius: str = "radius_km") -> DataFrame:
    """The points with `home`: whether a residence that is active in the point's month has its title among its areas or
    lies within its radius. Homes (start, end, lat, lon, radius, areas) may be many; months are yyyy-MM, an open end null."""
    cell = ["level", "band", "cell"]
    own = homes.select(F.col(lat).alias("__lat"), F.col(lon).alias("__lon"), F.col(radius).alias("__km"), F.col("start").alias("__start"), F.col("end").alias("__end"))
    own = own.where(F.col("__start").isNotNull() & (F.col("__end").isNull() | (F.col("__start") <= F.col("__end"))))
    cover = written(cells_of_circles(own, "__lat", "__lon", "__km", FINER).withColumn("__whole", _holds_cell("__lat", "__lon", "__km")), "cover")
    levels = sorted(r.level for r in cover.select("level").distinct().collect())
    # the months of cells that a circle holds whole: at most one time a start, and most of these overlap
    till = F.struct(F.col("__end").isNull().alias("open"), F.col("__end").alias("end"))
    times = cover.where("__whole").groupBy(*cell, F.col("__start").alias("start")).agg(F.max(till).alias("till"))
    times = written(times.groupBy(*cell).agg(_merged(F.collect_list(F.struct("start", "till"))).alias("__times")), "times")
    asked = points.where(F.col(lat).between(-90, 90) & F.col(lon).isNotNull() & ~F.isnan(lon) & F.col(month).isNotNull()).select(lat, lon, month).distinct()
    inside = cells_of_points(asked.select(lat, lon).distinct(), levels, lat, lon).join(times, cell).groupBy(lat, lon).agg(F.flatten(F.collect_list("__times")).alias("__times"))
    held = F.exists("__times", lambda x: (F.col(month) >= x["start"]) & (x["till"]["open"] | (F.col(month) <= x["till"]["end"])))
    looked = written(asked.join(inside, [lat, lon], "left").select(lat, lon, month, F.coalesce(held, F.lit(False)).alias("__held")), "looked")
    # the rest against circles whose edge crosses the cell, if they last beyond what the whole cell has
    known = F.exists("__times", lambda x: (x["start"] <= F.col("__start")) & (x["till"]["open"] | F.coalesce(F.col("__end") <= x["till"]["end"], F.lit(False))))
    edge = cover.where("not __whole").join(times, cell, "left").where(~F.coalesce(known, F.lit(False))).drop("__times")
    rest = cells_of_points(looked.where("not __held").drop("__held"), levels, lat, lon)
    active = (F.col(month) >= F.col("__start")) & (F.col("__end").isNull() | (F.col(month) <= F.col("__end")))
    met = rest.join(edge, [*(rest[c] == edge[c] for c in cell), active, _holds(lat, lon)], "left_semi").select(lat, lon, month).distinct()
    held = looked.where("__held").select(lat, lon, month).unionByName(met).withColumn("__held", F.lit(True))
    areas = homes.select(F.explode("areas").alias("__area"), F.col("start").alias("__start"), F.col("end").alias("__end")).where(F.col("__area").isNotNull()).distinct()
    titles = points.select(title, month).where(F.col(title).isNotNull()).distinct()
    named = titles.join(areas, [F.col(title) == F.col("__area"), active], "left_semi").withColumn("__named", F.lit(True))
    out = points.join(held, [lat, lon, month], "left").join(named, [title, month], "left")
    yes = F.coalesce("__held", F.lit(False)) | F.coalesce("__named", F.lit(False))
    return out.withColumn("home", yes).select(*points.columns, "home")
