"""What a map of a library shows: points and trips of years, clusters of points, and counts beside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ranges

#: Times before this are no real ones (the year 1995).
EARLIEST = 788_918_400


def in_years(year: Column, first: int | None = None, last: int | None = None) -> Column:
    """Whether a year lies in a span; undated (null or 0) ones always do."""
    undated = F.coalesce(year, F.lit(0)) == 0
    return undated | ((year >= first) if first is not None else F.lit(True)) & ((year <= last) if last is not None else F.lit(True))


def visible_points(points: DataFrame, with_home: bool, first: int | None = None, last: int | None = None, year: str = "year", home: str = "home") -> DataFrame:
    """Points of a span of years, those at home only if asked for."""
    shown = in_years(F.col(year), first, last)
    return points.where(shown if with_home else shown & ~F.coalesce(F.col(home), F.lit(False)))


def trips_in_years(trips: DataFrame, first: int | None = None, last: int | None = None, start: str = "start_year", end: str = "end_year") -> DataFrame:
    """Trips that overlap a span of years; an open end is that of the start, and unknown years are no reason to hide."""
    until = F.coalesce(end, start)
    out = F.lit(True)
    if first is not None:
        out = out & F.coalesce(until >= first, F.lit(True))
    if last is not None:
        out = out & F.coalesce(F.col(start) <= last, F.lit(True))
    return trips.where(out)


def summary(rows: DataFrame, lat: str = "lat", year: str = "year") -> DataFrame:
    """One row (first, last, years, mappable, no_gps, total): the span and the distinct years of the points that have a
    place, how many have one, and how many have none."""
    placed = F.col(lat).isNotNull()
    own = F.when(placed & (F.col(year) > 0), F.col(year))
    return rows.agg(
        F.min(own).alias("first"), F.max(own).alias("last"), F.array_sort(F.collect_set(own)).alias("years"),
        F.count_if(placed).alias("mappable"), F.count_if(~placed).alias("no_gps"), F.count("*").alias("total"),
    )


def visits(points: DataFrame, cluster: str, ts: str, now: Column, zone: str = "UTC") -> DataFrame:
    """(cluster, visits, first, last): distinct days and first and last month of each cluster's points, by the clocks of a
    zone; times before 1995 or over a day ahead are taken for wrong, and left out."""
    real = F.col(ts).between(EARLIEST, now + 86_400)
    # the zone's clock, whatever the session's
    utc = F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(secs=F.when(real, F.col(ts)).cast("decimal(18,6)"))
    t = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    month = lambda x: F.date_format(x, "yyyy-MM")
    return points.groupBy(cluster).agg(F.count_distinct(F.to_date(t)).alias("visits"), month(F.min(t)).alias("first"), month(F.max(t)).alias("last"))


def dominant_place(points: DataFrame, cluster: str, order: Sequence[str], place: str, leaves: int = 80) -> DataFrame:
    """(cluster, place): the commonest place name among the first points of each cluster; of several, the one that was so
    first, as they are counted in order."""
    first = points.withColumn("__n", F.row_number().over(W.partitionBy(cluster).orderBy(*order))).where(F.col("__n") <= leaves)
    named = first.where(F.coalesce(place, F.lit("")) != "").groupBy(cluster, place).agg(F.count("*").alias("__c"), F.max("__n").alias("__last"))
    return named.groupBy(cluster).agg(F.min_by(place, F.struct(F.negative("__c"), "__last")).alias(place))


def name_counts(points: DataFrame, place: str) -> DataFrame:
    """(place, n, rank) of the places with a name, commonest first; names are ranked in ranges of their counts."""
    found = points.where(F.col(place).isNotNull()).groupBy(place).agg(F.count("*").alias("n"))
    ranked = ranges.running(found, [], [F.desc("n"), F.col(place)], "rank", "__of")
    return ranked.select(place, "n", F.col("rank").cast("int").alias("rank"))


def residence(points: DataFrame, key: str, homes: DataFrame, month: str = "ym", lat: str = "lat", lon: str = "lon", title: str = "title") -> DataFrame:
    """(key, home, dist): whether a residence active in a point's month has its title among its areas or lies within its
    radius, and the distance to the nearest active one; where none is active, to the one nearest in time, 0 without any.

    `homes` (start, end, lat, lon, radius_km, areas), months as yyyy-MM, is a configured list: it is checked to be short.
    """
    few = homes.select("start", "end", "lat", "lon", "radius_km", "areas").limit(1_001).collect()
    if len(few) > 1_000:
        raise ValueError("more than a thousand residences")
    number = lambda m: F.substring(m, 1, 4).try_cast("int") * 12 + F.substring(m, 6, 2).try_cast("int")
    at, now = F.col(month), number(F.col(month))
    home, dists, gaps = F.lit(False), [], []
    for r in few:
        start, end = F.lit(r["start"]), F.lit(r["end"])
        active = F.coalesce((at >= start) & (end.isNull() | (at <= end)), F.lit(False))
        km = S.haversine_km(F.col(lat), F.col(lon), F.lit(r["lat"]), F.lit(r["lon"])) if r["lat"] is not None else F.lit(None).cast("double")
        named = F.coalesce(F.array_contains(F.array(*map(F.lit, r["areas"] or [""])), F.col(title)), F.lit(False))
        home = home | (active & (named | F.coalesce(km <= r["radius_km"], F.lit(False))))
        dists.append(F.when(active, km))
        apart = F.least(F.abs(now - number(start)), F.abs(now - number(end)))
        gaps.append(F.when(km.isNotNull(), F.struct(F.coalesce(F.when(~active, apart), F.lit(0)).alias("gap"), km.alias("km"))))
    least = F.array_min(F.array(*dists)) if dists else F.lit(None).cast("double")
    near = F.array_min(F.filter(F.array(*gaps), lambda g: g.isNotNull()))["km"] if gaps else F.lit(None).cast("double")
    return points.select(key, home.alias("home"), F.coalesce(least, near, F.lit(0.0)).alias("dist"))
