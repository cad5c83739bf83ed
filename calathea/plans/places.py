"""Queries over points: the tables have none, so coordinates are made from customers' and events' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import circles, geo, greedy, mapclusters, maps
from ..registry import Tables, query

_POINTS_SQL = """WITH p AS (SELECT event_id AS id, user_id, epoch_us(ts) // 1000000 AS ts, CAST(ts AS DATE) AS day, 40 + (user_id % 7) * 0.5 + (event_id % 11) * 0.0004 AS lat, -3 - (user_id % 5) * 0.7 - (event_id % 13) * 0.0004 AS lon,
event_type AS area, value AS score FROM events)
"""
_KM = "2 * {r} * asin(least(1.0, sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"
_HOMES = [
    {"lat": 40.0, "lon": -3.0, "start": "2023-01", "end": "2024-01", "radius_km": 40},
    {"lat": 42.0, "lon": -4.0, "start": "2024-02", "end": None, "radius_km": 40},
]


def _points(t: Tables) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    return t.events.select(
        e.alias("id"), u.alias("user_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.to_date("ts").alias("day"),
        (40 + (u % 7) * 0.5 + (e % 11) * 0.0004).alias("lat"), (-3 - (u % 5) * 0.7 - (e % 13) * 0.0004).alias("lon"),
        F.col("event_type").alias("area"), F.col("value").alias("score"),
    )


@query(_POINTS_SQL + f"SELECT id, round({_KM.format(r=6371.0088, a='40.0', b='lat', c='-3.0', d='lon')}, 6) AS km, {_KM.format(r=6371.0088, a='40.0', b='lat', c='-3.0', d='lon')} <= 60 OR {_KM.format(r=6371.0088, a='42.0', b='lat', c='-4.0', d='lon')} <= 60 AS near FROM p")
def containment_points(t: Tables) -> DataFrame:
    rows = geo.near_any(_points(t), [(40.0, -3.0), (42.0, -4.0)], 60)
    return rows.select("id", F.round(S.haversine_km(F.lit(40.0), F.lit(-3.0), F.col("lat"), F.col("lon")), 6).alias("km"), "near")


@query(_POINTS_SQL + """, c AS (SELECT *, CAST(round_even(lat / (5000 / 111320.0), 0) AS BIGINT) AS cell_y, CAST(round_even(lon / (5000 / 111320.0), 0) AS BIGINT) AS cell_x, user_id % 10 = 3 AS home FROM p)
SELECT cell_y, cell_x, day, count(*) AS n FROM c GROUP BY 1, 2, 3 HAVING count(*) >= 8 AND count(*) FILTER (home) * 2 <= count(*)""")
def dense_cell_bursts(t: Tables) -> DataFrame:
    return geo.dense_cells(_points(t).withColumn("home", F.col("user_id") % 10 == 3), 5000, 8)


@query(_POINTS_SQL + """, c AS (SELECT *, CAST(round_even(lat / (400 / 111320.0), 0) AS BIGINT) AS y, CAST(round_even(lon / (400 / 111320.0), 0) AS BIGINT) AS x FROM p),
b AS (SELECT y, x, count(DISTINCT day) AS days, avg(lat) AS lat, avg(lon) AS lon FROM c GROUP BY 1, 2 ORDER BY days DESC, y, x LIMIT 1)
SELECT round(b.lat, 6) AS lat, round(b.lon, 6) AS lon, days, (SELECT area FROM c WHERE c.y = b.y AND c.x = b.x GROUP BY area ORDER BY count(*) DESC, area LIMIT 1) AS area FROM b""")
def home_model(t: Tables) -> DataFrame:
    return geo.home_model(_points(t)).select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "days", "area")


@query(_POINTS_SQL + f""", h AS (SELECT *, CASE WHEN strftime(day, '%Y-%m') BETWEEN '2023-01' AND '2024-01' THEN {_KM.format(r=6371.0088, a='lat', b='40.0', c='lon', d='-3.0')} END AS d1,
CASE WHEN strftime(day, '%Y-%m') >= '2024-02' THEN {_KM.format(r=6371.0088, a='lat', b='42.0', c='lon', d='-4.0')} END AS d2 FROM p)
SELECT id, coalesce(d1 <= 40, false) OR coalesce(d2 <= 40, false) AS home, round(least(d1, d2), 6) AS dist FROM h""")
def residence_distance(t: Tables) -> DataFrame:
    rows = geo.home_distance(_points(t).withColumn("ym", F.date_format("day", "yyyy-MM")), _HOMES)
    return rows.select("id", "home", F.round("dist", 6).alias("dist"))


@query(_POINTS_SQL + f""", a AS (SELECT * FROM (SELECT *, {_KM.format(r=6371.0088, a='lat', b='40.0', c='lon', d='-3.0')} AS dist FROM p) WHERE dist > 60),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= 43200 THEN 0 ELSE 1 END AS new FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)),
c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS trip FROM g),
k AS (SELECT user_id, trip, area, row_number() OVER (PARTITION BY user_id, trip ORDER BY count(*) DESC, area) AS r FROM c GROUP BY 1, 2, 3),
s AS (SELECT user_id, trip, count(*) AS frames, count(DISTINCT ts // 86400) AS days, min(ts) AS start, max(ts) AS "end", round(avg(lat), 6) AS lat FROM c GROUP BY 1, 2 HAVING count(*) >= 3),
b AS (SELECT user_id, trip, id AS hero FROM (SELECT *, row_number() OVER (PARTITION BY user_id, trip ORDER BY score DESC NULLS LAST, id) AS r FROM c) WHERE r = 1)
SELECT s.user_id, CAST(s.trip AS BIGINT) AS trip, frames, days, start, "end", lat, hero, area AS title FROM s JOIN k ON k.user_id = s.user_id AND k.trip = s.trip AND k.r = 1 JOIN b ON b.user_id = s.user_id AND b.trip = s.trip""")
def trips(t: Tables) -> DataFrame:
    rows = _points(t).withColumn("dist", S.haversine_km(F.col("lat"), F.col("lon"), F.lit(40.0), F.lit(-3.0)))
    found = geo.trips(rows, ["user_id"], "ts", "dist", 60, 43200, 3, title="area")
    return found.select("user_id", "trip", "frames", "days", "start", "end", F.round("lat", 6).alias("lat"), "hero", "title")


@query(_POINTS_SQL + """, g AS (SELECT *, CASE WHEN area IS NOT DISTINCT FROM lag(area) OVER w AND lag(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)),
c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM g),
m AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, id) - 1 AS i, count(*) OVER (PARTITION BY user_id, run) AS n FROM c)
SELECT user_id, CAST(run AS BIGINT) AS run, min(area) AS area, count(*) AS n, max(CASE WHEN i = n // 2 THEN ts END) AS middle FROM m GROUP BY 1, 2""")
def place_stops(t: Tables) -> DataFrame:
    return geo.stops(_points(t), ["user_id"], ["ts", "id"], "area", "ts")


@query(_POINTS_SQL + f"SELECT id, CASE WHEN {_KM.format(r=6371.0088, a='lat', b='40.0', c='lon', d='-3.0')} > 60 THEN round(lat, 6)::DOUBLE END AS lat FROM p")
def masked_points(t: Tables) -> DataFrame:
    return geo.masked(_points(t), [(40.0, -3.0)], 60).select("id", F.round("lat", 6).alias("lat"))


@query()
def greedy_merge(t: Tables) -> DataFrame:
    cells = _points(t).groupBy("user_id", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon")).agg(F.count("*").alias("n"))
    return greedy.place_clusters(cells, "user_id")


@query("""WITH c AS (SELECT c_custkey AS k, 40 + (c_custkey % 97) * 0.11 AS lat, -3 + (c_custkey % 89) * 0.13 AS lon FROM customer), s AS (SELECT s_suppkey AS p, 38 + (s_suppkey % 13) * 1.1 AS lat, -5 + (s_suppkey % 17) * 0.9 AS lon FROM supplier),
j AS (SELECT k, p, """ + _KM.format(r=6371.0088, a="c.lat", b="s.lat", c="c.lon", d="s.lon") + """ AS km FROM c, s)
SELECT k, arg_min(p, (round(km, 6), p)) AS p, round(min(km), 6) AS km FROM j GROUP BY k""")  # fmt: skip
def nearest_place(t: Tables) -> DataFrame:
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    points = t.customer.select(c.alias("k"), (40 + (c % 97) * 0.11).alias("lat"), (-3 + (c % 89) * 0.13).alias("lon"))
    spots = t.supplier.select(s.alias("p"), (38 + (s % 13) * 1.1).alias("lat"), (-5 + (s % 17) * 0.9).alias("lon"))
    return geo.nearest_place(points, "k", spots, "p").select("k", "p", F.round("km", 6).alias("km"))


_CIRCLES_SQL = """WITH c AS (SELECT c_custkey AS k, -90 + (c_custkey * 37 % 1801) * 0.1::DOUBLE AS lat, -180 + (c_custkey * 101 % 3601) * 0.1::DOUBLE AS lon FROM customer),
s AS (SELECT s_suppkey AS p, -90 + (s_suppkey * 53 % 181)::DOUBLE AS lat, -180 + (s_suppkey * 89 % 361)::DOUBLE AS lon, 5 + (s_suppkey % 6) * (s_suppkey % 6) * 40::DOUBLE AS radius_km FROM supplier),
j AS (SELECT k, p, km FROM (SELECT k, p, radius_km, """ + _KM.format(r=6371.0088, a="c.lat", b="s.lat", c="c.lon", d="s.lon") + """ AS km FROM c, s) WHERE km <= radius_km)
"""  # fmt: skip


def _world(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Points and circles over the whole globe, poles and the 180th meridian included."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    points = t.customer.select(c.alias("k"), (F.lit(-90) + (c * 37 % 1801) * 0.1).alias("lat"), (F.lit(-180) + (c * 101 % 3601) * 0.1).alias("lon"))
    radius = (F.lit(5) + (s % 6) * (s % 6) * 40).cast("double")
    return points, t.supplier.select(s.alias("p"), (F.lit(-90) + s * 53 % 181).cast("double").alias("lat"), (F.lit(-180) + s * 89 % 361).cast("double").alias("lon"), radius.alias("radius_km"))


@query(_CIRCLES_SQL + "SELECT k, k IN (SELECT k FROM j) AS near FROM c")
def circle_containment(t: Tables) -> DataFrame:
    return circles.in_any(*_world(t)).select("k", "near")


@query(_CIRCLES_SQL + "SELECT k, p, round(km, 6) AS km FROM j")
def circle_pairs(t: Tables) -> DataFrame:
    points, spots = _world(t)
    return circles.pairs(points, "k", spots, "p").select("k", "p", F.round("km", 6).alias("km"))


_RESIDENCES_SQL = """WITH p AS (SELECT o_orderkey AS k, -90 + (o_custkey * 37 % 1801) * 0.1::DOUBLE AS lat, -180 + (o_custkey * 101 % 3601) * 0.1::DOUBLE AS lon, strftime(o_orderdate, '%Y-%m') AS ym, 'area ' || (o_custkey % 900) AS title FROM orders),
h AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 11 > 0 THEN -90 + (s_suppkey * 53 % 181)::DOUBLE END AS lat, -180 + (s_suppkey * 89 % 361)::DOUBLE AS lon, 5 + (s_suppkey % 6) * (s_suppkey % 6) * 40::DOUBLE AS radius_km,
  (1992 + s_suppkey % 5) || '-0' || (1 + s_suppkey % 9) AS start, CASE WHEN s_suppkey % 3 > 0 THEN (1995 + s_suppkey % 4) || '-06' END AS stop, 'area ' || (s_suppkey * 7 % 1000) AS area FROM supplier)
SELECT k, coalesce(bool_or(ym >= start AND (stop IS NULL OR ym <= stop) AND (title = area OR coalesce(""" + _KM.format(r=6371.0088, a="p.lat", b="h.lat", c="p.lon", d="h.lon") + """ <= radius_km, false))), false) AS home FROM p, h GROUP BY k"""  # fmt: skip


@query(_RESIDENCES_SQL)
def at_home_of_many(t: Tables) -> DataFrame:
    """Whether an order's place or title is that of a residence of its month, with as many residences as suppliers."""
    c, s = F.col("o_custkey"), F.col("s_suppkey")
    points = t.orders.select(F.col("o_orderkey").alias("k"), (F.lit(-90) + (c * 37 % 1801) * 0.1).alias("lat"), (F.lit(-180) + (c * 101 % 3601) * 0.1).alias("lon"), F.date_format("o_orderdate", "yyyy-MM").alias("ym"), F.concat(F.lit("area "), (c % 900).cast("string")).alias("title"))
    homes = _world(t)[1].withColumnRenamed("p", "s_suppkey").withColumn("lat", F.when(s % 11 > 0, F.col("lat")))
    start = F.concat((F.lit(1992) + s % 5).cast("string"), F.lit("-0"), (F.lit(1) + s % 9).cast("string"))
    end = F.when(s % 3 > 0, F.concat((F.lit(1995) + s % 4).cast("string"), F.lit("-06")))
    homes = homes.select("lat", "lon", "radius_km", start.alias("start"), end.alias("end"), F.array(F.concat(F.lit("area "), (s * 7 % 1000).cast("string"))).alias("areas"))
    return circles.at_home(points, homes).select("k", "home")


@query("""WITH p AS (SELECT c_custkey AS k, -60 + (c_custkey % 121)::DOUBLE AS lat, (c_custkey % 90)::DOUBLE AS lon, (1990 + c_custkey % 12) || '-' || lpad((1 + c_custkey % 12)::VARCHAR, 2, '0') AS ym, 'n' || (c_custkey % 40) AS title FROM customer),
h AS (SELECT n_nationkey AS n, -60 + n_nationkey * 5::DOUBLE AS lat, n_nationkey * 3::DOUBLE AS lon, 300::DOUBLE AS radius_km, (1991 + n_nationkey % 6) || '-03' AS start, CASE WHEN n_nationkey % 4 > 0 THEN (1994 + n_nationkey % 5) || '-10' END AS stop, 'n' || n_nationkey AS area FROM nation),
j AS (SELECT k, ym, title, area, radius_km, start, stop, ym >= start AND (stop IS NULL OR ym <= stop) AS active, """ + _KM.format(r=6371.0088, a="p.lat", b="h.lat", c="p.lon", d="h.lon") + """ AS km,
  ym[1:4]::INT * 12 + ym[6:7]::INT AS now, start[1:4]::INT * 12 + start[6:7]::INT AS a, stop[1:4]::INT * 12 + stop[6:7]::INT AS b FROM p, h)
SELECT k, bool_or(active AND (title = area OR km <= radius_km)) AS home, round(coalesce(min(km) FILTER (active), arg_min(km, (least(abs(now - a), abs(now - b)), km))), 6) AS dist FROM j GROUP BY k""")  # fmt: skip
def residence_nearest(t: Tables) -> DataFrame:
    """Home and distance for a short configured list of residences, one a nation."""
    c, n = F.col("c_custkey"), F.col("n_nationkey")
    points = t.customer.select(c.alias("k"), (F.lit(-60) + c % 121).cast("double").alias("lat"), (c % 90).cast("double").alias("lon"), F.concat((F.lit(1990) + c % 12).cast("string"), F.lit("-"), F.lpad((F.lit(1) + c % 12).cast("string"), 2, "0")).alias("ym"), F.concat(F.lit("n"), (c % 40).cast("string")).alias("title"))
    start, end = F.concat((F.lit(1991) + n % 6).cast("string"), F.lit("-03")), F.when(n % 4 > 0, F.concat((F.lit(1994) + n % 5).cast("string"), F.lit("-10")))
    homes = t.nation.select((F.lit(-60.0) + n * 5).alias("lat"), (n * 3).cast("double").alias("lon"), F.lit(300.0).alias("radius_km"), start.alias("start"), end.alias("end"), F.array(F.concat(F.lit("n"), n.cast("string"))).alias("areas"))
    return maps.residence(points, "k", homes).select("k", "home", F.round("dist", 6).alias("dist"))


@query()
def map_clusters(t: Tables) -> DataFrame:
    """Clusters of the customers' and suppliers' places over four zooms, each with the one that holds it."""
    customers, suppliers = _world(t)
    points = customers.unionByName(suppliers.select((F.lit(10**12) + F.col("p")).alias("k"), "lat", "lon"))
    found = mapclusters.pyramid(points, "k", 1, 4)
    return found.withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


@query(_POINTS_SQL + f""", r AS (SELECT *, CAST(round_even(lat / (400 / 111320.0), 0) AS BIGINT) AS y, CAST(round_even(lon / (400 / 111320.0), 0) AS BIGINT) AS x FROM p ORDER BY id DESC LIMIT 8000),
h AS (SELECT avg(lat) AS hlat, avg(lon) AS hlon, count(DISTINCT day) AS days FROM r GROUP BY y, x ORDER BY count(DISTINCT day) DESC, y, x LIMIT 1),
a AS (SELECT area || (user_id % 5) AS area, count(*) AS n, count(DISTINCT day) AS d, avg(lat) AS alat, avg(lon) AS alon FROM r GROUP BY 1),
m AS (SELECT area FROM a ORDER BY n DESC, area LIMIT 1),
s AS (SELECT area FROM a, h WHERE d >= 3 AND {_KM.format(r=6371.0088, a='hlat', b='alat', c='hlon', d='alon')} <= 150 UNION SELECT area FROM m)
SELECT round(hlat, 6) AS lat, round(hlon, 6) AS lon, days, (SELECT area FROM m) AS area, (SELECT string_agg(area, ',' ORDER BY area) FROM s) AS suburbs FROM h""")
def home_suburbs(t: Tables) -> DataFrame:
    rows = _points(t).withColumn("area", F.concat("area", (F.col("user_id") % 5).cast("string")))
    found = geo.home_and_suburbs(rows, "id", near_km=150)
    return found.select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "days", "area", F.array_join("suburbs", ",").alias("suburbs"))
