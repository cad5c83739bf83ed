"""Queries of matching by size, map views, cluster tables, writes and views, and of scalars, over stand-ins made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import unknown
from ..operators import assets, evaluation, maps, matching, monitor, mutation, vectors
from ..registry import Tables, query

_SIZED = """WITH a AS (SELECT event_id AS asset, 'img_' || (user_id % 97) || CASE WHEN event_id % 11 = 0 THEN '-' || (event_id % 7) ELSE '' END || CASE WHEN event_id % 13 = 0 THEN '_hevc.mov' ELSE '.jpg' END AS name,
  event_id % 7 AS size, CASE WHEN event_id % 5 <> 0 THEN CAST(epoch(ts) AS BIGINT) // 60 END AS tm, event_id % 13 = 0 AS is_clip FROM events WHERE event_type = 'click'),
b AS (SELECT event_id AS record, 'img_' || (user_id % 97) || '.jpg' AS name, 'img_' || (user_id % 97) AS base, event_id % 7 AS size, CAST(epoch(ts) AS BIGINT) // 60 AS tm FROM events WHERE event_type = 'signup' AND user_id % 97 <> 5),
o AS (SELECT *, count(*) OVER (PARTITION BY name) AS na, EXISTS (SELECT 1 FROM b WHERE b.name = a.name) AS own FROM a),
l AS (SELECT asset, size, tm, is_clip, na, own, name AS raw, CASE WHEN own OR regexp_extract(name, '-([0-9]+)([.][^.]+)$', 1) <> CAST(size AS VARCHAR) THEN name ELSE regexp_replace(name, '-[0-9]+([.][^.]+)$', '\\1') END AS name FROM o),
j AS (SELECT l.asset, b.record, l.size = b.size AS same, abs(l.tm - b.tm) AS gap FROM l JOIN b ON l.name = b.name),
s AS (SELECT asset, count(*) AS nr, min(record) AS lone, count(*) FILTER (same) AS ns, min(record) FILTER (same) AS sized, arg_min(record, (gap, record)) FILTER (gap IS NOT NULL) AS dated, min(gap) AS gap,
  arg_min(record, (gap, record)) FILTER (same AND gap IS NOT NULL) AS best, min(gap) FILTER (same) AS same_gap FROM j GROUP BY 1),
c AS (SELECT l.asset, CASE WHEN count(*) FILTER (l.size = b.size) = 1 THEN min(b.record) FILTER (l.size = b.size) ELSE arg_min(b.record, (abs(l.tm - b.tm), b.record)) FILTER (l.tm IS NOT NULL) END AS clip
  FROM l JOIN b ON b.base = regexp_replace(regexp_replace(l.raw, '[.][^.]+$', ''), '_hevc$', '') WHERE is_clip GROUP BY 1),
x AS (SELECT l.*, s.* EXCLUDE (asset), c.clip FROM l LEFT JOIN s USING (asset) LEFT JOIN c USING (asset)),
y AS (SELECT *, CASE WHEN gap <= 2 THEN 'date' WHEN ns = 1 THEN CASE WHEN nr > 1 THEN 'size' ELSE 'only_size' END WHEN gap <= 90000 THEN 'date_tz' WHEN own AND nr = 1 AND na = 1 THEN 'unique'
  WHEN nr = 1 AND tm IS NULL THEN 'only' WHEN nr IS NULL AND clip IS NOT NULL THEN 'clip' END AS tier FROM x)
"""


def _sized(t: Tables) -> DataFrame:
    e, at = F.col("event_id"), (S.nearest_second(F.col("ts")) / 60).cast("long")
    base = F.concat(F.lit("img_"), (F.col("user_id") % 97).cast("string"))
    suffix = F.when(e % 11 == 0, F.concat(F.lit("-"), (e % 7).cast("string"))).otherwise("")
    name = F.concat(base, suffix, F.when(e % 13 == 0, "_hevc.mov").otherwise(".jpg"))
    a = t.events.where("event_type = 'click'").select(e.alias("asset"), name.alias("name"), (e % 7).alias("size"), F.when(e % 5 != 0, at).alias("at"), (e % 13 == 0).alias("is_clip"))
    b = t.events.where("event_type = 'signup' and user_id % 97 <> 5").select(e.alias("record"), F.concat(base, F.lit(".jpg")).alias("name"), base.alias("base"), (e % 7).alias("size"), at.alias("at"))
    return matching.sized(a, b)


@query(_SIZED + """SELECT asset, CASE WHEN tier = 'date' THEN CASE WHEN same_gap <= 2 THEN best ELSE dated END WHEN tier IN ('size', 'only_size') THEN sized WHEN tier = 'date_tz' THEN dated WHEN tier = 'clip' THEN clip WHEN tier IS NOT NULL THEN lone END AS record,
tier, CASE tier WHEN 'date' THEN 1.0 WHEN 'only_size' THEN 0.97 WHEN 'size' THEN 0.96 WHEN 'date_tz' THEN 0.95 WHEN 'unique' THEN 0.85 WHEN 'clip' THEN 0.8 WHEN 'only' THEN 0.6 END::DOUBLE AS confidence FROM y WHERE nr IS NOT NULL OR tier IS NOT NULL""")
def sized_match(t: Tables) -> DataFrame:
    return _sized(t)


@query(_SIZED + "SELECT tier, count(*) AS n FROM y WHERE nr IS NOT NULL OR tier IS NOT NULL GROUP BY tier")
def match_methods(t: Tables) -> DataFrame:
    return matching.method_counts(_sized(t))


@query("""WITH m AS (SELECT (event_id * 7919 + user_id) % 1999 AS uuid, event_id AS asset, event_id % 3 > 0 AS is_clip, CASE WHEN event_id % 2 = 0 THEN 'video' ELSE 'image' END AS kind FROM events),
w AS (SELECT c_custkey AS uuid, CASE WHEN c_custkey % 2 = 0 THEN 'image' ELSE 'video' END AS kind FROM customer),
g AS (SELECT w.uuid, count(asset) AS n, min(asset) AS one, count(*) FILTER (NOT is_clip) AS stills, min(asset) FILTER (NOT is_clip) AS still, count(*) FILTER (NOT is_clip AND m.kind = w.kind) AS fits, min(asset) FILTER (NOT is_clip AND m.kind = w.kind) AS fit FROM w LEFT JOIN m USING (uuid) GROUP BY w.uuid),
r AS (SELECT *, CASE WHEN n = 1 THEN one WHEN stills = 1 THEN still WHEN stills > 1 AND fits = 1 THEN fit END AS asset FROM g)
SELECT uuid, asset, CASE WHEN n = 0 THEN 'unresolved' WHEN asset IS NOT NULL THEN NULL WHEN stills > 1 THEN 'several stills' ELSE 'no still' END AS reason FROM r""")
def single_asset(t: Tables) -> DataFrame:
    e = F.col("event_id")
    rows = t.events.select(((e * 7919 + F.col("user_id")) % 1999).alias("uuid"), e.alias("asset"), (e % 3 > 0).alias("is_clip"), F.when(e % 2 == 0, "video").otherwise("image").alias("kind"))
    wanted = t.customer.select(F.col("c_custkey").alias("uuid"), F.when(F.col("c_custkey") % 2 == 0, "image").otherwise("video").alias("kind"))
    return matching.single_asset(rows, rows.select("asset", "is_clip", "kind"), wanted)


@query("""WITH r AS (SELECT o_orderkey AS record, 'c' || (o_custkey % 199) AS stem, CASE WHEN o_orderkey % 2 = 0 THEN 'mov' ELSE 'mp4' END AS ext, o_orderkey % 23 AS size, o_orderkey % 61 AS tm, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 5 END AS duration FROM orders WHERE o_orderstatus = 'P'),
a AS (SELECT c_custkey AS asset, 'c' || (c_custkey % 199) AS stem, CASE WHEN c_custkey % 2 = 0 THEN 'mov' ELSE 'mp4' END AS ext, c_custkey % 23 AS size, c_custkey % 61 AS tm, c_custkey % 5 AS duration FROM customer),
p AS (SELECT r.record, a.asset, r.size = a.size AS same, r.size = a.size AND r.tm = a.tm AND (r.duration IS NULL OR abs(r.duration - a.duration) < 1) AS whole FROM r JOIN a ON (r.stem = a.stem AND r.ext = a.ext) OR (r.size = a.size AND r.tm = a.tm)),
g AS (SELECT r.record, count(asset) AS candidates, min(asset) AS one, count(*) FILTER (same) AS ns, min(asset) FILTER (same) AS sized, count(*) FILTER (whole) AS nf, min(asset) FILTER (whole) AS entire FROM r LEFT JOIN p USING (record) GROUP BY 1)
SELECT record, CASE WHEN ns = 1 THEN sized WHEN nf = 1 THEN entire WHEN candidates = 1 THEN one END AS asset, CASE WHEN candidates = 0 THEN 'NO_MATCH' WHEN ns = 1 OR nf = 1 THEN 'OK' WHEN candidates = 1 AND ns = 0 THEN 'SIZE_MISMATCH' ELSE 'AMBIGUOUS' END AS status, candidates FROM g""")
def found_elsewhere(t: Tables) -> DataFrame:
    def own(k: str, name: str, more: str, duration) -> list:  # noqa: ANN001
        key = F.col(k)
        return [key.alias(name), F.concat(F.lit("c"), (F.col(more) % 199).cast("string")).alias("stem"), F.when(key % 2 == 0, "mov").otherwise("mp4").alias("ext"), (key % 23).alias("size"), (key % 61).alias("at"), duration.alias("duration")]

    o, c = F.col("o_orderkey"), F.col("c_custkey")
    records = t.orders.where("o_orderstatus = 'P'").select(own("o_orderkey", "record", "o_custkey", F.when(o % 3 > 0, o % 5)))
    return matching.elsewhere(records, t.customer.select(own("c_custkey", "asset", "c_custkey", c % 5)))


_FOLDERS = """WITH a AS (SELECT event_id AS asset, user_id % 20 AS folder, (user_id % 9) || CASE WHEN event_id % 4 = 0 THEN '_hevc' ELSE '' END AS stem, CASE WHEN event_type = 'view' THEN 'HEIC' WHEN event_type = 'purchase' THEN 'MOV' ELSE 'JPG' END AS ext FROM events),
c AS (SELECT folder, stem, max(asset) AS clip FROM (SELECT folder, asset, unnest([stem, regexp_replace(stem, '_hevc$', '')]) AS stem FROM a WHERE ext = 'MOV') GROUP BY 1, 2),
p AS (SELECT a.asset AS still, clip FROM a JOIN c USING (folder, stem) WHERE ext = 'HEIC')
"""


def _folders(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = F.col("event_id")
    stem = F.concat((F.col("user_id") % 9).cast("string"), F.when(e % 4 == 0, "_hevc").otherwise(""))
    ext = F.when(F.col("event_type") == "view", "HEIC").when(F.col("event_type") == "purchase", "MOV").otherwise("JPG")
    rows = t.events.select(e.alias("asset"), (F.col("user_id") % 20).alias("folder"), stem.alias("stem"), ext.alias("ext"))
    return rows, matching.by_folder(rows)


@query(_FOLDERS + "SELECT still, clip FROM p")
def folder_pairs(t: Tables) -> DataFrame:
    return _folders(t)[1]


@query(_FOLDERS + "SELECT asset FROM a WHERE ext = 'MOV' AND asset NOT IN (SELECT clip FROM p)")
def clip_orphans(t: Tables) -> DataFrame:
    rows, pairs = _folders(t)
    return rows.where("ext = 'MOV'").join(pairs.select(F.col("clip").alias("asset")), "asset", "left_anti").select("asset")


@query(_FOLDERS + """SELECT asset, s.still IS NOT NULL AS is_still, c.clip IS NOT NULL AS is_clip, CAST(coalesce(s.clip, c.still) AS BIGINT) AS partner FROM a
LEFT JOIN (SELECT still, min(clip) AS clip FROM p GROUP BY 1) s ON s.still = asset LEFT JOIN (SELECT clip, min(still) AS still FROM p GROUP BY 1) c ON c.clip = asset""")
def live_flags(t: Tables) -> DataFrame:
    rows, pairs = _folders(t)
    return mutation.paired_anew(rows.select("asset", F.lit(True).alias("is_still")), pairs)


@query("SELECT DISTINCT o_orderkey AS asset, p_brand AS fact FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size < 10")
def inherited_facts(t: Tables) -> DataFrame:
    bridge = t.lineitem.select(F.col("l_partkey").alias("uuid"), F.col("l_orderkey").alias("asset"))
    return matching.inherited(bridge, t.part.where("p_size < 10").select(F.col("p_partkey").alias("uuid"), F.col("p_brand").alias("fact")))


@query("""WITH p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b, l_partkey % 7 AS w FROM lineitem), j AS (SELECT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_quantity > 25)
SELECT a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM j WHERE (j.a = p.a AND j.b = p.b) OR (j.a = p.b AND j.b = p.a))""")
def pairs_to_judge(t: Tables) -> DataFrame:
    pairs = t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_partkey") % 7).alias("w")).distinct()
    judged = t.lineitem.where("l_quantity > 25").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    return matching.unjudged(pairs, judged, "a", "b", "w", 1).select("a", "b")


_MAP = """WITH p AS (SELECT event_id AS id, user_id % 50 AS cluster, CASE WHEN event_id % 9 <> 0 THEN 2014 + CAST(event_id % 11 AS INTEGER) END AS year, event_id % 4 = 0 AS home, CASE WHEN event_id % 6 > 0 THEN event_id * 1.0 END AS lat,
CASE WHEN event_id % 17 = 0 THEN 5 WHEN event_id % 19 = 0 THEN 99999999999 ELSE CAST(epoch(ts) AS BIGINT) END AS tm, CASE WHEN event_id % 8 > 0 THEN event_type END AS place FROM events)
"""


def _map(t: Tables) -> DataFrame:
    e = F.col("event_id")
    at = F.when(e % 17 == 0, 5).when(e % 19 == 0, 99_999_999_999).otherwise(S.nearest_second(F.col("ts")))
    return t.events.select(e.alias("id"), (F.col("user_id") % 50).alias("cluster"), F.when(e % 9 != 0, (2014 + e % 11).cast("int")).alias("year"), (e % 4 == 0).alias("home"), F.when(e % 6 > 0, e * 1.0).alias("lat"), at.alias("at"), F.when(e % 8 > 0, F.col("event_type")).alias("place"))


@query(_MAP + "SELECT id FROM p WHERE (year IS NULL OR year BETWEEN 2017 AND 2020) AND NOT home")
def map_points(t: Tables) -> DataFrame:
    return maps.visible_points(_map(t), False, 2017, 2020).select("id")


@query(_MAP + """SELECT min(year) FILTER (lat IS NOT NULL) AS first, max(year) FILTER (lat IS NOT NULL) AS last, list_aggregate(list_sort(list(DISTINCT year) FILTER (lat IS NOT NULL AND year IS NOT NULL)), 'string_agg', ',') AS years,
count(lat) AS mappable, count(*) - count(lat) AS no_gps, count(*) AS total FROM p""")
def map_meta(t: Tables) -> DataFrame:
    return maps.summary(_map(t)).withColumn("years", F.array_join(F.col("years").cast("array<string>"), ","))


@query(_MAP + """, d AS (SELECT *, CASE WHEN tm BETWEEN 788918400 AND 1893456000 + 86400 THEN tm END AS t FROM p)
SELECT cluster, count(DISTINCT (t + 19800) // 86400) AS visits, strftime(to_timestamp(min(t + 19800)) AT TIME ZONE 'UTC', '%Y-%m') AS first, strftime(to_timestamp(max(t + 19800)) AT TIME ZONE 'UTC', '%Y-%m') AS last FROM d GROUP BY cluster""")
def cluster_visits(t: Tables) -> DataFrame:
    return maps.visits(_map(t), "cluster", "at", F.lit(1_893_456_000), "Asia/Kolkata")


@query(_MAP + """, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY id) AS n FROM p) WHERE n <= 80 AND place IS NOT NULL),
c AS (SELECT cluster, place, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, max(n)) AS r FROM f GROUP BY 1, 2) SELECT cluster, place FROM c WHERE r = 1""")
def dominant_places(t: Tables) -> DataFrame:
    return maps.dominant_place(_map(t), "cluster", ["id"], "place")


@query(_MAP + "SELECT place, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, place) AS INTEGER) AS rank FROM p WHERE place IS NOT NULL GROUP BY place")
def place_names(t: Tables) -> DataFrame:
    return maps.name_counts(_map(t), "place")


@query("""WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS s, CASE WHEN o_orderkey % 3 = 0 THEN CAST(year(o_orderdate) AS INTEGER) + 1 END AS e FROM orders)
SELECT id FROM t WHERE coalesce(coalesce(e, s) >= 1994, true) AND coalesce(s <= 1996, true)""")
def trips_of_years(t: Tables) -> DataFrame:
    o, y = F.col("o_orderkey"), F.year("o_orderdate")
    rows = t.orders.select(o.alias("id"), F.when(o % 5 > 0, y).alias("start_year"), F.when(o % 3 == 0, y + 1).alias("end_year"))
    return maps.trips_in_years(rows, 1994, 1996).select("id")


_DOT = "list_dot_product({a}, {b})"
_CLUSTERS = f"""WITH v AS (SELECT vec_id, label AS cluster, vec_id % 40 AS asset, CASE WHEN vec_id % 6 > 0 THEN vec_id * 9000 END AS ts, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
x AS (SELECT cluster, i, avg(e[i]) AS x FROM v, unnest(range(1, 65)) AS r(i) GROUP BY 1, 2), c0 AS (SELECT cluster, list(x ORDER BY i) AS c FROM x GROUP BY 1),
c AS (SELECT cluster, list_transform(c, lambda z: z / sqrt(list_dot_product(c, c))) AS c FROM c0),
n AS (SELECT vec_id, cluster, {_DOT.format(a="v.e", b="c.c")} AS cos FROM v JOIN c USING (cluster))
"""


def _faces(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    return t.embeddings.select(v.alias("vec_id"), F.col("label").alias("cluster"), (v % 40).alias("asset"), F.when(v % 6 > 0, v * 9000).alias("ts"), "embedding")


@query(_CLUSTERS + """, s AS (SELECT cluster, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY r) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cos DESC, vec_id) AS r FROM n) WHERE r <= 4 GROUP BY 1)
SELECT cluster, count(*) AS size, count(DISTINCT asset) AS assets, count(DISTINCT ts // 86400) AS days, CAST(DATE '1970-01-01' + CAST(min(ts // 86400) AS INTEGER) AS DATE) AS first, CAST(DATE '1970-01-01' + CAST(max(ts // 86400) AS INTEGER) AS DATE) AS last, any_value(shown) AS shown FROM v JOIN s USING (cluster) GROUP BY cluster HAVING count(*) >= 2""")
def cluster_table(t: Tables) -> DataFrame:
    found, _ = vectors.cluster_table(_faces(t), "cluster", "vec_id", "embedding", "asset", "ts")
    return found.withColumn("shown", F.array_join(F.col("shown").cast("array<string>"), ",")).drop("centroid")


@query(_CLUSTERS + f""", f AS (SELECT vec_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cos DESC, vec_id) AS r FROM n) WHERE r <= 60),
m0 AS (SELECT cluster, list(x ORDER BY i) AS c FROM (SELECT f.cluster, i, avg(e[i]) AS x FROM f JOIN v USING (vec_id), unnest(range(1, 65)) AS r(i) GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT cluster, list_transform(c, lambda z: z / sqrt(list_dot_product(c, c))) AS c FROM m0),
p AS (SELECT m.cluster, c.cluster AS person, {_DOT.format(a="m.c", b="c.c")} AS score FROM m, c WHERE c.cluster % 2 = 0)
SELECT cluster, person, round(score, 9) AS score, score >= 0.45 AS confident FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, person) AS r FROM p) WHERE r = 1""")
def cluster_persons(t: Tables) -> DataFrame:
    rows = _faces(t)
    table, near = vectors.cluster_table(rows, "cluster", "vec_id", "embedding", "asset", "ts")
    members = near.join(rows.select("vec_id", "embedding"), "vec_id")
    persons = table.where(F.col("cluster") % 2 == 0).select(F.col("cluster").alias("person"), "centroid")
    found = vectors.nearest_person(members, "cluster", "vec_id", "embedding", "cos", persons, "person")
    return found.withColumn("score", F.round("score", 9))


@query(_CLUSTERS + "SELECT vec_id FROM n WHERE cos >= 0.5 AND cos < 0.6")
def uncertain_band(t: Tables) -> DataFrame:
    _, near = vectors.cluster_table(_faces(t), "cluster", "vec_id", "embedding", "asset", "ts")
    return near.where(vectors.uncertain(F.col("cos"))).select("vec_id")


@query("""SELECT count(*) AS n, round(max(abs(l_discount - l_tax)), 9)::DOUBLE AS max_abs, round(avg(abs(l_discount - l_tax)), 9)::DOUBLE AS mean_abs FROM lineitem""")
def model_faithfulness(t: Tables) -> DataFrame:
    found = evaluation.faithfulness(t.lineitem.select(F.col("l_discount").cast("double").alias("a"), F.col("l_tax").cast("double").alias("b")), "a", "b")
    return found.select("n", F.round("max_abs", 9).alias("max_abs"), F.round("mean_abs", 9).alias("mean_abs"))


@query("""WITH d AS (SELECT doc_id, sha256(text) AS digest, CASE WHEN doc_id % 4 > 0 THEN doc_id END AS ts, CASE WHEN doc_id % 3 = 0 THEN '/a/2020/05/x' ELSE '/a/x' END AS path FROM documents)
SELECT doc_id, CAST(keep_rank AS INTEGER) AS keep_rank FROM (SELECT doc_id, count(*) OVER (PARTITION BY digest) AS n, row_number() OVER (PARTITION BY digest ORDER BY ts IS NULL, NOT regexp_matches(path, '/[0-9]{4}/[0-9]{2}/'), doc_id) AS keep_rank FROM d) WHERE n > 1""")
def copies_ranked(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"), F.when(d % 4 > 0, d).alias("ts"), F.when(d % 3 == 0, "/a/2020/05/x").otherwise("/a/x").alias("path"))
    return assets.copies(rows, "digest", "ts", "path", "doc_id").select("doc_id", "keep_rank")


@query("""SELECT event_id, event_id % 7 = 0 OR starts_with(event_type || event_id, 'click1') AS shared, CASE WHEN event_id % 5 = 0 THEN 'timeout' WHEN event_type IN ('view', 'click') THEN 'storage' ELSE 'file' END AS fault,
regexp_matches(a, '^(127[.]|10[.]|100[.](6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])[.]|192[.]168[.]|172[.](1[6-9]|2[0-9]|3[01])[.]|::1$)') AS private FROM (SELECT *, (event_id % 256) || '.' || (event_id % 200) || '.1.1' AS a FROM events)""")
def event_flags(t: Tables) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    name = F.regexp_replace(F.concat(kind, e.cast("string")), "^click1", "od_")
    message = F.when(kind == "view", "read: [Errno 5] failed").when(kind == "click", "the disk does not respond").otherwise("bad header")
    address = F.concat_ws(".", (e % 256).cast("string"), (e % 200).cast("string"), F.lit("1"), F.lit("1"))
    return t.events.select("event_id", assets.shared_item(e % 7 == 0, name).alias("shared"), monitor.fault_class(message, e % 5 == 0).alias("fault"), monitor.private_address(address).alias("private"))


@query("""WITH b AS (SELECT user_id % 30 AS machine, event_id, CAST(event_type IN ('view', 'click') AS INTEGER) AS bad FROM events),
r AS (SELECT *, min(bad) OVER w = 1 AND count(*) OVER w = 4 AS hit FROM b WINDOW w AS (PARTITION BY machine ORDER BY event_id ROWS 3 PRECEDING)) SELECT machine, min(event_id) AS opened FROM r WHERE hit GROUP BY machine""")
def breakers(t: Tables) -> DataFrame:
    fault = F.when(F.col("event_type").isin("view", "click"), "storage").otherwise("file")
    rows = t.events.select((F.col("user_id") % 30).alias("machine"), "event_id", fault.alias("fault"))
    return monitor.breaker(rows, "machine", "event_id", "fault", 4)


@query("""SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) = 3 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def period_view(t: Tables) -> DataFrame:
    hidden, vault = (t.customer.where(c).select("c_custkey") for c in ("c_acctbal < 0", "c_acctbal < -500"))
    rows = t.orders.where(assets.in_period(F.year("o_orderdate"), F.month("o_orderdate"), 1995, 3))
    return assets.seen(rows, "o_custkey", hidden, vault, False).select("o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) = 3 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < -500)""")
def period_reveal(t: Tables) -> DataFrame:
    hidden, vault = (t.customer.where(c).select("c_custkey") for c in ("c_acctbal < 0", "c_acctbal < -500"))
    rows = t.orders.where(assets.in_period(F.year("o_orderdate"), F.month("o_orderdate"), 1995, 3))
    return assets.seen(rows, "o_custkey", hidden, vault, True).select("o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'both' ELSE 'first' END AS part FROM customer")
def overlap_probe(t: Tables) -> DataFrame:
    return assets.overlap_and_rest(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'R'))")
def subtracted_chips(t: Tables) -> DataFrame:
    chips = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    return assets.without_chips(t.part.select("p_partkey"), "p_partkey", chips, "l_returnflag", ["A", "R"])


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 8000")
def newest_events(t: Tables) -> DataFrame:
    return assets.newest(t.events.select("event_id", "event_type"), "event_id", 8_000)


@query("""WITH c AS (SELECT user_id % 13 AS y, user_id % 7 AS x, user_id, min(event_id) AS start, count(*) AS size FROM events GROUP BY 1, 2, 3)
SELECT y, x, user_id, start, size, row_number() OVER (ORDER BY y, x, start, user_id) AS cluster_id FROM c""")
def dense_cluster_ids(t: Tables) -> DataFrame:
    u = F.col("user_id")
    rows = t.events.select((u % 13).alias("y"), (u % 7).alias("x"), "user_id", "event_id")
    return assets.dense_ids(rows, ["y", "x"], "user_id", "event_id").withColumn("cluster_id", F.col("cluster_id").cast("long"))


@query("""WITH k AS (SELECT c_nationkey AS grp, c_custkey AS id FROM customer WHERE c_acctbal >= 5000), n AS (SELECT c_nationkey AS grp, count(*) FILTER (c_acctbal >= 5000) AS good FROM customer GROUP BY 1)
SELECT grp, good AS keepers, least(6, total) AS picked FROM n JOIN (SELECT c_nationkey AS grp, count(*) AS total FROM customer GROUP BY 1) USING (grp)""")
def keepers_first(t: Tables) -> DataFrame:
    """How many a keepers-first sample has of each group, and that keepers come before others."""
    rows = t.customer.select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") >= 5000).alias("good"))
    found = assets.keepers_first(rows, ["grp"], "id", F.col("good"), 7, 6).join(rows.select("id", "good"), "id")
    wrong = F.count_if(F.col("good") & (F.col("place") > F.col("keepers"))) + F.count_if(~F.col("good") & (F.col("place") <= F.col("keepers")))
    counts = rows.groupBy("grp").agg(F.count_if("good").alias("keepers"))
    return found.join(counts, "grp").groupBy("grp", "keepers").agg(F.count("*").alias("picked"), wrong.alias("wrong")).where("wrong = 0").drop("wrong")


_X = "CAST(event_id * 7 % 1009 AS DOUBLE)"


@query(f"""SELECT event_id, CASE WHEN x <= 0 THEN '0.0' ELSE list_aggregate(list_transform(range(0, n), lambda i: printf('%.3f', round(x * (i + 0.5) / n, 3))), 'string_agg', ',') END AS centres, least(1.0, user_id / x)::DOUBLE AS ratio, round(x / 7, 4) AS place FROM
(SELECT event_id, user_id, nullif({_X}, 0) AS x0, {_X} AS x, CAST(least(6, greatest(1, ceil({_X} / CASE WHEN {_X} < 30 THEN 4.0 ELSE 5.0 END))) AS INTEGER) AS n FROM events) WHERE x > 0""")
def clip_scalars(t: Tables) -> DataFrame:
    x = (F.col("event_id") * 7 % 1009).cast("double")
    text = F.array_join(F.transform(S.seek_centres(x), lambda c: F.format_string("%.3f", c)), ",")
    return t.events.where(x > 0).select("event_id", text.alias("centres"), S.share_of(F.col("user_id"), x).alias("ratio"), S.place_4dp(x / 7).alias("place"))


@query("""WITH t AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey % 86400) AS tm FROM orders) SELECT o_orderkey, tm AS naive, tm - 7200 AS zoned, tm // 86400 * 86400 AS day, tm AS camera FROM t""")
def time_scalars(t: Tables) -> DataFrame:
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400
    of = lambda p: F.date_format(F.timestamp_seconds(at), p)
    naive = of("yyyy-MM-dd'T'HH:mm:ss")
    return t.orders.select("o_orderkey", S.iso_epoch(naive).alias("naive"), S.iso_epoch(F.concat(naive, F.lit("+02:00"))).alias("zoned"), S.iso_epoch(of("yyyy-MM-dd")).alias("day"), S.camera_epoch(of("yyyy:MM:dd HH:mm:ss")).alias("camera"))


@query(r"""SELECT doc_id, 'it says {"n": ' || doc_id || ', "in": {"a": 1}} and {more}' AS x, '{"n": ' || doc_id || ', "in": {"a": 1}}' AS found, 'a<b & ' || doc_id || ' © é' AS plain FROM documents""")
def text_scalars(t: Tables) -> DataFrame:
    d = F.col("doc_id").cast("string")
    x = F.concat(F.lit('it says {"n": '), d, F.lit(', "in": {"a": 1}} and {more}'))
    coded = F.concat(F.lit("a&lt;b &amp; "), d, F.lit(" &copy; &#xE9;"))
    return t.documents.select("doc_id", x.alias("x"), S.json_object(x).alias("found"), S.unescape(coded).alias("plain"))


@query("""WITH x AS (SELECT event_id, event_id % 7 <> 0 AS whole, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, user_id FROM events)
SELECT event_id, CASE WHEN whole THEN k END AS k, CASE WHEN whole THEN left(event_type, 3) ELSE '' END AS type, CASE WHEN whole THEN 2 ELSE 0 END AS tags,
  CASE WHEN whole THEN k::VARCHAR END AS flag, CASE WHEN whole THEN (user_id + 1) * 2.0 ELSE 0 END::DOUBLE AS area FROM x""")
def unknown_json(t: Tables) -> DataFrame:
    """Defensive reads of texts that hold the events' props, every seventh one cut short."""
    whole = F.concat(F.lit('{"in": '), "props", F.lit(', "type": "'), "event_type", F.lit('", "tags": ["a, b", null], "box": [-1, 0, '), F.col("user_id").cast("string"), F.lit(", 2]}"))
    v = unknown.parsed(F.when(F.col("event_id") % 7 == 0, F.left(whole, F.length(whole) - 3)).otherwise(whole))
    return t.events.select("event_id", unknown.read(v, "$.in.k", "long").alias("k"), unknown.text(v, "$.type", 3).alias("type"), F.size(unknown.elements(v, "$.tags")).alias("tags"), F.get(F.map_values(unknown.flags(v, "$.in")), 0).alias("flag"), unknown.box_area(v, "$.box").alias("area"))
