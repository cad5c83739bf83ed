"""Queries of scalar derivations, anchors, marks and writes over stand-in columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import assets, mutation, sets
from ..registry import Tables, query


@query("""WITH x AS (SELECT *, CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN user_id::VARCHAR WHEN 2 THEN 'x' || user_id END AS t FROM events)
SELECT event_id, try_cast(CASE WHEN trim(t) = '' THEN NULL ELSE t END AS DOUBLE) AS number,
  CASE WHEN 1890 + user_id % 240 BETWEEN 1900 AND 2100 THEN event_id % 14 END::INTEGER AS month FROM x""")
def path_scalars(t: Tables) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    text = F.when(e % 4 == 0, " ").when(e % 4 == 1, u.cast("string")).when(e % 4 == 2, F.concat(F.lit("x"), u.cast("string")))
    path = F.concat(F.lit("a/"), (F.lit(1890) + u % 240).cast("string"), F.lit("/"), F.lpad((e % 14).cast("string"), 2, "0"), F.lit("/n.jpg"))
    return t.events.select("event_id", S.number_or_null(text).alias("number"), S.path_month(path).alias("month"))


@query("""WITH x AS (SELECT event_id, value, CASE WHEN event_id % 9 IN (5, 6, 7, 8) THEN user_id % 5 ELSE event_id % 7 + 1 END AS w, CASE WHEN event_id % 9 IN (5, 6, 7, 8) THEN event_id % 7 + 1 ELSE user_id % 5 END AS h FROM events)
SELECT event_id, round_even(w / nullif(h, 0), 4)::DOUBLE AS aspect, h > w AS portrait, CASE WHEN value IS NULL OR value < 10 THEN 1 WHEN value < 60 THEN 2 WHEN value <= 300 THEN 4 ELSE 6 END::INTEGER AS frames,
  round(value * 0.5 / CASE WHEN value < 10 THEN 1 WHEN value < 60 THEN 2 WHEN value <= 300 THEN 4 ELSE 6 END, 9) AS first_at,
  CASE WHEN value IS NULL OR value < 0 THEN 'no-dur' WHEN value < 60 THEN '<1min' WHEN value < 300 THEN '1-5min' WHEN value < 1200 THEN '5-20min' ELSE '>20min' END AS length FROM x""")
def frame_scalars(t: Tables) -> DataFrame:
    e = F.col("event_id")
    shape = e % 7 + 1, F.col("user_id") % 5, e % 9
    frames = S.frame_count(F.col("value"))
    return t.events.select(
        "event_id", S.aspect(*shape).alias("aspect"), S.is_portrait(*shape).alias("portrait"), frames.cast("int").alias("frames"),
        F.round(S.sample_times(F.col("value"), frames)[0], 9).alias("first_at"), S.duration_bucket(F.col("value")).alias("length"),
    )


@query("""SELECT c_custkey, printf('%.2f°%s %.2f°%s', abs(a), CASE WHEN a >= 0 THEN 'N' ELSE 'S' END, abs(b), CASE WHEN b >= 0 THEN 'E' ELSE 'W' END) AS "at",
  c_name || ', ' || CASE c_mktsegment WHEN 'BUILDING' THEN 'BG' WHEN 'MACHINERY' THEN 'MY' ELSE 'n' || c_nationkey END AS title
FROM (SELECT *, (c_custkey % 181 - 90) + 0.25::DOUBLE AS a, (c_custkey % 359 - 180) + 0.5::DOUBLE AS b FROM customer)""")
def place_texts(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    at = S.coordinate_text((c % 181 - 90) + F.lit(0.25), (c % 359 - 180) + F.lit(0.5))
    title = S.place_title(F.col("c_name"), F.col("c_mktsegment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), {"BUILDING": "BG", "MACHINERY": "MY"})
    return t.customer.select("c_custkey", at.alias("at"), title.alias("title"))


@query("""SELECT event_id, 'a|' || event_type || '|b' AS items, CASE WHEN event_id % 3 > 0 THEN (user_id + 1) * 4.0 ELSE 0 END::DOUBLE AS area,
  greatest(0, user_id % 50 - 3) + greatest(0, 60 - event_id % 70)::DOUBLE AS total FROM events""")
def repaired_values(t: Tables) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    items = S.repaired_array(F.array(F.lit("a, "), F.concat(F.lit(" "), "event_type", F.lit(",")), F.lit(None), F.lit("b")))
    box = F.when(e % 3 > 0, F.concat(F.lit('{"x1": -1, "y1": 1, "x2": '), u.cast("string"), F.lit(', "y2": 5}'))).otherwise("{bad")
    total = S.interval_total(F.array(F.lit(3.0), (e % 70).cast("double")), F.array((u % 50).cast("double"), F.lit(None).cast("double")), F.lit(60.0))
    return t.events.select("event_id", F.array_join(items, "|").alias("items"), S.box_area(box).alias("area"), total.alias("total"))


@query("""WITH r AS (SELECT label, vec_id, vec_id % 40 = 0 AS live, row_number() OVER (PARTITION BY label, vec_id % 40 = 0 ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label, vec_id % 40 = 0) AS n,
  greatest(0, 12 - count(*) FILTER (vec_id % 40 = 0) OVER (PARTITION BY label)) AS need FROM embeddings)
SELECT label, vec_id FROM r WHERE CASE WHEN live THEN i < 12 ELSE need > 0 AND (n <= need OR i IN (SELECT k * (n - 1) // greatest(1, need - 1) FROM range(0, 12) AS s(k) WHERE k < need)) END""")
def live_anchors(t: Tables) -> DataFrame:
    rows = t.embeddings.select("label", "vec_id", (F.col("vec_id") % 40 == 0).alias("live"))
    return assets.anchors(rows, ["label"], "vec_id", "live", 12)


@query("""SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS ordered, c_mktsegment IS NULL AND c_acctbal IS NULL AS bare FROM customer""")
def marked_customers(t: Tables) -> DataFrame:
    ids = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    rows = sets.flagged(t.customer, "ordered", ids, "c_custkey")
    return rows.select("c_custkey", "ordered", assets.bare(F.col("c_mktsegment"), F.col("c_acctbal")).alias("bare"))


@query(r"""SELECT p_partkey, coalesce(p_brand IN ('Brand#12', 'Brand#23'), false) OR coalesce(path ILIKE '%\_singular\_display%' ESCAPE '\', false) OR lower(path) LIKE 'promo/%' OR lower(path) LIKE 'small/%' AS protected
FROM (SELECT *, replace(p_type, ' ', '/') || CASE WHEN p_partkey % 17 = 0 THEN '_Singular_Display.JPG' ELSE '-singular-display.jpg' END AS path FROM part)""")
def protected_paths(t: Tables) -> DataFrame:
    path = F.concat(F.replace("p_type", F.lit(" "), F.lit("/")), F.when(F.col("p_partkey") % 17 == 0, "_Singular_Display.JPG").otherwise("-singular-display.jpg"))
    return t.part.select("p_partkey", assets.protected(path, F.col("p_brand"), ["Brand#12", "Brand#23"], ["Promo/", "SMALL/"]).alias("protected"))


@query("""WITH o AS (SELECT c_custkey AS id, 'old' AS s FROM customer WHERE c_acctbal >= 0), n AS (SELECT o_custkey AS id, 'new' AS s FROM orders)
SELECT * FROM o UNION ALL SELECT DISTINCT * FROM n WHERE id NOT IN (SELECT id FROM o)""")
def inserted_or_ignored(t: Tables) -> DataFrame:
    old = t.customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"), F.lit("old").alias("s"))
    return mutation.insert_ignore(old, t.orders.select(F.col("o_custkey").alias("id"), F.lit("new").alias("s")), ["id"])


@query("""SELECT c_custkey AS cluster, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'p' || c_nationkey END, (SELECT min('q' || (o_orderkey % 89)) FROM orders WHERE o_custkey = c_custkey)) AS person,
  c_custkey % 11 = 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS dismissed FROM customer""")
def claims_and_dismissals(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    own = t.customer.select(c.alias("cluster"), F.when(c % 5 == 0, F.concat(F.lit("p"), F.col("c_nationkey").cast("string"))).alias("person"), (c % 11 == 0).alias("dismissed"))
    claims = t.orders.select(F.col("o_custkey").alias("cluster"), F.concat(F.lit("q"), (F.col("o_orderkey") % 89).cast("string")).alias("person"))
    gone = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("cluster"))
    return mutation.dismissed(mutation.claimed(own, claims), gone)


@query("""WITH p AS (SELECT s_suppkey AS still, s_suppkey + 1000000 AS clip FROM supplier)
SELECT p_partkey AS asset, p_partkey IN (SELECT still FROM p) AS is_still, p_partkey IN (SELECT clip FROM p) AS is_clip,
  coalesce((SELECT min(clip) FROM p WHERE still = p_partkey), (SELECT min(still) FROM p WHERE clip = p_partkey)) AS partner FROM part""")
def pairs_anew(t: Tables) -> DataFrame:
    s = F.col("s_suppkey")
    rows = t.part.select(F.col("p_partkey").alias("asset"), F.lit(True).alias("is_still"), F.lit(7).alias("partner"))
    return mutation.paired_anew(rows, t.supplier.select(s.alias("still"), (s + 1_000_000).alias("clip")))
