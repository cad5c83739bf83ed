"""Queries over made-up assets: the tables' keys stand for ids, sizes and marks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import assets, sets, windows
from ..registry import Tables, query


@query("""SELECT p_partkey, (p_brand = 'Brand#12') OR p_type ILIKE '%brass%' OR lower(p_name) LIKE 'a%' AS protected FROM part""")
def protected_marks(t: Tables) -> DataFrame:
    mark = F.coalesce(F.col("p_brand").isin("Brand#12"), F.lit(False)) | assets.like_any_case(F.col("p_type"), "%brass%") | F.coalesce(F.lower("p_name").startswith("a"), F.lit(False))
    return t.part.select("p_partkey", mark.alias("protected"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 10 < 1 THEN 'A2a' WHEN l_quantity / 10 < 3 THEN 'A2b' END AS tier FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'O' AND l_quantity / 10 < 3""")
def clip_tiers(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "mov")
    tier = assets.clip_tier(kind, F.col("l_linestatus") == "O", F.col("l_quantity") / 10)
    return t.lineitem.select("l_orderkey", "l_linenumber", tier.alias("tier")).where("tier is not null")


@query("""SELECT conv_id AS id FROM (SELECT conv_id, max((turn = 3)::INT) AS d, count(*) FILTER (role = 'user') AS o FROM conversations GROUP BY 1) WHERE (d = 1 OR o >= 4 OR (conv_id % 2 = 0 AND o > 0)) AND conv_id % 3 <> 0""")
def screenshot_documents(t: Tables) -> DataFrame:
    labels = t.conversations.select(F.col("conv_id").alias("id"), F.explode(F.array(F.when(F.col("turn") == 3, "document"), F.when(F.col("role") == "user", "ocr"))).alias("category")).where("category is not null")
    items = t.conversations.select(F.col("conv_id").alias("id")).distinct().withColumn("kind", F.when(F.col("id") % 3 == 0, "MOV").when(F.col("id") % 2 == 0, "PNG").otherwise("JPG"))
    return assets.screenshots_or_documents(labels, items, "id", "kind")


@query("""WITH c AS (SELECT o_orderkey AS still, o_totalprice AS still_size FROM orders WHERE o_orderstatus = 'F')
SELECT still, still_size, still AS id, 'still' AS role FROM c UNION ALL SELECT still, still_size, l_partkey, 'live_motion' FROM c JOIN lineitem ON l_orderkey = still WHERE l_linenumber = 1""")
def export_manifest(t: Tables) -> DataFrame:
    cut = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("size"))
    clips = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"))
    return assets.manifest(cut, clips, "key", "size", "a", "b")


@query("""SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text), n_chars) AS "group" FROM documents QUALIFY count(*) OVER (PARTITION BY sha256(text), n_chars) > 1""")
def exact_duplicate_groups(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars", F.sha2("text", 256).alias("digest"))
    return assets.duplicate_groups(rows, [F.col("n_chars")], "digest", "doc_id")


@query("""SELECT k, c, string_agg(e, ',' ORDER BY r) AS terms FROM (SELECT user_id AS k, event_type AS c, CAST(event_id AS VARCHAR) AS e, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, CAST(event_id AS VARCHAR)) AS r FROM events) WHERE r <= 3 GROUP BY 1, 2""")
def top_labels(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("k"), F.col("event_type").alias("c"), F.col("event_id").cast("string").alias("e"), "value")
    return assets.top_labels(rows, "k", "c", "e", "value", 3).withColumn("terms", F.array_join("terms", ","))


@query("""SELECT label AS person, count(*) AS faces, count(DISTINCT vec_id % 50) AS assets, count(*) FILTER (vec_id % 4 = 0) AS confirmed, arg_max(vec_id, (vec_id * 7919) % 1000) AS face FROM embeddings GROUP BY 1""")
def people_list(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    rows = t.embeddings.select(F.col("label").alias("person"), v.alias("f"), (v % 50).alias("a"), (v % 4 == 0).alias("c"), (v * 7919 % 1000).alias("s"))
    return assets.people(rows, "person", "f", "a", "c", "s")


@query("""WITH n AS (SELECT o_orderkey AS a, min(o_custkey) AS person FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) = 1), f AS (SELECT l_orderkey AS a, min(l_partkey) AS face FROM lineitem GROUP BY 1 HAVING count(*) = 1)
SELECT a, person, face FROM n JOIN f USING (a)""")
def single_name_seeds(t: Tables) -> DataFrame:
    names = t.orders.select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("person"))
    return assets.single_seeds(names, t.lineitem.select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("face")), "a", "person", "face")


@query("""SELECT b.item_id, min(d.doc_id) AS first_doc_id FROM (SELECT item_id, item_id * 5 AS n FROM benchmark) b LEFT JOIN (SELECT doc_id, n_chars % 200 AS n FROM documents) d USING (n) GROUP BY 1""")
def content_representatives(t: Tables) -> DataFrame:
    left = t.benchmark.select("item_id", (F.col("item_id") * 5).alias("n"))
    return assets.by_representative(left, t.documents.select("doc_id", (F.col("n_chars") % 200).alias("n")), "n", "doc_id").select("item_id", "first_doc_id")


@query("SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'render/' || page_id ELSE url END AS url FROM pages")
def rendered_paths(t: Tables) -> DataFrame:
    new = t.pages.where("page_id % 7 = 0").select("page_id", F.concat(F.lit("render/"), "page_id").alias("new_url"))
    return assets.overridden(t.pages.select("page_id", "url"), new, "page_id", "url", "new_url")


@query("""SELECT event_id, event_type = 'purchase' AS is_edit, event_type <> 'purchase' AND max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id) = 1 AS has_edits FROM events""")
def edit_marks(t: Tables) -> DataFrame:
    rows = t.events.withColumn("role", F.when(F.col("event_type") == "purchase", "edit").otherwise("original"))
    return assets.edit_marks(rows, "event_id", "user_id", "role")


@query("""SELECT user_id, coalesce(arg_max(event_id, value) FILTER (event_type = 'click'), arg_max(event_id, event_id % 97 * 100000 - event_id) FILTER (event_type = 'view')) AS hero FROM events GROUP BY 1""")
def heroes(t: Tables) -> DataFrame:
    click, view = F.col("event_type") == "click", F.col("event_type") == "view"
    rows = t.events.select("user_id", "event_id", F.when(click, F.col("value")).alias("score"), F.when(view, F.col("event_id") % 97 * 100_000 - F.col("event_id")).alias("blur"), F.lit(True).alias("still"))
    return assets.hero(rows, ["user_id"], "event_id", "score", "blur", "still")


@query("SELECT doc_id, CAST(least(9, floor(10 * (rank() OVER (PARTITION BY lang ORDER BY n_chars) - 1) / count(*) OVER (PARTITION BY lang))) AS INTEGER) AS decile FROM documents")
def visible_deciles(t: Tables) -> DataFrame:
    return assets.visible_decile(t.documents.select("doc_id", "lang", "n_chars"), "lang", "n_chars").select("doc_id", "decile")


@query("""SELECT c_custkey, c_acctbal < 0 AS vaulted, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS starred FROM customer""")
def lean_items(t: Tables) -> DataFrame:
    vault = t.customer.where("c_acctbal < 0").select("c_custkey")
    return assets.shown(t.customer.select("c_custkey"), "c_custkey", {"vaulted": vault, "starred": t.orders.where("o_totalprice > 400000").select("o_custkey")})


@query("""SELECT p_partkey, CASE WHEN p_size > 5 THEN printf('%d × %d (%.1f MP)', p_size * 100, p_size * 90, p_size * 100 * p_size * 90 / 1e6) ELSE '—' END AS dims, printf('%.1f MB', p_retailprice * 5000.5 / 1e6) AS megabytes, concat_ws(' ', p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_type END) AS camera FROM part""")
def item_details(t: Tables) -> DataFrame:
    size = F.when(F.col("p_size") > 5, F.col("p_size"))
    rows = t.part.select("p_partkey", (size * 100).alias("w"), (size * 90).alias("h"), (F.col("p_retailprice") * 5000.5).alias("s"), "p_brand", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("m"))
    return assets.item_details(rows, "p_partkey", "w", "h", "s", "p_brand", "m")


@query("""SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'none' WHEN c_acctbal >= 0 AND c_mktsegment NOT IN ('BUILDING') THEN 'shown' ELSE 'hidden' END AS state FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')""")
def client_filter(t: Tables) -> DataFrame:
    recent = t.orders.where(F.col("o_orderdate") >= F.lit("1998-01-01")).select(F.col("o_custkey").alias("c_custkey"))
    state = F.when(F.col("c_acctbal").isNull(), "none").when((F.col("c_acctbal") >= 0) & ~F.col("c_mktsegment").isin("BUILDING"), "shown").otherwise("hidden")
    return sets.exclude(t.customer, recent, "c_custkey").select("c_custkey", state.alias("state"))


@query("""SELECT user_id, start, n FROM (SELECT user_id, epoch_us(min(ts)) // 1000000 AS start, count(*) AS n FROM events GROUP BY 1) WHERE n >= 50 ORDER BY n DESC, user_id LIMIT 25""")
def ranked_candidates(t: Tables) -> DataFrame:
    found = t.events.groupBy("user_id").agg(F.unix_seconds(F.min("ts").cast("timestamp")).alias("start"), F.count("*").alias("n"))
    return found.where("n >= 50").orderBy(F.desc("n"), "user_id").limit(25)


def _layers() -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(0)
    return [(rng.normal(size=(a, b)) / np.sqrt(a), rng.normal(size=b) / 10) for a, b in ((64, 32), (32, 16), (16, 1))]


def _head_sql() -> str:
    """The head's layers as nested lists, one step a table expression; the error function as in the operator."""
    t = "(1 / (1 + 0.3275911 * abs(x) / sqrt(2)))"
    erf = f"(1 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-x * x / 2))"
    layers, steps = _layers(), ["h0 AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS h FROM embeddings)"]
    for k, (w, b) in enumerate(layers):
        units = ", ".join(f"{{'w': {column.tolist()}, 'b': {bias}}}" for column, bias in zip(w.T, b.tolist(), strict=True))
        linear = f"list_transform([{units}], lambda u: list_dot_product(h, u.w) + u.b)"
        steps.append(f"l{k} AS (SELECT vec_id, {linear} AS h FROM h{k})")
        if k < len(layers) - 1:
            steps.append(f"h{k + 1} AS (SELECT vec_id, list_transform(h, lambda x: x * 0.5 * (1 + sign(x) * {erf})) AS h FROM l{k})")
    return f"WITH {', '.join(steps)} SELECT vec_id, round(1 / (1 + exp(-h[1])), 6) AS score FROM l{len(layers) - 1}"


@query(_head_sql())
def head_scores(t: Tables) -> DataFrame:
    return assets.head_scores(t.embeddings, "vec_id", "embedding", _layers()).withColumn("score", F.round("score", 6))


@query("""WITH r AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN event_id // 10 END AS uuid, event_id // 4 AS stem, event_id % 2 = 0 AS is_mov, CAST(epoch(ts) AS BIGINT) AS tm, event_id % 4 = 0 AS live FROM events),
s AS (SELECT max(CASE WHEN NOT is_mov THEN id END) AS still, max(CASE WHEN is_mov THEN id END) AS mov FROM r WHERE uuid IS NOT NULL GROUP BY uuid HAVING count(*) FILTER (NOT is_mov) = 1 AND count(*) FILTER (is_mov) = 1),
p AS (SELECT m.id AS mov, f.id AS still, abs(f.tm - m.tm) AS cost, count(*) OVER (PARTITION BY m.id) AS n FROM r m JOIN r f USING (stem) WHERE m.is_mov AND m.live AND NOT f.is_mov AND m.id NOT IN (SELECT mov FROM s) AND f.id NOT IN (SELECT still FROM s)),
b AS (SELECT *, row_number() OVER (PARTITION BY mov ORDER BY cost, still) AS k FROM p WHERE n = 1 OR cost <= 86400)
SELECT still, mov, 'uuid' AS method, 1.0::DOUBLE AS confidence FROM s UNION ALL SELECT still, mov, 'name', 0.9::DOUBLE FROM b WHERE k = 1""")
def live_pairs(t: Tables) -> DataFrame:
    """Each stem has one live clip, so that SQL can choose its still; several clips of a stem are tested by hand."""
    e = F.col("event_id")
    rows = t.events.select(
        e.alias("id"), F.when(e % 5 == 0, F.concat(F.lit("u"), F.floor(e / 10))).alias("uuid"), F.concat(F.lit("IMG_"), F.floor(e / 4), F.when(e % 2 == 0, "_HEVC.MOV").otherwise(".HEIC")).alias("name"),
        F.when(e % 2 == 0, "MOV").otherwise("HEIC").alias("kind"), S.nearest_second(F.col("ts")).alias("ts"), (e % 4 == 0).alias("live"),
    )
    return assets.live_pairs(rows, "id", "uuid", "name", "kind", "ts", "live")


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE n <= 5 OR i IN (SELECT (k * n) // 5 FROM range(0, 5) AS s(k))""")
def even_step_sample(t: Tables) -> DataFrame:
    return windows.even_sample(t.documents.select("source", "doc_id"), ["source"], [F.col("doc_id")], 5, ends=False)
