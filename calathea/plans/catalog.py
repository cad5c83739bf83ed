"""Catalogue queries: copies, exclusion, rule nominations, matching, writes, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import greedy, matching, monitor, mutation, sets, windows
from ..registry import Tables, query


@query("""
SELECT doc_id, digest, keep_rank FROM (
  SELECT doc_id, sha256(text) AS digest, CAST(row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars DESC, doc_id) AS INTEGER) AS keep_rank
  FROM documents) WHERE keep_rank > 1""")
def dedup_keep_best(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars", F.sha2("text", 256).alias("digest"))
    return windows.keep_rank(rows, ["digest"], [F.desc("n_chars"), F.col("doc_id")]).where("keep_rank > 1").select("doc_id", "digest", "keep_rank")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_acctbal < 0 AND c.c_custkey = o.o_custkey)")
def null_safe_exclude(t: Tables) -> DataFrame:
    bad = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return sets.exclude(t.orders.select("o_orderkey", "o_custkey"), bad, "o_custkey")


@query("""
SELECT tier, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT value, CASE WHEN value < 1 THEN 'A2a' WHEN value < 3 THEN 'A2b' END AS tier FROM events WHERE event_type <> 'click') WHERE tier IS NOT NULL GROUP BY tier""")
def short_clip_tiers(t: Tables) -> DataFrame:
    tier = F.when(F.col("value") < 1, "A2a").when(F.col("value") < 3, "A2b")
    return t.events.where("event_type <> 'click'").withColumn("tier", tier).where("tier is not null").groupBy("tier").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
SELECT p_partkey, p_size, CAST(p_partkey % 40 AS INTEGER) AS height FROM part
WHERE (p_size, CAST(p_partkey % 40 AS INTEGER)) IN ((5, 10), (10, 5), (7, 21), (21, 7), (30, 12), (12, 30))""")
def resolution_pair_filter(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_size", (F.col("p_partkey") % 40).cast("int").alias("height"))
    return rows.where(sets.screen_sized(F.col("p_size"), F.col("height"), [(5, 10), (7, 21), (12, 30)]))


def _rules() -> dict[str, Column]:
    return {
        "big": F.col("l_quantity") >= 45, "cheap": F.col("l_extendedprice") < 2000, "late": F.col("l_shipdate") >= F.lit("1998-06-01"),
        "untaxed": F.col("l_tax") == 0, "returned": F.col("l_returnflag") == "R",
    }


_RULES_SQL = """
WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, unnest(list_filter([
  CASE WHEN l_quantity >= 45 THEN 'big' END, CASE WHEN l_extendedprice < 2000 THEN 'cheap' END, CASE WHEN l_shipdate >= TIMESTAMP '1998-06-01' THEN 'late' END,
  CASE WHEN l_tax = 0 THEN 'untaxed' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem)
"""


def _nominations(t: Tables) -> DataFrame:
    return sets.nominate(t.lineitem.withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")), _rules())


@query(_RULES_SQL + "SELECT id, string_agg(rule, ',' ORDER BY rule) AS rules FROM (SELECT DISTINCT id, rule FROM r) GROUP BY id")
def rule_union(t: Tables) -> DataFrame:
    return sets.merge_rules(_nominations(t)).select("id", F.array_join("rules", ",").alias("rules"))


@query(_RULES_SQL + "SELECT rule, count(DISTINCT id) AS n FROM r GROUP BY rule")
def rule_summary(t: Tables) -> DataFrame:
    return sets.rule_summary(_nominations(t))


@query(_RULES_SQL + """
, g AS (SELECT id, list(DISTINCT rule) AS rules FROM r GROUP BY id),
p AS (SELECT id, CASE WHEN list_contains(rules, 'returned') THEN 'returned' WHEN list_contains(rules, 'late') THEN 'late' ELSE list_sort(rules)[1] END AS rule FROM g)
SELECT id, rule, CASE WHEN rule = 'returned' THEN 'Came back: ' || id WHEN rule = 'late' THEN 'Shipped late: ' || id END AS reason FROM p""")  # fmt: skip
def primary_rules(t: Tables) -> DataFrame:
    merged = sets.merge_rules(_nominations(t)).withColumn("rule", S.primary_rule(F.col("rules"), ["returned", "late"]))
    return merged.select("id", "rule", S.reason(F.col("rule"), {"returned": "Came back: %s", "late": "Shipped late: %s"}, F.col("id")).alias("reason"))


@query("""
WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal < -900), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
p AS (SELECT o_orderkey AS id FROM o UNION SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT id FROM p""")
def protected_closure(t: Tables) -> DataFrame:
    people = t.customer.where("c_acctbal < -900").select(F.col("c_custkey").alias("o_custkey"))
    own = sets.keep_only(t.orders, people, "o_custkey").select(F.col("o_orderkey").alias("id"))
    return sets.closure(own, t.lineitem, "l_orderkey", "l_partkey")


@query("""
SELECT guard, n FROM (
  SELECT 'vault' AS guard, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 = 0
  UNION ALL SELECT 'people', count(*) FROM orders o WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)
  UNION ALL SELECT 'exported', count(*) FROM orders o WHERE o_orderstatus = 'F' AND o_orderkey % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0))""")
def export_held_back(t: Tables) -> DataFrame:
    cut = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    vault = t.orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id"))
    bad = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    people = sets.keep_only(t.orders, bad, "o_custkey").select(F.col("o_orderkey").alias("id"))
    clean, counts = sets.held_back(cut, {"vault": vault, "people": people})
    return counts.union(clean.agg(F.count("*").alias("n")).select(F.lit("exported").alias("guard"), "n"))


@query("""
SELECT o_orderkey FROM orders WHERE o_totalprice >= 300000 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 3)""")
def threshold_cleared(t: Tables) -> DataFrame:
    cleared = t.lineitem.where("l_quantity < 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return sets.above_unless_cleared(t.orders, "o_totalprice", 300000, cleared, "o_orderkey")


@query("""
WITH p AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS tm FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS tm FROM events WHERE event_type = 'view'),
j AS (SELECT p.event_id, v.event_id AS match_event_id, abs(p.tm - v.tm) AS gap, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.tm - v.tm), v.event_id) AS r FROM p JOIN v USING (user_id))
SELECT event_id, match_event_id, round(gap, 3) AS gap FROM j WHERE r = 1 AND gap <= 86400""")
def nearest_time_join(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    a, b = (rows.where(F.col("event_type") == k).drop("event_type") for k in ("purchase", "view"))
    found = matching.nearest(a, b, ["user_id"], "at", "at", "event_id", "event_id", 86400)
    return found.select("event_id", "match_event_id", F.round("gap", 3).alias("gap"))


@query("""
WITH a AS (SELECT event_id AS asset, user_id AS name, CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) // 1000000 END AS tm FROM events WHERE event_type = 'click'),
b AS (SELECT event_id AS record, user_id AS name, epoch_us(ts) // 1000000 AS rat FROM events WHERE event_type = 'signup'),
na AS (SELECT name, count(*) AS na FROM a GROUP BY name), nb AS (SELECT name, count(*) AS nb, min(record) AS lone FROM b GROUP BY name),
d AS (SELECT asset, record, abs(tm - rat) AS gap, row_number() OVER (PARTITION BY asset ORDER BY abs(tm - rat), record) AS r FROM a JOIN b USING (name) WHERE tm IS NOT NULL),
x AS (SELECT a.asset, a.tm, na, nb, lone, d.record AS dated, gap FROM a JOIN na USING (name) JOIN nb USING (name) LEFT JOIN d ON d.asset = a.asset AND r = 1),
y AS (SELECT *, CASE WHEN gap <= 2 THEN 'date' WHEN gap <= 90000 THEN 'date_tz' WHEN na = 1 AND nb = 1 THEN 'unique' WHEN nb = 1 AND tm IS NULL THEN 'only' END AS tier FROM x)
SELECT asset, CASE WHEN tier LIKE 'date%' THEN dated ELSE lone END AS record, tier, CASE tier WHEN 'date' THEN 1.0 WHEN 'date_tz' THEN 0.95 WHEN 'unique' THEN 0.85 ELSE 0.6 END::DOUBLE AS confidence
FROM y WHERE tier IS NOT NULL""")
def tiered_match(t: Tables) -> DataFrame:
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    a = t.events.where("event_type = 'click'").select(F.col("event_id").alias("asset"), F.col("user_id").alias("name"), F.when(F.col("event_id") % 5 != 0, at).alias("at"))
    b = t.events.where("event_type = 'signup'").select(F.col("event_id").alias("record"), F.col("user_id").alias("name"), at.alias("rat"))
    return matching.tiered(a, b, "name", "asset", "at", "record", "rat")


@query("""
SELECT conv_id, max(CASE WHEN role = 'user' THEN turn END) AS asked, max(CASE WHEN role = 'assistant' THEN turn END) AS answered FROM conversations
GROUP BY conv_id HAVING count(*) FILTER (role = 'user') = 1 AND count(*) FILTER (role = 'assistant') = 1""")
def unique_pair_groups(t: Tables) -> DataFrame:
    return matching.unique_pairs(t.conversations, "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant", ("asked", "answered"))


@query("""
SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 50""")
def containment_band(t: Tables) -> DataFrame:
    ranges = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 50).alias("high"))
    return matching.within(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", ranges, "low", "high", 50).select("c_custkey", "s_suppkey")


@query("""
WITH p AS (SELECT DISTINCT o_custkey AS k, l_suppkey AS s, count(*) AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
m AS (SELECT k, max(c) AS score FROM p GROUP BY k)
SELECT p.k, min(s) AS s, score, CASE WHEN count(*) = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM p JOIN m ON p.k = m.k AND c = score GROUP BY p.k, score""")
def candidate_status(t: Tables) -> DataFrame:
    # so many tasks that none has more than about half a million lines, of an order's and of a customer's hash
    lines = t.lineitem.select("l_orderkey", "l_suppkey")
    parts = max(t.spark.sparkContext.defaultParallelism, -(-lines.count() // 500_000))
    joined = t.orders.select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey").join(lines.repartition(parts, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = joined.select(F.col("o_custkey").alias("k"), F.col("l_suppkey").alias("s")).repartition(parts, "k").groupBy("k", "s").agg(F.count("*").alias("c"))
    return matching.candidate_status(pairs, "k", "s", F.col("c"), repeated=False)


@query("""
SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'signup'""")
def upsert_latest(t: Tables) -> DataFrame:
    out = mutation.latest(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], F.col("event_type") == "signup")
    return out.select("event_id", "user_id", "event_type")


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'HELD' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def guarded_update(t: Tables) -> DataFrame:
    changes = t.customer.where("c_acctbal < 0").select("c_custkey", F.col("c_mktsegment").alias("expected"), F.lit("HELD").alias("value"))
    return mutation.guarded_update(t.customer.select("c_custkey", "c_mktsegment"), changes, "c_custkey", "c_mktsegment", "expected", "value")


@query("""
WITH d AS (SELECT CASE WHEN o_orderstatus = 'P' THEN -o_orderkey ELSE o_orderkey END AS id, o_orderpriority AS state FROM orders), b AS (SELECT -o_orderkey AS src, o_orderkey + o_custkey % 2 AS dst FROM orders),
own AS (SELECT * FROM d WHERE id NOT IN (SELECT src FROM b)), mv AS (SELECT dst AS id, state FROM d JOIN b ON d.id = b.src)
SELECT id, state FROM own UNION ALL SELECT id, min(state) FROM mv WHERE id NOT IN (SELECT id FROM own) GROUP BY id""")
def redirected_decisions(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    d = t.orders.select(F.when(F.col("o_orderstatus") == "P", -k).otherwise(k).alias("id"), F.col("o_orderpriority").alias("state"))
    b = t.orders.select((-k).alias("src"), (k + F.col("o_custkey") % 2).alias("dst"))
    return mutation.redirected(d, b, "src", "dst")


@query("""
SELECT event_id FROM events WHERE event_id % 3 = 0 OR (event_id % 4 = 1 AND event_id % 5 <> 2)""")
def resume_work_list(t: Tables) -> DataFrame:
    e = t.events.select(F.col("event_id").alias("path"), F.col("user_id").alias("size"), F.lit(1).alias("mtime"), (F.col("event_id") % 4 == 1).alias("is_image"))
    done = e.where("path % 3 <> 0").select("path", "size", "mtime", F.lit(None).cast("string").alias("phash"), F.when(F.col("path") % 5 == 2, "bad").alias("error"))
    return monitor.work_list(e, done).select(F.col("path").alias("event_id"))


@query(r"""
SELECT doc_id, trim(regexp_replace(lower(regexp_replace(replace(text, '_', ' '), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^`{|}~]', '', 'g')), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS canon FROM documents""")
def text_canonical(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.canonical_text(F.col("text")).alias("canon"))


@query("""
WITH h AS (SELECT doc_id, md5(text) AS m FROM documents)
SELECT a.doc_id, CAST(bit_count(xor(('0x' || a.m[1:8])::BIGINT, ('0x' || b.m[1:8])::BIGINT)) + bit_count(xor(('0x' || a.m[9:16])::BIGINT, ('0x' || b.m[9:16])::BIGINT)) AS INTEGER) AS distance
FROM h a JOIN h b ON b.doc_id = a.doc_id + 1""")
def near_dup_hamming(t: Tables) -> DataFrame:
    h = t.documents.select("doc_id", F.md5("text").substr(1, 16).alias("h"))
    after = h.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("g"))
    return h.join(after, "doc_id").select("doc_id", S.hamming64(F.col("h"), F.col("g")).alias("distance"))


@query(r"""
SELECT page_id, upper(regexp_extract(url, '\.([^./]+)$', 1)) AS ext, lower(regexp_replace(url, '\.[^.]+$', '')) AS stem, CAST(octet_length(encode(html)) AS BIGINT) AS bytes,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def page_scalars(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select("page_id", S.extension(url).alias("ext"), S.stem(url).alias("stem"), F.octet_length("html").cast("long").alias("bytes"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0")
def json_props(t: Tables) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return t.events.select("event_id", k.alias("k")).where("k % 2 = 0")


@query("""
SELECT p_partkey, CASE WHEN n >= 1024 * 1024 THEN printf('%.1fMB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.0fKB', n / 1024.0) ELSE printf('%.0fB', n) END AS size,
  CASE WHEN n / 1e6 >= 20 THEN 'A_>20MB' WHEN n / 1e6 >= 5 THEN 'B_5-20MB' WHEN n / 1e6 >= 1 THEN 'C_1-5MB' ELSE 'D_<1MB' END AS band FROM (SELECT p_partkey, p_retailprice * 3000.7 AS n FROM part)""")
def size_labels(t: Tables) -> DataFrame:
    n = F.col("p_retailprice") * 3000.7
    return t.part.select("p_partkey", S.human_bytes(n).alias("size"), S.size_band(n).alias("band"))


@query("""
WITH a AS (SELECT p_partkey, instr(lower(p_name), 'a') AS a, lower(p_name) AS s FROM part), e AS (SELECT *, instr(substr(s, a + 1), 'e') AS e FROM a WHERE a > 0), o AS (SELECT *, instr(substr(s, a + e + 1), 'o') AS o FROM e WHERE e > 0)
SELECT p_partkey, CAST(1000 - 4 * (a - 1) - (e - 1) - (o - 1) AS INTEGER) AS score FROM o WHERE o > 0""")
def fuzzy_subsequence(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.fuzzy_score("aeo", F.col("p_name")).alias("score")).where("score >= 0")


@query("""
SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey""")
def unordered_pairs(t: Tables) -> DataFrame:
    return greedy.unordered_pairs(t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")), "a", "b")


@query()
def greedy_diverse(t: Tables) -> DataFrame:
    rows = t.documents.select("lang", "doc_id", F.md5("text").substr(1, 16).alias("phash"), (F.col("n_chars") * 10.0).alias("ts"))
    return greedy.diverse_pick(rows, "lang", "doc_id", "phash", "ts", 12)
