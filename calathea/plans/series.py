"""Queries over time series: bursts, sessions, runs, ranks, samples, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import windows
from ..registry import Tables, query

_CHAIN_SQL = """WITH s AS (SELECT *, epoch_us(ts) / 1e6 AS tm FROM events),
g AS (SELECT *, CASE WHEN tm - lag(tm) OVER w <= {gap} THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY user_id ORDER BY tm, event_id)),
c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY tm, event_id ROWS UNBOUNDED PRECEDING) AS chain FROM g)
"""


def _timed(t: Tables) -> DataFrame:
    return t.events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@query(_CHAIN_SQL.format(gap=3600) + """, r AS (SELECT *, count(*) OVER (PARTITION BY user_id, chain) AS chain_size, row_number() OVER (PARTITION BY user_id, chain ORDER BY value DESC NULLS LAST, tm, event_id) AS best_rank FROM c)
SELECT event_id, chain_size, CAST(best_rank AS INTEGER) AS best_rank FROM r WHERE chain_size >= 3 AND best_rank > 1""")
def burst_extras(t: Tables) -> DataFrame:
    return windows.chain_extras(_timed(t), ["user_id"], "at", "event_id", 3600, 3, 1, "value").select("event_id", "chain_size", "best_rank")


@query("SELECT user_id, epoch_us(ts) // 3600000000 AS slot, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 2")
def burst_bucket_approx(t: Tables) -> DataFrame:
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).alias("slot")
    return t.events.groupBy("user_id", slot).agg(F.count("*").alias("n")).where("n >= 2")


@query(_CHAIN_SQL.format(gap=7200) + "SELECT user_id, CAST(chain AS BIGINT) AS chain, round(min(tm), 3) AS start, round(max(tm), 3) AS \"end\", count(*) AS n FROM c GROUP BY 1, 2 HAVING count(*) >= 2")
def sessions_trips(t: Tables) -> DataFrame:
    found = windows.sessions(_timed(t), ["user_id"], "at", "event_id", 7200, 2)
    return found.select("user_id", "chain", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


@query("""WITH g AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND lag(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n FROM c GROUP BY 1, 2""")
def run_stops(t: Tables) -> DataFrame:
    return windows.runs(t.events, ["user_id"], ["ts", "event_id"], "event_type").groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS r, count(*) OVER () AS n FROM lineitem), x AS (SELECT v FROM s WHERE r = least(n - 1, n * 10 // 100) + 1)
SELECT x.v AS threshold, (SELECT count(*) FROM lineitem, x WHERE l_extendedprice < x.v) AS below FROM x""")
def percentile_cut(t: Tables) -> DataFrame:
    bar = windows.order_statistic(t.lineitem, "l_extendedprice", 10)
    rows = t.lineitem.select("l_extendedprice").crossJoin(F.broadcast(bar))  # one row
    return rows.groupBy("threshold").agg(F.count_if(F.col("l_extendedprice") < F.col("threshold")).alias("below"))


@query("SELECT o_orderkey, CAST(round_even(100.0 * (rank() OVER (ORDER BY o_totalprice) - 1) / count(*) OVER (), 0) AS INTEGER) AS percentile FROM orders")
def library_percentile(t: Tables) -> DataFrame:
    return windows.library_percentile(t.orders, "o_totalprice").select("o_orderkey", "percentile")


@query("SELECT doc_id, round((row_number() OVER (ORDER BY n_chars, doc_id) - 1) / (count(*) OVER () - 1)::DOUBLE, 9) AS share FROM documents")
def rank_pct(t: Tables) -> DataFrame:
    return windows.rank_share(t.documents, "n_chars", "doc_id").select("doc_id", F.round("share", 9).alias("share"))


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, doc_id FROM r WHERE n <= 9 OR i IN (SELECT (k * (n - 1)) // 8 FROM range(0, 9) AS s(k))""")
def even_sample(t: Tables) -> DataFrame:
    return windows.even_sample(t.documents.select("lang", "doc_id"), ["lang"], [F.col("doc_id")], 9)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= CASE WHEN source = 'src0' THEN 10 ELSE 3 END")
def top_per_stratum(t: Tables) -> DataFrame:
    cap = F.when(F.col("source") == "src0", 10).otherwise(3)
    return windows.top_per_group(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], cap).select("source", "doc_id")


@query("""SELECT event_id, round(count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) / 3600.0, 9) AS rate FROM events""")
def windowed_rate(t: Tables) -> DataFrame:
    rows = t.events.withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    return windows.rolling_rate(rows, ["event_type"], "at", 3600).select("event_id", F.round("rate", 9).alias("rate"))


@query("""WITH e AS (SELECT event_type, event_id, epoch_us(ts) // 1000000 AS s FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY s, event_id) AS rn,
min(event_id) OVER (PARTITION BY event_type, s) AS x FROM e), g AS (SELECT *, min(rn) OVER (PARTITION BY event_type ORDER BY s RANGE BETWEEN 36000 PRECEDING AND CURRENT ROW) AS lo FROM f)
SELECT g.event_id, CASE WHEN g.s > h.s THEN round((g.rn - h.rn) * 60.0 / (g.s - h.s), 9)::DOUBLE END AS rate FROM g JOIN g h ON h.event_type = g.event_type AND h.rn = greatest(g.lo, g.rn - 19)""")
def recent_rate(t: Tables) -> DataFrame:
    rows = t.events.withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    return windows.recent_rate(rows, ["event_type"], "at", "event_id", 36000, 20).select("event_id", F.round("rate", 9).alias("rate"))


@query("""SELECT event_id, CASE WHEN count(value) OVER w >= 10 THEN round(quantile_cont(value, 0.5) OVER w, 9) END AS median FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def rolling_median(t: Tables) -> DataFrame:
    return windows.rolling_median(t.events, ["event_type"], ["ts", "event_id"], "value", 20, 10).select("event_id", F.round("median", 9).alias("median"))


@query("""WITH b AS (SELECT *, sum(CASE WHEN value < 20 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
SELECT event_id, CAST(sum(CASE WHEN value < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM b""")
def streaks(t: Tables) -> DataFrame:
    return windows.streaks(t.events, ["user_id"], ["ts", "event_id"], F.col("value") < 20).select("event_id", "streak")
