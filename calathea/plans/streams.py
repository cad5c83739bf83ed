"""Streaming queries, run over what the tables hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import greedy
from ..operators.durable import folder
from ..registry import Tables, query
from ..streaming import fanout, streams, watch


def _events(t: Tables) -> DataFrame:
    schema = t.events.schema
    return streams.new_files(t.spark, t.sf_dir, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(t: Tables, stream: DataFrame, mode: str) -> DataFrame:
    return streams.drain(stream, "drained", folder(t.spark, "streams"), mode)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(count(*) / 3600.0, 9) AS rate FROM events GROUP BY 1, 2")
def stream_rates(t: Tables) -> DataFrame:
    found = _drained(t, streams.rates(_events(t), "ts", "event_type"), "complete")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("rate", 9).alias("rate"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS chain FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM c GROUP BY user_id, chain""")
def stream_sessions(t: Tables) -> DataFrame:
    found = _drained(t, streams.sessions(_events(t), "ts", "user_id"), "complete")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT count(DISTINCT user_id) AS users FROM events")
def stream_first_of_each(t: Tables) -> DataFrame:
    found = _drained(t, streams.first_of_each(_events(t), "user_id", "ts", "60 days").select("user_id"), "append")
    return found.agg(F.count("*").alias("users"))


_THROTTLE_SQL = """WITH r AS (SELECT CAST(user_id % 5 AS BIGINT) AS machine, event_id, 70.0 + value % 20 AS t, value % 7 + 1 AS m FROM events WHERE value IS NOT NULL),
f AS (SELECT machine, event_id, row_number() OVER w >= 3 AND min(CAST(coalesce(t >= 83 OR m <= 2, false) AS INT)) OVER l = 1 AS h, row_number() OVER w >= 3 AND min(CAST(t >= 80 AS INT)) OVER l = 1 AS s, row_number() OVER w >= 3 AND min(CAST(t < 77 AS INT)) OVER l = 1 AS c
  FROM r WINDOW w AS (PARTITION BY machine ORDER BY event_id), l AS (PARTITION BY machine ORDER BY event_id ROWS 2 PRECEDING)),
g AS (SELECT *, sum(CAST(h AS INT)) OVER w AS halts, coalesce(last_value(CASE WHEN s THEN 'soft' WHEN c THEN 'recover' END IGNORE NULLS) OVER w, 'recover') AS state FROM f WINDOW w AS (PARTITION BY machine ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, lag(state, 1, 'recover') OVER (PARTITION BY machine ORDER BY event_id) AS was FROM g)
SELECT machine, event_id, action FROM (SELECT machine, event_id, CASE WHEN halts = 1 AND h THEN 'halt' WHEN halts = 0 AND state <> was THEN state END AS action FROM k) WHERE action IS NOT NULL"""


def _readings(events: DataFrame) -> DataFrame:
    return events.select((F.col("user_id") % 5).cast("long").alias("machine"), "event_id", (F.lit(70.0) + F.col("value") % 20).alias("temperature"), (F.col("value") % 7 + 1).alias("margin"))


@query(_THROTTLE_SQL)
def stream_throttle(t: Tables) -> DataFrame:
    return _drained(t, streams.throttle(_readings(_events(t)), "machine", "event_id", "temperature", "margin").where("action is not null"), "append")


@query(_THROTTLE_SQL)
def throttle_actions(t: Tables) -> DataFrame:
    return greedy.throttle_actions(_readings(t.events), "machine", "event_id", "temperature", "margin")


_WATCH_SQL = """WITH e AS (SELECT user_id % 30 AS worker, date_trunc('second', ts) AS "at", event_id, event_type IN ('view', 'click') AS fault FROM events),
now AS (SELECT max("at") AS now FROM e),
g AS (SELECT *, lead("at") OVER w AS next, CASE WHEN "at" - lag("at") OVER w <= INTERVAL 7200 SECOND THEN 0 ELSE 1 END AS new,
  min(fault::INT) OVER l = 1 AND count(*) OVER l = 4 AS hit FROM e
  WINDOW w AS (PARTITION BY worker ORDER BY "at", event_id), l AS (PARTITION BY worker ORDER BY "at", event_id ROWS 3 PRECEDING)),
steps(kind, number, after) AS (VALUES ('stall', 1, 7200), ('retry', 1, 8400), ('stall', 2, 15600), ('retry', 2, 18000), ('stall', 3, 25200), ('retry', 3, 28200), ('stall', 4, 35400), ('gone', 4, 35400)),
due AS (SELECT worker, "at" + to_seconds(after) AS due, kind, number, next FROM g, steps),
pauses AS (SELECT worker, due AS "at", kind, number FROM due, now WHERE CASE WHEN next IS NULL THEN due <= now ELSE due < next END),
"""
_BEATS_SQL = """runs AS (SELECT worker, run, min("at") AS first, max("at") AS last FROM (SELECT *, sum(new) OVER (PARTITION BY worker ORDER BY "at", event_id ROWS UNBOUNDED PRECEDING) AS run FROM g) GROUP BY 1, 2),
beats AS (SELECT worker, unnest(range(first + INTERVAL 1800 SECOND, least(last + INTERVAL 7200 SECOND, now) + INTERVAL 1 SECOND, INTERVAL 1800 SECOND)) AS "at" FROM runs, now),
counted AS (SELECT b.worker, b."at", 'heartbeat' AS kind, count(*) AS number FROM beats b JOIN e ON e.worker = b.worker AND e."at" <= b."at" GROUP BY 1, 2)
SELECT * FROM pauses UNION ALL SELECT * FROM counted UNION ALL SELECT worker, arg_min("at", ("at", event_id)), 'breaker', arg_min(event_id, ("at", event_id)) FROM g WHERE hit GROUP BY worker"""
_LIMITS = watch.Limits(stall=7_200, beat=1_800, every=10**9, faults=4, base=600, cap=3_000, tries=4)


def _worked(events: DataFrame) -> DataFrame:
    fault = F.col("event_type").isin("view", "click")
    return events.select((F.col("user_id") % 30).alias("worker"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"), "event_id", fault.alias("fault"))


@query(_WATCH_SQL + _BEATS_SQL)
def stream_watch(t: Tables) -> DataFrame:
    """What the watcher reports of the events, as a stream with state and timers."""
    with watch.rocksdb(t.spark):
        found = _drained(t, watch.watched(_worked(_events(t)), "worker", "at", "event_id", "fault", _LIMITS), "append")
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(_WATCH_SQL.rstrip(",\n") + " SELECT * FROM pauses")
def watch_gaps(t: Tables) -> DataFrame:
    """The stalls, retries and ends of the same workers, in batch form."""
    return watch.gaps(_worked(t.events), "worker", "at", "event_id", _LIMITS).withColumn("at", F.col("at").cast("timestamp_ntz"))


# Rows of the first arrival are those before January 20 whose id doesn't end in 0; by the second, the watermark has closed days.
_ARRIVALS_SQL = """WITH e AS (SELECT event_id, ts, concat_ws('/', event_type, user_id % 20) AS content, date_trunc('day', ts) + INTERVAL 1 DAY AS w, ts < TIMESTAMP '2024-01-20' AND event_id % 10 <> 0 AS early FROM events),
m AS (SELECT max(ts) FILTER (early) - INTERVAL 1 HOUR AS first_mark, max(ts) - INTERVAL 1 HOUR AS last_mark FROM e),
counted AS (SELECT e.* FROM e, m WHERE early OR w > coalesce(first_mark, TIMESTAMP '1970-01-01')),
closed AS (SELECT counted.* FROM counted, m WHERE w <= last_mark)
"""


def _arrived(t: Tables, derive: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[str, int]]:
    """What a derivation of the events gives when they come in two arrivals, the second with late rows, and what was observed."""
    events = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("/", "event_type", (F.col("user_id") % 20).cast("string")).alias("content"))
    early = (F.col("ts") < F.lit("2024-01-20").cast("timestamp")) & (F.col("event_id") % 10 != 0)
    path, checkpoint = folder(t.spark, "arrivals"), folder(t.spark, "streams")
    with fanout.Observed(t.spark) as seen:
        for now in (early, ~early):
            events.where(now).write.mode("append").parquet(path)
            rows = streams.new_files(t.spark, path, events.schema, per_trigger=10**6).observe("arrived", F.count("*").alias("rows_in"))
            found = streams.drain(derive(rows), "drained", checkpoint)
    return found, dict(seen.sums)


@query(_ARRIVALS_SQL + """SELECT c.event_id, CASE WHEN f.first % 5 <> 2 THEN f.first END AS first FROM closed c JOIN (SELECT w, content, arg_min(event_id, (ts, event_id)) AS first FROM closed GROUP BY 1, 2) f USING (w, content)""")
def stream_fan_out(t: Tables) -> DataFrame:
    """Each row with the first one of its content and day, null where that one's work failed; late rows are not there."""
    done = lambda rows: fanout.once(rows, "content", "ts", "event_id").where("first % 5 <> 2").drop("n")
    return _arrived(t, lambda rows: fanout.fan_out(rows, done(rows), "content", "ts", "event_id"))[0].select("event_id", "first")


@query(_ARRIVALS_SQL.rstrip() + """, k AS (SELECT count(*) AS rows_in, count(*) FILTER (NOT early AND ts <= date_trunc('millisecond', first_mark + INTERVAL 1 HOUR) - INTERVAL 1 HOUR) AS late FROM e, m)
SELECT rows_in, rows_in - late AS kept, late FROM k""")
def stream_late_rows(t: Tables) -> DataFrame:
    """How many rows came, were kept, and were dropped as later than the watermark allows."""
    found, sums = _arrived(t, lambda rows: streams.first_of_each(rows, "event_id", "ts", "1 hour").select("event_id"))
    return found.agg(F.count("*").alias("kept")).select(F.lit(sums.get("rows_in", 0)).cast("long").alias("rows_in"), "kept", F.lit(sums.get("late", 0)).cast("long").alias("late"))


@query()
def unique_one_to_one(t: Tables) -> DataFrame:
    """Greedy one-to-one pairs of purchases and views of a user, in order of purchases."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = t.events.select("user_id", "event_id", "event_type", at.alias("tm"))
    a = rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a"), F.col("tm").alias("ta"))
    b = rows.where("event_type = 'view'").select("user_id", F.col("event_id").alias("b"), F.col("tm").alias("tb"))
    # candidates of a day only: cells of a day and its neighbours
    a = a.withColumn("cell", F.explode(F.array(*(F.floor(F.col("ta") / 86400) + k for k in (-1, 0, 1)))))
    b = b.withColumn("cell", F.floor(F.col("tb") / 86400))
    pairs = a.join(b, ["user_id", "cell"]).withColumn("cost", F.abs(F.col("ta") - F.col("tb"))).where("cost <= 86400")
    return greedy.one_to_one(pairs, "user_id", "a", "b", "cost", "ta")
