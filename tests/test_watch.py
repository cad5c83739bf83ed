import datetime
import random

from pyspark.sql import functions as F

from calathea.operators import monitor
from calathea.operators.durable import folder
from calathea.streaming import streams, watch
from calathea.streaming.watch import Limits

LIMITS = Limits(stall=600, beat=200, every=5, faults=3, base=30, cap=200, tries=4)
START = datetime.datetime(2024, 3, 1, tzinfo=datetime.timezone.utc)


def events(seed, n=150):
    """(worker, at, number, fault): bursts with pauses from seconds to hours."""
    rnd, rows = random.Random(seed), []
    for w in ("a", "b", "c"):
        t = rnd.randrange(100)
        for _ in range(n // 3):
            t += rnd.choice([0, 1, 30, 200, 599, 600, 601, 1200, 9000])
            rows.append((w, START + datetime.timedelta(seconds=t), len(rows), rnd.random() < 0.5))
    return rows


def model(rows, limits, until):
    """Second by second over all workers."""
    out = []
    by = {}
    for w, at, number, fault in rows:
        by.setdefault(w, []).append((int((at - START).total_seconds()), number, fault))
    for w, own in by.items():
        own.sort()
        n = run = stalls = 0
        opened = running = waiting = False
        beat = due = None
        at = 0
        for t in range(until + 1):
            while at < len(own) and own[at][0] == t:
                _, number, fault = own[at]
                at, n, run, stalls, waiting, due = at + 1, n + 1, run + 1 if fault else 0, 0, False, t + limits.stall
                if not running:
                    running, beat = True, t + limits.beat
                if run == limits.faults and not opened:
                    opened = True
                    out.append((w, t, "breaker", number))
                if n % limits.every == 0:
                    beat = t + limits.beat
                    out.append((w, t, "heartbeat", n))
            if beat == t:
                beat = t + limits.beat
                out.append((w, t, "heartbeat", n))
            if due == t and waiting:
                waiting, due = False, t + limits.stall
                out.append((w, t, "retry", stalls))
            elif due == t:
                stalls, running, beat = stalls + 1, False, None
                out.append((w, t, "stall", stalls))
                due = t + min(limits.base * 2**stalls, limits.cap)
                waiting = True
                if stalls == limits.tries:
                    due = None
                    out.append((w, t, "gone", stalls))
    return sorted(out)


def plain(frame, worker="worker"):
    return sorted((r[worker], int((r.at.replace(tzinfo=datetime.timezone.utc) - START).total_seconds()), r.kind, r.number) for r in frame.select(worker, "kind", "number", F.col("at").cast("timestamp_ntz").alias("at")).collect())


def test_state_against_seconds():
    for seed in range(20):
        rows = events(seed, 60)
        until = int((max(r[1] for r in rows) - START).total_seconds())
        got = []
        for w in ("a", "b", "c"):
            state = watch.Watch()
            for _, at, number, fault in sorted(r for r in rows if r[0] == w):
                got += [(w, *x) for x in state.row(int((at - START).total_seconds()) * watch.US, number, fault, LIMITS)]
            got += [(w, *x) for x in state.advance(until * watch.US + 1, LIMITS)]
        assert sorted((w, t // watch.US, k, n) for w, t, k, n in got) == model(rows, LIMITS, until)


def run(spark, path, late, checkpoint):
    with watch.rocksdb(spark):
        return streams.drain(stream(spark, path, late), "watch", checkpoint)


def stream(spark, path, late):
    rows = streams.new_files(spark, path, "worker string, at timestamp, number long, fault boolean", per_trigger=1)
    return watch.watched(rows, "worker", "at", "number", "fault", LIMITS, late)


def written(spark, rows, path):
    spark.createDataFrame(rows, "worker string, at timestamp, number long, fault boolean").coalesce(1).write.mode("append").parquet(path)


def test_stream_in_batches_and_after_a_restart(spark):
    """Rows out of order within the delay, over three runs from one checkpoint: as if all had come at once."""
    rows = events(1)
    rows.sort(key=lambda r: (r[1], r[2]))
    rnd = random.Random(2)
    shuffled = sorted(rows, key=lambda r: r[1] + datetime.timedelta(seconds=rnd.randrange(900)))
    last = max(r[1] for r in rows)
    path, checkpoint = folder(spark, "watch-in"), folder(spark, "watch-checkpoint")
    for k in range(3):
        part = shuffled[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        if k == 2:  # a row far ahead moves the watermark past all others
            part = [*part, ("z", last + datetime.timedelta(seconds=900), 10**6, None), (None, last, 0, False), ("a", None, 0, False)]
        written(spark, part, path)
        found = run(spark, path, "900 seconds", checkpoint)
    until = int((last - START).total_seconds())
    assert [r for r in plain(found) if r[0] != "z"] == model(rows, LIMITS, until)
    again = run(spark, path, "900 seconds", checkpoint)
    assert plain(again) == plain(found)


def test_batch_forms(spark):
    rows = events(3)
    frame = spark.createDataFrame(rows, "worker string, at timestamp, number long, fault boolean")
    until = int((max(r[1] for r in rows) - START).total_seconds())
    want = model(rows, LIMITS, until)
    assert plain(watch.gaps(frame, "worker", "at", "number", LIMITS)) == [r for r in want if r[2] in ("stall", "retry", "gone")]
    order = frame.withColumn("fault", F.when(F.col("fault"), "storage")).withColumn("order", F.struct("at", "number"))
    opened = monitor.breaker(order, "worker", "order", "fault", LIMITS.faults)
    assert sorted((r.worker, r.opened.number) for r in opened.collect()) == sorted((w, n) for w, _, k, n in want if k == "breaker")


def test_late_rows_do_not_count(spark):
    path, checkpoint = folder(spark, "watch-in"), folder(spark, "watch-checkpoint")
    at = lambda s: START + datetime.timedelta(seconds=s)
    written(spark, [("a", at(0), 1, False), ("a", at(5000), 2, False)], path)
    run(spark, path, "100 seconds", checkpoint)
    written(spark, [("a", at(300), 3, True), ("a", at(4950), 4, False), ("a", at(5200), 5, False)], path)
    found = run(spark, path, "100 seconds", checkpoint)
    counted = [("a", at(s), n, False) for s, n in ((0, 1), (4950, 4), (5000, 2))]
    assert plain(found) == model(counted, LIMITS, 5100)
