"""Streams against their batch forms."""

from pyspark.sql import functions as F

from calathea.operators.mutation import latest
from calathea.streaming import streams

from .test_operators import throttled


def test_throttle_keeps_state_between_batches(spark, tmp_path):
    temperatures = [79, 80, 81, None, 82, 76, 75, 74, 84, 85, 86, 90]
    folder = f"file://{tmp_path}/in"
    rows = [(m, i, None if t is None else float(t + m), 5.0) for i, t in enumerate(temperatures) for m in (0, 1)]
    df = spark.createDataFrame(rows, "machine long, n long, t double, margin double")
    for part in (df.where("n < 5"), df.where("n >= 5")):  # two files, a batch each, in order of arrival
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = streams.drain(streams.throttle(stream, "machine", "n", "t", "margin"), "throttled", f"file://{tmp_path}/cp")
    got = {(r.machine, r.n): r.action for r in found.collect()}
    for m in (0, 1):
        assert [got[m, i] for i in range(len(temperatures))] == throttled([(None if t is None else t + m, 5.0) for t in temperatures])


def test_upserts_by_batch(spark, tmp_path):
    folder, log = f"file://{tmp_path}/in", f"file://{tmp_path}/log"
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, at int, v string")
    df.write.parquet(folder)
    stream = streams.new_files(spark, folder, df.schema)
    streams.upsert_batches(stream, log, "k", "at", f"file://{tmp_path}/cp")
    spark.createDataFrame([(1, 3, "d")], df.schema).write.mode("append").parquet(folder)
    streams.upsert_batches(streams.new_files(spark, folder, df.schema), log, "k", "at", f"file://{tmp_path}/cp")
    rows = spark.read.parquet(log)
    assert rows.count() == 3  # the second run reads the new file only
    assert sorted((r.k, r.v) for r in latest(rows, ["k"], [F.desc("at")]).collect()) == [(1, "d"), (2, "c")]


def test_equal_contents_once(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    df = spark.sql("select 'x' as h, timestamp'2024-01-01 00:00:00' as ts union all select 'x', timestamp'2024-01-01 01:00:00' union all select 'y', timestamp'2024-01-01 02:00:00'")
    df.write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    assert streams.drain(streams.first_of_each(stream, "h", "ts"), "firsts", f"file://{tmp_path}/cp").count() == 2
