import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from calathea.operators.durable import folder
from calathea.sources import shards
from calathea.streaming import streams

ROWS = "asset_id long, embedding array<float>, det_score float"


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    shards.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def save(path, ids, value=1.0, **made):
    np.savez(path, asset_id=np.array(ids), embedding=np.full((len(ids), 3), value, "f4"), det_score=np.ones(len(ids), "f4"), **{"model": "m1", **made})


def read(spark, path, **options):
    return spark.read.format("vector_shards").options(**options).load(f"file://{path}")


def append(frame, path, batch, **options):
    frame.write.format("vector_shards").option("batch", batch).options(**options).mode("append").save(f"file://{path}")


def test_reads_plain_folders(spark, tmp_path):
    save(tmp_path / "a.npz", [1, 2])
    save(tmp_path / "b.npz", [3], 2.0)
    found = read(spark, tmp_path, **{"expect.model": "m1", "rows": "1"})
    assert sorted((r.shard, r.asset_id, list(r.embedding)) for r in found.collect()) == [("a.npz", 1, [1.0] * 3), ("a.npz", 2, [1.0] * 3), ("b.npz", 3, [2.0] * 3)]
    with pytest.raises(Exception, match="not m2"):
        read(spark, tmp_path, **{"expect.model": "m2"}).count()
    assert read(spark, tmp_path / "none").count() == 0


def test_filters_reach_the_shards(spark, tmp_path):
    save(tmp_path / "a.npz", [1, 2, 3])
    # ids that can be read, vectors that cannot
    np.savez(tmp_path / "b.npz", asset_id=np.array([50]), embedding=np.array([None], dtype=object), det_score=np.ones(1, "f4"))
    (tmp_path / "c.npz").write_bytes(b"no shard")
    some = read(spark, tmp_path)
    assert [r.asset_id for r in some.where("shard in ('a.npz', 'b.npz') and asset_id < 3 and asset_id > 1").collect()] == [2]
    assert some.where("shard = 'a.npz' and asset_id in (3, 9)").count() == 1
    assert some.where("shard like 'a%' and det_score > 0.5").count() == 3
    assert some.where("shard = 'x'").count() == 0
    with pytest.raises(Exception, match="(?i)pickle|object"):
        some.where("shard = 'b.npz' and asset_id = 50").collect()


def test_writes_all_or_nothing(spark, tmp_path):
    path = tmp_path / "out"
    rows = spark.createDataFrame([(1, [1.0, 2.0], 0.5), (1, [2.0, 2.0], 0.7), (2, None, None), (3, [0.0, 1.0], None)], ROWS).repartition(2)
    append(rows, path, "one", **{"made.model": "m1"})
    read_back = lambda: sorted((r.asset_id, list(r.embedding)) for r in read(spark, path, **{"expect.model": "m1"}).collect())
    want = [(1, [1.0, 2.0]), (1, [2.0, 2.0]), (3, [0.0, 1.0])]
    assert read_back() == want
    append(rows, path, "one", **{"made.model": "m1"})  # again: nothing changes
    assert read_back() == want
    bad = spark.range(40).repartition(4).select(F.col("id").alias("asset_id"), F.array(F.lit(1.0), F.lit(1.0)).cast("array<float>").alias("embedding"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost")).cast("float")).otherwise(F.lit(1.0)).cast("float").alias("det_score"))
    with pytest.raises(Exception, match="lost"):
        append(bad, path, "two", **{"made.model": "m1"})
    assert read_back() == want
    with pytest.raises(Exception, match="lost"):
        append(bad.coalesce(1), path, "two", **{"made.model": "m1"})
    assert read_back() == want
    append(bad.where("asset_id < 5"), path, "two", **{"made.model": "m1"})
    assert len(read_back()) == 8
    failed = shards.ShardWriter({"path": f"file://{path}", "batch": "three"})
    with pytest.raises(ZeroDivisionError):
        failed.write(1 / 0 if k else pa.record_batch([pa.array([7]), pa.array([[1.0]], pa.list_(pa.float32())), pa.array([1.0], pa.float32())], names=["asset_id", "embedding", "det_score"]) for k in (0, 1))
    assert not (path / failed.staged).exists() or os.listdir(path / failed.staged) == []
    assert sorted(r.asset_id for r in shards.processed(spark, f"file://{path}").collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="never overwritten"):
        rows.write.format("vector_shards").mode("overwrite").save(f"file://{path}")


def test_files_without_a_commit_are_not_there(spark, tmp_path):
    append(spark.createDataFrame([(1, [1.0], 1.0)], ROWS), tmp_path, "one")
    save(tmp_path / "orphan.npz", [9])
    assert [r.asset_id for r in read(spark, tmp_path).collect()] == [1]


def test_stream_reads_changed_shards_once_more(spark, tmp_path):
    listings, checkpoint = folder(spark, "listings"), folder(spark, "shards")
    save(tmp_path / "a.npz", [1])
    save(tmp_path / "b.npz", [2])
    # batches of a stream are kept apart by number
    run = lambda: streams.drain(spark.readStream.format("vector_shards").option("listings", listings).load(f"file://{tmp_path}").select("shard", "asset_id", "embedding"), "shards", checkpoint)
    seen = lambda: sorted((r.shard, r.asset_id, r.embedding[0]) for r in run().collect())
    assert seen() == [("a.npz", 1, 1.0), ("b.npz", 2, 1.0)]
    assert seen() == [("a.npz", 1, 1.0), ("b.npz", 2, 1.0)]
    save(tmp_path / "b.npz", [2, 3], 7.0)
    os.utime(tmp_path / "b.npz", (time.time() + 5, time.time() + 5))
    save(tmp_path / "c.npz", [4])
    want = [("a.npz", 1, 1.0), ("b.npz", 2, 1.0), ("b.npz", 2, 7.0), ("b.npz", 3, 7.0), ("c.npz", 4, 1.0)]
    assert seen() == want
    assert seen() == want


def test_stream_takes_no_more_than_its_bound(spark, tmp_path):
    """Back-pressure: what arrives at once is read a few shards at a time, each once."""
    listings, checkpoint = folder(spark, "listings"), folder(spark, "shards")
    for k in range(5):
        save(tmp_path / f"{k}.npz", [k])
    rows = lambda: spark.readStream.format("vector_shards").options(listings=listings, most="2").load(f"file://{tmp_path}").select("asset_id")
    seen = [sorted(r.asset_id for r in streams.drain(rows(), "bounded", checkpoint).collect()) for _ in range(5)]
    assert seen[-1] == [0, 1, 2, 3, 4] and all(len(b) - len(a) <= 2 for a, b in zip([[], *seen], seen, strict=False))
