import numpy as np
import pytest

from calathea.sources import readers


def test_csv_sources(spark, tmp_path):
    assert readers.csv_or_empty(spark, f"file://{tmp_path}/none.csv", "a int").count() == 0
    (tmp_path / "x.csv").write_text("junk\nuuid,name\n0a1b2c3d-0000,one\nnot a row\n0a1b2c3e-0000,two\n")
    found = readers.csv_after_junk(spark, f"file://{tmp_path}/x.csv", ["name"], "[0-9a-f]{8}-[0-9a-f]{4}")
    assert [r.name for r in found.orderBy("name").collect()] == ["one", "two"]
    with pytest.raises(ValueError, match="no column date"):
        readers.csv_after_junk(spark, f"file://{tmp_path}/x.csv", ["date"], "[0-9a-f]{8}-")


def test_jsonl_drops_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"uuid": "a", "n": 1}\nbad\n{"n": 2}\n')
    assert [tuple(r) for r in readers.jsonl(spark, f"file://{tmp_path}/x.jsonl", "uuid string, n int", "uuid").collect()] == [("a", 1)]


def test_files_and_snapshot(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.JPG").write_bytes(b"12")
    (tmp_path / "in" / "sub" / "b.txt").write_bytes(b"1")
    found = readers.files(spark, f"file://{tmp_path}/in", ["JPG"]).collect()
    assert [(r.name, r.size) for r in found] == [("a.JPG", 2)]
    manifest = readers.snapshot({"t": spark.range(4)}, f"file://{tmp_path}/snap").first()
    assert (manifest.name, manifest.rows) == ("t", 4)


def test_packed_labels(spark):
    ids, scores = np.array([7, 9], "<u4").tobytes(), np.array([0.5, 0.25], "<f2").tobytes()
    items = spark.createDataFrame([(1, bytearray(ids), bytearray(scores)), (2, None, None)], "k int, i binary, s binary")
    lexicon = spark.createDataFrame([(7, "c", "seven"), (9, "c", "nine")], "lexeme_id long, category string, content string")
    assert sorted((r.k, r.place, r.content, r.score) for r in readers.packed_labels(items, "k", "i", "s", lexicon).collect()) == [(1, 0, "seven", 0.5), (1, 1, "nine", 0.25)]


def test_shards_check_provenance(spark, tmp_path):
    np.savez(tmp_path / "a.npz", asset_id=np.array([1, 2]), embedding=np.ones((2, 3), "f4"), det_score=np.ones(2, "f4"), model="m1")
    assert readers.vector_shards(spark, f"file://{tmp_path}", {"model": "m1"}).count() == 2
    with pytest.raises(Exception, match="not m2"):
        readers.vector_shards(spark, f"file://{tmp_path}", {"model": "m2"}).count()


def test_bundles(spark, tmp_path):
    import json
    import tarfile

    inner = tmp_path / "b"
    inner.mkdir()
    (inner / "records.jsonl").write_text('{"uuid": "a"}\n{"n": 1}\n')
    (inner / "manifest.json").write_text(json.dumps({"search_index": {"filename": "own.sqlite"}}))
    (inner / "own.sqlite").write_bytes(b"x")
    with tarfile.open(tmp_path / "b.tgz", "w:gz") as t:
        for f in inner.iterdir():
            t.add(f, f.name)
    for path in (inner, tmp_path / "b.tgz"):
        records, index, manifest = readers.bundle(spark, f"file://{path}", "uuid string, n int", "uuid")
        assert [r.uuid for r in records.collect()] == ["a"] and index.endswith("own.sqlite") and "search_index" in manifest
    (inner / "records.jsonl").unlink()
    with pytest.raises(ValueError, match="no records"):
        readers.bundle(spark, f"file://{inner}", "uuid string", "uuid")


def test_snapshots_are_kept_and_mirrored(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        readers.snapshot({"t": spark.range(3), "u": spark.range(2)}, f"file://{tmp_path}/s/{day}")
    assert all(r.intact for r in readers.intact(spark, f"file://{tmp_path}/s/2024-01-02").collect())
    (tmp_path / "m" / "2020-01-01").mkdir(parents=True)
    import os

    os.utime(tmp_path / "m" / "2020-01-01", (0, 0))
    gone = readers.mirror(spark, f"file://{tmp_path}/s/2024-01-03", f"file://{tmp_path}/m", 30, 10**9)
    assert gone == ["2020-01-01"] and sorted(os.listdir(tmp_path / "m")) == ["2024-01-03"]
    assert readers.retain(spark, f"file://{tmp_path}/s", 2) == ["2024-01-01"]
    part = next((tmp_path / "s" / "2024-01-02" / "t").glob("*.parquet"))
    part.write_bytes(part.read_bytes()[:-1] + b"x")
    (tmp_path / "s" / "2024-01-02" / "t" / f".{part.name}.crc").unlink(missing_ok=True)
    assert {r.name: r.intact for r in readers.intact(spark, f"file://{tmp_path}/s/2024-01-02").collect()} == {"t": False, "u": True}


def test_json_lines_and_counts(spark, tmp_path):
    readers.write_jsonl(spark.range(3), f"file://{tmp_path}/j")
    assert readers.jsonl(spark, f"file://{tmp_path}/j", "id long", "id").count() == 3
    readers.write_csv(spark.range(30).repartition(3), f"file://{tmp_path}/c", most=10)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").count() == 30
    counted = readers.CachedCount(spark, f"file://{tmp_path}/c", 3600)
    n = counted.get()
    (tmp_path / "c" / "more.txt").write_text("x")
    assert counted.get() == n


def test_appends_are_whole_and_come_once(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    read = lambda kind: sorted(r[0] for r in readers.committed(spark, path, "k long", kind).collect())
    assert read("rows") == read("keys") == []
    assert readers.append_processed(spark.range(2).toDF("k"), spark.range(4).toDF("k"), path, "b1")
    assert not readers.append_processed(spark.range(2).toDF("k"), spark.range(4).toDF("k"), path, "b1")
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="lost"):
        readers.append_processed(spark.range(9).toDF("k"), spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("k")), path, "b2")
    assert read("rows") == [0, 1] and read("keys") == [0, 1, 2, 3]
    assert readers.append_processed(spark.range(5, 6).toDF("k"), spark.range(5, 7).toDF("k"), path, "b2")
    assert read("rows") == [0, 1, 5] and read("keys") == [0, 1, 2, 3, 5, 6]


def test_counts_are_shared_and_failures_held_off(spark, tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    calls = []
    monkeypatch.setattr(readers, "files", lambda s, p: calls.append(p) or spark.range(3).selectExpr("id as path"))
    counted = readers.CachedCount(spark, "x", 3600)
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(lambda _: counted.get(), range(8))) == [3] * 8
    assert len(calls) == 1

    def broken(s, p):
        calls.append(p)
        raise RuntimeError("mount is gone")

    monkeypatch.setattr(readers, "files", broken)
    counted.due = 0.0
    assert counted.get() == counted.get() == 3 and len(calls) == 2
    with pytest.raises(OSError, match="cannot be counted"):
        readers.CachedCount(spark, "y").get()


def test_csv_fields_over_several_lines(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.csv").write_text('warning: uuid\nuuid,name,note\n0a1b2c3d-0000,one,"a, b\nc ""q"""\nnot a row,x,y\n0a1b2c3e-0000,short\n0a1b2c3f-0000,two,\n')
    (tmp_path / "d" / "y.csv").write_text("uuid,name,note\n0a1b2c40-0000,three,é,more\n")
    found = readers.csv_after_junk(spark, f"file://{tmp_path}/d", ["name", "note"], "[0-9a-f]{8}-", multi_line=True)
    assert sorted(map(tuple, found.collect())) == [("0a1b2c3d-0000", "one", 'a, b\nc "q"'), ("0a1b2c3f-0000", "two", ""), ("0a1b2c40-0000", "three", "é")]
