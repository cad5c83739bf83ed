import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from calathea.llm import exact_dedup
from calathea.llm.exact_dedup import exact_copies, normalised


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def model(rows):
    """(id, keep_id, group_size) of each row, and how many rows each group keeps."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append(i)
    keep = {t: min(ids, key=lambda i: (i is None, i or 0)) for t, ids in groups.items()}
    return sorted(((i, keep[plain(t)], len(groups[plain(t)]), plain(t)) for i, t in rows), key=repr), groups


def check(found, rows):
    got = found.select("doc_id", "keep_id", "group_size", normalised(F.col("text")).alias("t"), "kept").collect()
    want, groups = model(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.t) for r in got), key=repr) == want
    kept = [r for r in got if r.kept]
    assert sorted(r.t for r in kept) == sorted(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_awkward_rows(docs, corpus):
    found = exact_copies(docs)
    assert found.columns == [*docs.columns, "keep_id", "group_size", "kept"]
    check(found, [(i, t) for i, t, _ in corpus])


def test_refinement(spark, monkeypatch):
    """Equal lengths, equal beginnings, equal texts, and a bitmap of so few bits that all rows are hashed."""
    rnd = random.Random(1)
    texts = ["a" * n for n in range(30)] + ["b" * 100 + rnd.choice("xyz") * 3 for _ in range(40)] + ["c \t c", "c c", "c  c", " c c", "c c", "c c "]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "c c"), (None, None), (3, "aaa"), (3, "aaa")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check(exact_copies(frame), rows)
    monkeypatch.setattr(exact_dedup, "BITS", 2)
    check(exact_copies(frame), rows)


def test_only_surviving_groups_are_hashed(spark):
    rows = [(k, "x" * k) for k in range(50)] + [(100 + k, f"{k:02d}" + "y" * 70) for k in range(20)] + [(200, "same"), (201, "same"), (202, "diff")]
    keys = spark.createDataFrame([(4, h) for h in ["same"]], "len int, text string").select("len", F.xxhash64("text").alias("head"))
    frame = spark.createDataFrame(rows, "id long, text string").select("id", F.char_length("text").alias("len"), F.xxhash64(F.substring("text", 1, 64)).alias("head"))
    assert {r.id for r in exact_dedup.marked(frame, keys).where("open").collect()} == {200, 201}


def test_hot_group_and_ties(spark):
    rows = [(7, "one text")] * 300 + [(9, "one  text")] * 200 + [(k, f"text {k}") for k in range(100)]
    check(exact_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)), rows)


def test_clashing_names_and_nothing(spark, nothing):
    frame = spark.createDataFrame([(1, "a", 5, "k", None), (2, "a", 6, None, 1.0)], "doc_id long, text string, keep_id int, kept string, `own.c0` double")
    found = exact_copies(frame)
    assert found.columns == [*frame.columns, "keep_id_", "group_size", "kept_"]
    assert sorted((r.doc_id, r.keep_id, r.kept, r["own.c0"], r.keep_id_, r.group_size, r.kept_) for r in found.collect()) == [(1, 5, "k", None, 1, 2, True), (2, 6, None, 1.0, 1, 2, False)]
    assert exact_copies(nothing).count() == 0
    assert exact_copies(spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")).where("kept and group_size = 3").count() == 1


def test_native(docs):
    plan = exact_copies(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_query_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from calathea.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cur = con.execute(ORACLES["op13_exact_dedup"])
    names = [d[0] for d in cur.description]
    found = QUERIES["op13_exact_dedup"](spark, sf)
    assert sorted(map(tuple, found.select(names).collect())) == sorted(cur.fetchall())
    one = found.where("group_size = 1").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id") == one.doc_id).first().text
    assert one.text_sha256 == hashlib.sha256(plain(text).encode()).hexdigest()
