import zlib

from pyspark.sql import functions as F

import corpus_pipeline as P
from calathea.llm import tokens
from calathea.llm.queries import ORACLES, QUERIES


def test_registry():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{k}" for k in range(1, 14)), "pipeline"} and set(ORACLES) <= set(QUERIES)
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None


def test_stages_act(spark, docs, tmp_path):
    base = " ".join(f"w{k}" for k in range(90))
    rows = [(1, base), (2, base), (3, base + " more"), (4, "too short"), (5, " ".join(f"v{k} a@b.com" for k in range(60))), (6, " ".join("#$% ***" for _ in range(80)))]
    rows += [(10 + i, " ".join(f"x{i}y{k}" for k in range(60 + i))) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    columns, seen = docs.columns, []
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = f"file://{tmp_path}/{len(seen)}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append((name, docs))
    assert all(d.columns == columns for _, d in seen[:-1])
    assert not {4, 6} & {r.doc_id for r in seen[0][1].collect()} and {1, 2, 3, 5} <= {r.doc_id for r in seen[0][1].collect()}
    assert {1, 2, 3} & {r.doc_id for r in seen[1][1].collect()} == {1}
    assert all("a@b.com" not in r.text and len(r.text) == r.n_chars for r in seen[2][1].collect())
    mixed = [r.doc_id for r in seen[3][1].collect()]
    assert set(mixed) <= {r.doc_id for r in seen[2][1].collect()}
    own = tokens.encoder().tokenizer
    total = sum(len(own.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen[3][1].collect())
    assert sum(r.length for r in seen[4][1].collect()) == total and zlib.crc32(b"") == 0


def test_mixing_takes_rows_without_an_id_and_each_of_equal_ids(spark, tmp_path):
    rows = [(None, "w " * 5, "a"), (7, "x " * 3, "a"), (7, "y " * 90, "b"), (7, "z " * 90, "b"), (None, "v " * 4, None), (8, "u " * 40, "b")]
    rows += [(100 + k, f"t{k} " * (k % 5 + 1), "ab"[k % 2]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((str(r.doc_id), r.source or "", len(r.text.split())) for r in P.mixture(spark, docs, str(tmp_path)).collect())
    want = [(str(r.doc_id), r.source or "", r["size"]) for r in P.mix(docs).collect() for _ in range(r.copies)]
    assert got == sorted(want) and any(i == "None" for i, _, _ in got)


def test_mixing_shares_copies_out_among_rows_alike(spark, tmp_path):
    """Most rows are one row: they are numbered without being gathered, and each keeps its share."""
    rows = [(7, "x y z", "a")] * 300 + [(k, f"t{k} " * (k % 5 + 1), "ab"[k % 2]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = P.mixture(spark, docs, str(tmp_path)).groupBy("doc_id", "source").count().collect()
    want = {(r.doc_id, r.source): r.n for r in P.mix(docs).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).where("n > 0").collect()}
    assert {(r.doc_id, r.source): r["count"] for r in got} == want
