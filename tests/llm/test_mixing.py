import pytest
from pyspark.sql import functions as F

from calathea.llm import mixing as M

from .conftest import words


def wanted(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, total, capped = {s: k % 3 + 1 for k, s in enumerate(names)}, sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        share = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if share * weight[s] > 3 * sizes[s]]
        if not over:
            return {s: capped.get(s, share * weight[s]) for s in names}
        capped.update({s: 3 * sizes[s] for s in over})


def test_targets_and_sizes(docs, corpus):
    sizes = {}
    for _, t, s in corpus:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    rows = M.mix(docs).collect()
    assert sorted((repr(r.doc_id), r.size) for r in rows) == sorted((repr(i), len(words(t))) for i, t, _ in corpus)
    target, taken = wanted(sizes), {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - target[s]) <= max(len(words(t)) for _, t, x in corpus if x == s)


def test_reruns_agree(docs):
    once, again = (sorted(map(repr, M.mix(d).select("doc_id", "size", "source", "taken").collect())) for d in (docs, docs.repartition(7)))
    assert once == again


@pytest.mark.parametrize("sizes", [{"a": 5}, {"a": 100, "b": 1, "c": 1}, {"a": 0, "b": 9}, {"b": 1, "c": 30, "d": 2, "": 7, None: 4}])
def test_water_level(spark, sizes):
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, docs long")
    assert {r.source: r.target for r in M.targets(rows).collect()} == pytest.approx(wanted(sizes))


def test_levels_and_fairness(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.when(F.col("id") < 100, "a").otherwise("b").alias("source"))
    found = M.mix(rows).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t"), F.max("size").alias("m"), F.count_distinct("copies").alias("kinds")).collect()
    assert all(abs(r.n - r.t) <= r.m and r.kinds <= 2 for r in found)


def test_nothing_and_no_words(spark, nothing):
    assert M.mix(nothing).count() == 0
    rows = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in M.mix(rows).select("doc_id", "size", "target", "taken").collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_many_equal_rows(spark, monkeypatch):
    """A row that most of a source's rows repeat is rounded in chunks; how its copies fall doesn't depend on partitions."""
    monkeypatch.setattr(M, "CHUNK", 7)
    rows = [(5, "w w w", "a")] * 200 + [(None, "x x", "a")] * 90 + [(k, "y " * (k % 7 + 1), "ab"[k % 2]) for k in range(60)] + [(900 + k, "z " * 9, None) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(map(repr, M.mix(d).select("doc_id", "size", "source", "taken").collect())) for d in (df.repartition(1), df.repartition(5), df.repartition(11))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == len(rows)
    found = M.mix(df).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t"), F.max("size").alias("m")).collect()
    assert all(abs(r.n - r.t) <= r.m for r in found)
    equal = M.mix(df).where("doc_id = 5 and source = 'a' and size = 3").groupBy("copies").count().collect()
    assert sum(r["count"] for r in equal) == 200 and len(equal) <= 2
