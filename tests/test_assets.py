"""Boundary rows of the asset operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from calathea.operators import assets, geo, windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("seconds", "want"), [(0.999, "A2a"), (1.0, "A2b"), (2.999, "A2b"), (3.0, None), (None, None)])
def test_clip_tiers(spark, seconds, want):
    df = spark.createDataFrame([("mov", None, seconds)], "k string, live boolean, s double")
    assert df.select(assets.clip_tier(F.col("k"), F.col("live"), F.col("s")).alias("t")).first().t == want


def test_protected_is_null_safe(spark):
    df = spark.createDataFrame([(1, "/a/x_SINGULAR_DISPLAY.jpg", None), (2, "/a/y.jpg", None), (3, None, "Glasses"), (4, "/Work/z.jpg", "Phone")], "id int, p string, m string")
    got = df.where(assets.protected(F.col("p"), F.col("m"), ["Glasses"], ["/work/"])).select("id")
    assert rows(got) == [(1,), (3,), (4,)]


def test_manifest_order(spark):
    cut = spark.createDataFrame([(1, 10), (2, 30), (3, 20)], "id int, size int")
    clips = spark.createDataFrame([(3, 9), (7, 8)], "a int, b int")
    assert [(r.id, r.role) for r in assets.manifest(cut, clips, "id", "size", "a", "b").collect()] == [(2, "still"), (3, "still"), (9, "live_motion"), (1, "still")]


def test_orders(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], None if i % 3 else float(i)) for i in range(12)], "id long, src string, score double")
    assert [r.id for r in assets.in_order(df, [5, 1, 99, 7], "id").collect()] == [5, 1, 7]
    assert [r.id for r in assets.best_then_random(df, "score", "id", 1, 5).collect()][:4] == [9, 6, 3, 0]
    assert {r.src for r in assets.prioritised(df, "src", ["b"], "id", 1, 6).collect()} == {"b"}


def test_live_pairs(spark):
    data = [
        (1, "u", "A.HEIC", "HEIC", 0, False), (2, "u", "A.MOV", "MOV", 0, True), (3, "v", "B.HEIC", "HEIC", 0, False), (4, "v", "B.JPG", "JPG", 0, False), (5, "v", "C.MOV", "MOV", 0, True),
        (6, None, "D.HEIC", "HEIC", 0, False), (7, None, "D_HEVC.MOV", "MOV", 10**9, True), (8, None, "E.HEIC", "HEIC", 0, False), (9, None, "E.JPG", "JPG", 90_000, False),
        (10, None, "E.MOV", "MOV", 86_400, True), (11, None, "E.MOV", "MOV", 86_401, True), (12, None, "F.MOV", "MOV", 0, False),
    ]
    df = spark.createDataFrame(data, "id long, uuid string, name string, kind string, ts long, live boolean")
    assert rows(assets.live_pairs(df, "id", "uuid", "name", "kind", "ts", "live").select("still", "mov", "method")) == [(1, 2, "uuid"), (6, 7, "name"), (9, 10, "name")]


def test_edits_and_heroes(spark):
    df = spark.createDataFrame([(1, 1, "original"), (2, 1, "edit"), (3, 2, "original"), (4, 2, None)], "id int, g int, role string")
    assert rows(assets.edit_marks(df, "id", "g", "role")) == [(1, False, True), (2, True, False), (3, False, False), (4, False, False)]
    shots = spark.createDataFrame([(1, 1, None, 5.0, True), (2, 1, None, 9.0, False), (3, 2, 0.1, 1.0, True), (4, 2, None, 8.0, True), (5, 3, None, None, True)], "id int, g int, score double, blur double, still boolean")
    assert rows(assets.hero(shots, ["g"], "id", "score", "blur", "still").fillna(-1)) == [(1, 1), (2, 3), (3, -1)]


def test_groups_and_seeds(spark):
    df = spark.createDataFrame([(1, 1.0, "x"), (2, 1.0, "x"), (3, None, "x"), (4, None, "x"), (5, 1.0, "ERR: y"), (6, 1.0, "ERR: y"), (7, 2.0, None)], "id int, d double, h string")
    assert rows(assets.duplicate_groups(df, [F.col("d")], "h", "id")) == [(1, 1), (2, 1), (3, 3), (4, 3)]
    names = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "c")], "asset int, person string")
    faces = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (3, 31)], "asset int, face int")
    assert rows(assets.single_seeds(names, faces, "asset", "person", "face")) == [(1, "a", 10)]


def test_head_against_numpy(spark):
    rng = np.random.default_rng(0)
    layers = [(rng.normal(size=(4, 3)), rng.normal(size=3)), (rng.normal(size=(3, 1)), rng.normal(size=1))]
    x = rng.normal(size=(5, 4))
    from math import erf

    hidden = x @ layers[0][0] + layers[0][1]
    hidden = hidden * 0.5 * (1 + np.vectorize(erf)(hidden / np.sqrt(2)))
    want = 1 / (1 + np.exp(-(hidden @ layers[1][0] + layers[1][1])[:, 0]))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = [r.score for r in assets.head_scores(df, "id", "v", layers).orderBy("id").collect()]
    assert np.abs(np.array(got) - want).max() < 1e-6


def test_residence_eras(spark):
    homes = [{"lat": 0.0, "lon": 0.0, "start": "2020-01", "end": "2020-06"}, {"lat": 10.0, "lon": 0.0, "start": "2020-07", "end": None}]
    df = spark.createDataFrame([("2019-12", 0.0), ("2020-06", 0.0), ("2020-07", 0.0), ("2030-01", 10.0)], "ym string, lat double").withColumn("lon", F.lit(0.0))
    got = geo.home_distance(df, homes).orderBy("ym").collect()
    assert [r.home for r in got] == [False, True, False, True] and got[0].dist is None and got[2].dist > 1000


def test_even_samples_include_ends(spark):
    df = spark.range(17).withColumn("g", F.lit(1))
    got = [r.id for r in windows.even_sample(df, ["g"], [F.col("id")], 5).orderBy("id").collect()]
    assert got == [i * 16 // 4 for i in range(5)]


def test_a_clip_falls_back_by_its_own_name(spark):
    """A size suffix is dropped to look a name up, not to find a clip's still."""
    from calathea.operators import matching

    own = spark.createDataFrame([(1, "a-42.mov", 42, None, True), (2, "b_hevc.mov", 7, None, True)], "asset int, name string, size int, at long, is_clip boolean")
    records = spark.createDataFrame([(10, "a.jpg", "a", 42, None), (11, "b.jpg", "b", 7, None)], "record int, name string, base string, size int, at long")
    assert [(r.asset, r.record, r.tier) for r in matching.sized(own, records).collect()] == [(2, 11, "clip")]


def test_marks_and_digests(spark):
    from calathea.functions import scalars as S
    from calathea.operators import sets

    rows = spark.createDataFrame([(1, None, None), (2, "x", None), (1, "y", None)], "id int, a string, b string")
    assert sorted((r.id, r.m) for r in sets.flagged(rows, "m", spark.createDataFrame([(1,), (1,), (None,)], "id int")).collect()) == [(1, True), (1, True), (2, False)]
    assert [r[0] for r in rows.select(assets.bare(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    doubt = spark.createDataFrame([(93.6, 46.8), (93.5, 1.0), (100.0, 51.0), (None, 1.0)], "c double, w double")
    assert [r[0] for r in doubt.select(S.false_positive(F.col("c"), F.col("w"))).collect()] == [True, False, False, None]
    import hashlib

    contents = [b"abcdefgh", b"abc", b"", b"abcdef"]
    frame = spark.createDataFrame([(bytearray(c),) for c in contents], "c binary")
    edges = [c[:4] + (c[max(4, len(c) - 4) :] if len(c) > 4 else b"") for c in contents]
    assert [r[0] for r in frame.select(S.partial_digest(F.col("c"), 4)).collect()] == [hashlib.sha256(e).hexdigest() for e in edges]
    import math

    v = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [0.0, 1.0])], "v array<double>, g array<double>, b array<double>")
    assert abs(v.select(S.prompt_pair(F.col("v"), F.col("g"), F.col("b"), 0.5)).first()[0] - 1 / (1 + math.exp(-2))) < 1e-12


def test_upserts_of_repeated_keys(spark):
    from calathea.operators import mutation

    old, new = (spark.createDataFrame(x, "k int, v int") for x in ([(1, 0), (2, 0)], [(2, 5), (2, 7), (3, 1), (3, 1)]))
    assert sorted(map(tuple, mutation.upsert(old, new, ["k"], [F.desc("v")]).collect())) == [(1, 0), (2, 7), (3, 1)]
    assert sorted(r.k for r in mutation.upsert(old, new, ["k"]).collect()) == [1, 2, 3]
