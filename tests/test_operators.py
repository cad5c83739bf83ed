"""Boundary rows of set, window, match, geo and write operators, and models of the sequential ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from calathea.operators import assets, evaluation, geo, greedy, maps, matching, monitor, mutation, rollups, sets, vectors, windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_exclusion_keeps_null_keys(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    ids = spark.createDataFrame([(1,), (None,)], "id int")
    assert sorted(sets.exclude(df, ids).collect(), key=repr) == sorted([(2,), (None,)], key=repr)


def test_rules_need_true(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, v int")
    assert rows(sets.nominate(df, {"low": F.col("v") < 9, "odd": F.col("v") % 2 == 1})) == [(2, "low"), (2, "odd")]


@pytest.mark.parametrize(("gap", "want"), [(5, 3), (6, 0)])
def test_burst_gap(spark, gap, want):
    df = spark.createDataFrame([(i, "c", i * gap, float(i)) for i in range(6)], "id int, cell string, ts long, blur double")
    assert windows.chain_extras(df, ["cell"], "ts", "id", 5, 3, 3, "blur").count() == want


def test_burst_ranks_nulls_last(spark):
    df = spark.createDataFrame([(1, 0, 0, None), (2, 0, 1, 1.0), (3, 0, 2, 2.0), (4, 0, 3, 2.0)], "id int, c int, ts long, blur double")
    assert [r.id for r in windows.chain_extras(df, ["c"], "ts", "id", 5, 3, 3, "blur").collect()] == [1]


@pytest.mark.parametrize("n", [1, 9, 10, 11, 100])
def test_order_statistic(spark, n):
    df = spark.range(n).select(F.col("id").cast("double").alias("v"))
    assert windows.order_statistic(df, "v", 10).first().threshold == sorted(range(n))[min(n - 1, n * 10 // 100)]


def test_order_statistic_of_nothing(spark):
    assert windows.order_statistic(spark.createDataFrame([], "v double"), "v", 10).count() == 0


def test_numbers_are_global(spark):
    values = [random.Random(1).randrange(50) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v int").repartition(7)
    want = {i: n for n, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)), 1)}
    assert {r.id: r.rn for r in windows.numbered(df, "v", "id").collect()} == want


def test_streak_keeps_over_nulls(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1, 1, None, 1, 0, 1])], "k int, i int, v int")
    assert [r.streak for r in windows.streaks(df, ["k"], ["i"], F.col("v") == 1).orderBy("i").collect()] == [1, 2, 2, 3, 0, 1]


def test_nearest_against_pairs(spark):
    rnd = random.Random(3)
    left = [(i, rnd.randrange(3), rnd.randrange(40)) for i in range(60)] + [(99, 0, None)]
    right = [(100 + i, rnd.randrange(3), rnd.randrange(40)) for i in range(40)]
    a = spark.createDataFrame(left, "a int, k int, t int")
    b = spark.createDataFrame(right, "b int, k int, u int")
    want = {}
    for i, k, t in left:
        near = sorted((abs(t - u), j) for j, q, u in right if q == k) if t is not None else []
        if near:
            want[i] = near[0][1]
    assert {r.a: r.match_b for r in matching.nearest(a, b, ["k"], "t", "u", "a", "b").collect()} == want


@pytest.mark.parametrize(("gap", "tier"), [(2, "date"), (3, "date_tz"), (90000, "date_tz"), (90001, "unique")])
def test_tiers(spark, gap, tier):
    a = spark.createDataFrame([(1, "x", 0)], "asset int, name string, t long")
    b = spark.createDataFrame([(7, "x", gap)], "rec int, name string, u long")
    assert matching.tiered(a, b, "name", "asset", "t", "rec", "u").first().tier == tier


def test_trips_boundaries(spark):
    df = spark.createDataFrame([(i, 1, 1000 + i * 172800, 61.0, 1.0, 1.0, "p", float(i)) for i in range(40)] + [(50, 1, 5, 60.0, 1.0, 1.0, "p", 1.0)], "id int, u int, ts long, dist double, lat double, lon double, title string, score double")
    found = geo.trips(df, ["u"], "ts", "dist").collect()
    assert len(found) == 1 and found[0].frames == 40 and found[0].hero == 39
    assert geo.trips(df.where("id < 39"), ["u"], "ts", "dist").count() == 0


def test_dense_cells_half_home(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1, i < 25) for i in range(50)], "lat double, lon double, day int, home boolean")
    assert geo.dense_cells(df).count() == 1
    assert geo.dense_cells(df.union(spark.createDataFrame([(1.0, 1.0, 1, True)], df.schema))).count() == 0


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(mutation.upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(mutation.insert_ignore(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    bad = spark.createDataFrame([(1, "x", "y")], "k int, expected string, value string")
    with pytest.raises(ValueError, match="0 with the expected"):
        mutation.guarded_update(old, bad, "k", "v", "expected", "value")


def test_publish_swaps(spark, tmp_path):
    df = spark.range(3)
    assert mutation.publish(df, f"file://{tmp_path}/t") == 3
    assert mutation.publish(spark.range(5), f"file://{tmp_path}/t", keep=f"file://{tmp_path}/old") == 5
    assert spark.read.parquet(f"file://{tmp_path}/old").count() == 3
    with pytest.raises(ValueError):
        mutation.publish(spark.range(0), f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 5


def test_liveness(spark):
    df = spark.createDataFrame([("running", True, 5), ("running", True, 7200), ("running", False, 5), ("done", None, 9999), (None, None, None)], "s string, a boolean, g long")
    assert [r.v for r in df.select(monitor.verdict(F.col("s"), F.col("a"), F.col("g")).alias("v")).collect()] == ["running", "stalled", "crashed", "done", "idle"]


def test_calendar_has_a_leap_day(spark):
    df = spark.sql("select date'2020-02-29' as d, 'cut' as state union all select null, 'keep'")
    found = {(r.m, r.d): r for r in rollups.calendar(df, "d").collect()}
    assert len(found) == 366 and found[2, 29].cut == 1 and found[1, 1].label == "untouched"


def test_coverage_limit(spark):
    pop = spark.range(10)
    assert rollups.coverage(pop, {"x": spark.range(9)}, "id", 10.0).first().passed is True
    assert rollups.coverage(pop, {"x": spark.range(9)}, "id", 9.9).first().passed is False


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(i, i + 1) for i in range(100, 110)], "a long, b long")
    found = vectors.components(edges, "a", "b").collect()
    assert {r.component for r in found} == {0, 100} and len(found) == 52


def test_search_leaves_self_out(spark):
    df = spark.createDataFrame([(i, [float(i == j) for j in range(3)]) for i in range(3)] + [(3, [1.0, 0.0, 0.0])], "id long, v array<double>")
    found = vectors.search(df, "id", "v", df.where("id = 0"), 1).first()
    assert (found.id, found.score) == (3, 1.0)


def test_wilson_of_nothing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 2.0)], "w double, l double")
    assert tuple(evaluation.agreement(df, "w", "l").first()) == (0, 0, 0.0, 0.0, 0.0)


def _diverse(rows, k):
    """The pick of one group, a row at a time; rows are (order, id, hash, time, wide)."""
    chosen = []
    for wide, tiers in ((False, greedy.PORTRAIT_TIERS), (True, greedy.LANDSCAPE_TIERS)):
        for bits, seconds in tiers:
            for r in sorted(r for r in rows if r[4] == wide):
                near = any(bin(r[2] ^ c[2]).count("1") <= bits or abs(r[3] - c[3]) <= seconds for c in chosen)
                if len(chosen) < k and r not in chosen and not near:
                    chosen.append(r)
    return [r[1] for r in chosen]


@pytest.mark.parametrize("depth", [3, 256])
def test_diverse_pick(spark, depth):
    rnd = random.Random(3)
    data = [(g, i, f"{rnd.choice([0, 1, 0x1F, 0xFFFF, rnd.getrandbits(64)]):016x}", float(rnd.randint(0, 90)), rnd.random() < 0.3) for g in range(4) for i in range(g * 100, g * 100 + 25 * g + 1)]
    df = spark.createDataFrame([*data, (0, 999, "zz", 1.0, False), (0, 998, None, 1.0, False)], "g int, id int, h string, ts double, wide boolean")
    order = {r.id: r.hash_order for r in greedy.hash_order(df, "id", 1).collect()}
    got = {}
    for r in sorted(greedy.diverse_pick(df, "g", "id", "h", "ts", 12, landscape="wide", depth=depth).collect(), key=lambda r: (r.g, r.place)):
        got.setdefault(r.g, []).append(r.id)
    assert got == {g: _diverse([(order[i], i, int(h, 16), t, w) for k, i, h, t, w in data if k == g], 12) for g in range(4)}


def test_places_grow_from_the_largest_cell(spark):
    cells = spark.createDataFrame([(0, 0.0, 0.0, 5), (0, 0.01, 0.0, 3), (0, 1.0, 0.0, 4), (0, 2.0, 0.0, 2), (1, None, 0.0, 9)], "g int, lat double, lon double, n int")
    found = greedy.place_clusters(cells, "g", 2.0, 5).orderBy("place").collect()
    assert [(r.g, r.place, round(r.lat, 9), r.lon, r.n) for r in found] == [(0, 1, 0.00375, 0.0, 8), (0, 2, 1.0, 0.0, 4)]


def test_stable_names(spark):
    members = [(m, c) for m, c in enumerate([1] * 5 + [2] * 5 + [2] * 2 + [3])]
    new = spark.createDataFrame(members, "m int, c int")
    old = spark.createDataFrame([(m, 10 if m < 10 else 11, m >= 10) for m in range(12)], "m int, name int, claimed boolean")
    found = {r.c: (r.name, r.shared, r.claimed) for r in greedy.stable_names(new, old, "m", "c", "name", ["claimed"]).collect()}
    assert found == {2: (10, 5, False), 1: (12, 0, None), 3: (13, 0, None)}


def test_mutual_best_is_greedy(spark):
    rnd = random.Random(1)
    pairs = [(n, a, b) for n, (a, b) in enumerate({(rnd.randint(0, 30), rnd.randint(0, 30)) for _ in range(200)})]
    left, right, want = set(), set(), set()
    for n, a, b in sorted(pairs, reverse=True):
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((n, a, b))
    df = spark.createDataFrame(pairs, "n int, a int, b int")
    assert {tuple(r) for r in greedy.mutual_best(df, "a", "b", [F.desc("n")]).collect()} == want


def throttled(readings):
    """Actions by the rules, one reading at a time."""
    state, hot, soft, cool, out = "nominal", 0, 0, 0, []
    for t, m in readings:
        act = None
        if t is not None:
            hot = hot + 1 if t >= 83 or (m is not None and m <= 2) else 0
            soft = soft + 1 if t >= 80 else 0
            cool = cool + 1 if t < 77 else 0
            new = "halted" if state == "halted" or hot >= 3 else "soft" if soft >= 3 else "nominal" if cool >= 3 else state
            act = None if new == state else {"halted": "halt", "soft": "soft", "nominal": "recover"}[new]
            state = new
        out.append(act)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_throttle_batches(seed):
    rnd = random.Random(seed)
    readings = [(rnd.choice([None, 70, 76, 78, 81, 81, 84] if seed % 2 else [None, 76, 76, 81, 81]), rnd.choice([None, 1, 5, 5, 5])) for _ in range(60)]
    got, state, at = [], ("nominal", 0, 0, 0), 0
    while at < 60:
        part = readings[at : at + rnd.randint(1, 9)]
        acts, state = greedy.throttle_batch(state, *(np.array([np.nan if r[k] is None else r[k] for r in part], float) for k in (0, 1)))
        got, at = got + acts, at + len(part)
    assert got == throttled(readings)


def test_throttle_table(spark):
    rnd = random.Random(9)
    readings = {k: [(rnd.choice([None, 76, 76, 81, 81, 84]), rnd.choice([None, 1, 5, 5, 5, 5, 5])) for _ in range(50)] for k in range(8)}
    df = spark.createDataFrame([(k, i, t, m) for k, x in readings.items() for i, (t, m) in enumerate(x)], "k int, i int, t int, m int")
    got = {(r.k, r.i): r.action for r in greedy.throttle_actions(df, "k", "i", "t", "m").collect()}
    assert got == {(k, i): a for k, x in readings.items() for i, a in enumerate(throttled(x)) if a}


def test_one_to_one(spark):
    df = spark.createDataFrame([(0, 1, 10, 5, 1), (0, 1, 11, 9, 1), (0, 2, 10, 1, 2), (0, 2, 11, 7, 2)], "g int, a int, b int, cost int, o int")
    assert rows(greedy.one_to_one(df, "g", "a", "b", "cost", "o")) == [(1, 10, 5), (2, 11, 7)]


def test_nearest_place_across_the_meridian(spark):
    points = spark.createDataFrame([(1, 0.0, 179.9), (2, 10.0, -179.8), (3, 0.0, 0.0)], "k int, lat double, lon double")
    places = spark.createDataFrame([(1, 0.0, 179.5), (2, 0.0, -179.95), (3, 10.0, 179.9), (4, 60.0, 100.0)], "p int, lat double, lon double")
    found = {r.k: (r.p, round(r.km, 1)) for r in geo.nearest_place(points, "k", places, "p").collect()}
    assert found[1] == (2, 16.7) and found[2][0] == 3 and found[3][0] == 4


def test_residences(spark):
    homes = spark.createDataFrame([("2020-01", "2020-12", 0.0, 0.0, 40.0, ["Old"]), ("2022-01", None, 0.0, 1.0, 40.0, ["New"]), ("2019-01", "2019-02", None, None, 40.0, ["Attic"])], "start string, end string, lat double, lon double, radius_km double, areas array<string>")
    points = spark.createDataFrame([(1, "2020-05", 0.0, 0.1, "x"), (2, "2020-05", 5.0, 0.0, "Old"), (3, "2021-11", 0.0, 1.0, "x"), (4, "2021-02", 0.0, 0.0, "x"), (5, None, 0.0, 0.5, "x"), (6, "2019-01", 0.0, 0.0, "Attic"), (7, "2023-01", 0.0, 0.0, "New")], "k int, ym string, lat double, lon double, title string")
    found = {r.k: (r.home, round(r.dist)) for r in maps.residence(points, "k", homes).collect()}
    assert found == {1: (True, 11), 2: (True, 556), 3: (False, 0), 4: (False, 0), 5: (False, 56), 6: (True, 0), 7: (True, 111)}
    assert {r.dist for r in maps.residence(points, "k", homes.limit(0)).collect()} == {0.0}


def test_anchors_live_first(spark):
    rows_ = [(g, k, k % 10 < live) for g, n, live in ((1, 1000, 1), (2, 50, 2), (3, 900, 5)) for k in range(n)]
    df = spark.createDataFrame(rows_, "g int, k int, live boolean")
    got = {}
    for r in assets.anchors(df, ["g"], "k", "live", 300).collect():
        got.setdefault(r.g, set()).add(r.k)
    live = {g: sorted(k for h, k, a in rows_ if h == g and a) for g in (1, 2, 3)}
    assert len(got[1]) == 300 and set(live[1]) <= got[1] and {1, 999} <= got[1]
    assert len(got[2]) == 50 and got[3] == set(live[3][:300])


def test_a_broken_publish_is_put_right(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    mutation.publish(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.old")  # a run that ended between its two moves
    with pytest.raises(ValueError, match="0 rows"):
        mutation.publish(spark.range(0), path)
    assert spark.read.parquet(path).count() == 3
    assert mutation.publish(spark.range(5), path, keep=f"file://{tmp_path}/k") == 5
    assert spark.read.parquet(path).count() == 5 and spark.read.parquet(f"file://{tmp_path}/k").count() == 3 and not (tmp_path / "t.old").exists()


def test_claims_and_dismissals(spark):
    clusters = spark.createDataFrame([(1, "ann", False), (2, None, None), (3, None, True)], "cluster int, person string, dismissed boolean")
    claims = spark.createDataFrame([(1, "bob"), (2, "dan"), (2, "cleo")], "cluster int, person string")
    assert {r.cluster: r.person for r in mutation.claimed(clusters, claims).collect()} == {1: "ann", 2: "cleo", 3: None}
    assert {r.cluster: r.dismissed for r in mutation.dismissed(clusters, claims.where("cluster = 1")).collect()} == {1: True, 2: False, 3: True}


def test_views_in_order(spark):
    df = spark.createDataFrame([(1, 5, None), (2, None, 0.5), (3, 4, 0.9)], "id int, ts int, score double")
    ids = lambda x: [r.id for r in x.collect()]
    assert ids(assets.by_day(df, "ts", "id")) == [2, 3, 1] and ids(assets.worst_first(df, "score", "ts", "id")) == [2, 3, 1] and ids(assets.newest(df, "id", 2)) == [3, 2]


def test_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    whole = rows(vectors.search(df, "id", "v", df, 3))
    monkeypatch.setattr(vectors, "MAX_QUERIES", 9)
    assert rows(vectors.search(df, "id", "v", df, 3)) == whole and len(whole) == 180
    best = sorted((-max(float(x @ y) for y in v), i) for i, x in enumerate(v))[:2]
    assert [r.id for r in vectors.best_anchor(df, "id", "v", df.withColumn("g", F.lit("a")), "id", "g", 2).orderBy("rank").collect()] == [i for _, i in best]


def test_best_anchor_keeps_all_groups(spark):
    df = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)] + [(9, [0.6, 0.8, 0.0, 0.0])], "id long, v array<double>")
    marks = spark.createDataFrame([(i, [float(i == j) for j in range(4)], 7 + (i == 2)) for i in range(3)], "id long, v array<double>, g int")
    found = {(r.g, r.rank): (r.id, round(r.score, 6)) for r in vectors.best_anchor(df, "id", "v", marks, "id", "g", 2, marks.select("id").where("id < 2")).collect()}
    assert found == {(7, 1): (9, 0.8), (7, 2): (2, 0.0), (8, 1): (2, 1.0), (8, 2): (3, 0.0)}
