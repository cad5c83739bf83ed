import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from calathea.operators import assets, evaluation, ranges, windows


@pytest.fixture(scope="module")
def table(spark):
    """One group with most rows, some of a few, nulls in group and value, many ties."""
    rnd, rows = random.Random(3), []
    for k in range(1500):
        g = rnd.choice(["hot"] * 8 + ["a", "b", None]) if k > 20 else f"g{k}"
        rows.append((k, g, rnd.choice([None, *range(12)]), k * 7 % 1511))
    frame = spark.createDataFrame(rows, "id int, g string, v int, t int").repartition(5)
    return rows, frame


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Ranges far smaller than the hot group."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def by_group(rows, key=lambda r: r[3]):
    out = defaultdict(list)
    for r in sorted(rows, key=key):
        out[r[1]].append(r)
    return out


def test_running(table):
    rows, frame = table
    found = {r.id: (r["at"], r["of"]) for r in ranges.running(frame, ["g"], ["t"], "at", "of").collect()}
    assert found == {r[0]: (n, len(own)) for own in by_group(rows).values() for n, r in enumerate(own, 1)}
    sums = {r.id: (r["at"], r["of"]) for r in ranges.running(frame.fillna(0, ["v"]), ["g"], ["t"], "at", "of", F.col("v")).collect()}
    want = {}
    for own in by_group(rows).values():
        total = sum(r[2] or 0 for r in own)
        for n in range(len(own)):
            want[own[n][0]] = (sum(r[2] or 0 for r in own[: n + 1]), total)
    assert sums == want
    down = {r.id: r["at"] for r in ranges.running(frame, [], [F.desc("t")], "at", "of").collect()}
    assert down == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: -r[3]), 1)}


@pytest.mark.parametrize("last", [1, 7, 150])
def test_with_last(table, last):
    rows, frame = table
    dealt = ranges.with_last(frame, ["g"], ["t"], last)
    assert dealt.where("__own").count() == len(rows)
    places = {r[0]: n for own in by_group(rows).values() for n, r in enumerate(own)}
    group = {r[0]: r[1] for r in rows}
    parts = defaultdict(lambda: ([], []))
    for r in dealt.collect():
        parts[r["__range"], r.g][not r["__own"]].append(places[r.id])
        assert group[r.id] == r.g
    for own, halo in parts.values():
        assert sorted(halo) == list(range(max(0, min(own) - last), min(own)))


def test_no_window_over_a_group_alone(table):
    plan = windows.even_sample(table[1], ["g"], ["t"], 9)._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "Window " in line and "windowspecdefinition" in line]
    assert keys and all("windowspecdefinition(__range" in line or "sum(__sum" in line for line in keys)


def test_rolling_median_and_rate(table):
    rows, frame = table
    found = {r.id: r.median for r in windows.rolling_median(frame, ["g"], ["t"], "v", 9, 4).collect()}
    want = {}
    for own in by_group(rows).values():
        for n, r in enumerate(own):
            v = sorted(x[2] for x in own[max(0, n - 8) : n + 1] if x[2] is not None)
            want[r[0]] = (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if len(v) >= 4 else None
    assert found == want
    timed = [(r[0], r[1], r[3] // 9, r[3]) for r in rows]
    spark = frame.sparkSession
    rates = windows.recent_rate(spark.createDataFrame(timed, "id int, g string, s int, t int").repartition(3), ["g"], "s", "t", 5, 8)
    want = {}
    for own in by_group(timed).values():
        recent = []
        for i, _, s, _ in own:
            recent.append(s)
            while s - recent[0] > 5 or len(recent) > 8:
                recent.pop(0)
            want[i] = (len(recent) - 1) / (s - recent[0]) * 60.0 if s > recent[0] else None
    assert {r.id: r.rate for r in rates.collect()} == pytest.approx(want)


def test_samples_deciles_and_splits(table):
    rows, frame = table
    groups = by_group(rows)
    step = {r.id for r in windows.even_sample(frame, ["g"], ["t"], 9, ends=False).collect()}
    assert step == {own[i * len(own) // 9][0] for own in groups.values() if len(own) > 9 for i in range(9)} | {r[0] for own in groups.values() if len(own) <= 9 for r in own}
    low = lambda v: (v is not None, v or 0)
    deciles = {r.id: r.decile for r in assets.visible_decile(frame, "g", "v").collect()}
    assert deciles == {r[0]: min(9, 10 * sum(low(x[2]) < low(r[2]) for x in groups[r[1]]) // len(groups[r[1]])) for r in rows}
    parts = {r.id: r.part for r in evaluation.stratified_split(frame, "g", ["t"]).collect()}
    want = {}
    for own in groups.values():
        a, b = round(len(own) * 0.8), round(len(own) * 0.1)
        want |= {r[0]: "train" if n < a else "val" if n < a + b else "test" for n, r in enumerate(own)}
    assert parts == want


def test_ranks_and_moments(table):
    rows, frame = table
    values = [r[2] for r in rows if r[2] is not None]
    found = {r.v: (r["__below"], r["__count"]) for r in windows.value_ranks(frame, "v").collect()}
    assert found == {v: (sum(x < v for x in values), values.count(v)) for v in set(values)}
    assert evaluation.moments(frame, "v", [5]).first().median == sorted(values)[len(values) // 2 - (len(values) % 2 == 0) : len(values) // 2 + 1][-1]
    assert evaluation.moments(frame.where("id < 0"), "v", [5]).first().asDict() == {"low": None, "high": None, "mean": None, "deviation": None, "median": None, "at_least_0": 0}
    with_nulls = frame.withColumn("t", F.when(F.col("id") > 3, F.col("t")))
    assert sorted(r.rn for r in windows.numbered(with_nulls, "t", "id").collect()) == list(range(1, len(rows) + 1))


def test_nothing(table):
    none = table[1].where("id < 0")
    assert ranges.running(none, ["g"], ["t"], "at", "of").count() == 0
    assert windows.rolling_median(none, ["g"], ["t"], "v", 9, 4).count() == 0
