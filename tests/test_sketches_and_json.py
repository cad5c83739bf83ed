import datetime
import random

from pyspark.sql import functions as F

from calathea.functions import unknown
from calathea.operators import sketches


def days(spark, n):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), datetime.date(2024, 1 + rnd.randrange(3), 1 + rnd.randrange(28)), rnd.randrange(n // 3), rnd.gauss(0, 1) if k % 50 else None) for k in range(n)]
    return rows, spark.createDataFrame(rows, "g string, d date, i int, v double").repartition(4)


def rank_error(values, got, q):
    below, upto = sum(v < got for v in values), sum(v <= got for v in values)
    return max(0, below / len(values) - q, q - upto / len(values))


def test_merged_days_are_the_months(spark):
    rows, frame = days(spark, 30_000)
    table = sketches.by_day(frame, ["g"], F.col("d"), "i", "v", k=400)
    months = sketches.read(sketches.merged(table, ["g"], F.trunc("day", "month")), (0.1, 0.5, 0.9)).collect()
    assert len(months) == 6
    for r in months:
        own = [x for x in rows if x[0] == r.g and x[1].replace(day=1) == r.period]
        items, values = {x[2] for x in own}, [x[3] for x in own if x[3] is not None]
        assert r.n == len(own) and abs(r.distinct - len(items)) <= 4 * len(items) / 4095**0.5 and abs(r.distinct_hll - len(items)) <= 0.05 * len(items)
        assert all(rank_error(values, r[f"q{round(q * 100)}"], q) < 0.02 for q in (0.1, 0.5, 0.9))
    year = sketches.read(sketches.merged(sketches.merged(table, ["g"], F.trunc("day", "month")), [])).first()
    direct = sketches.read(sketches.merged(table, [])).first()
    items = len({x[2] for x in rows})
    assert (year.n, year.distinct) == (direct.n, direct.distinct) and abs(year.distinct - items) < 600
    assert abs(year.distinct_hll - items) < 500 and abs(direct.distinct_hll - items) < 500


def test_small_ones_are_exact(spark):
    rows, frame = days(spark, 900)
    got = sketches.read(sketches.merged(sketches.by_day(frame, [], F.col("d"), "i", "v"), [])).first()
    values = sorted(x[3] for x in rows if x[3] is not None)
    assert got.distinct == len({x[2] for x in rows}) and got.q50 == values[-(-len(values) // 2) - 1]
    table = sketches.by_day(frame, ["g"], F.col("d"), "i", "v")
    part = lambda c: sketches.merged(table.where(c), ["g"])
    both = {r.g: r.shared for r in sketches.shared(part("month(day) = 1"), part("month(day) = 2"), ["g"]).collect()}
    of = lambda g, m: {x[2] for x in rows if x[0] == g and x[1].month == m}
    assert both == {g: len(of(g, 1) & of(g, 2)) for g in "ab"}


def test_values_that_are_all_null(spark):
    frame = spark.createDataFrame([("a", None, None, None)] * 3, "g string, d date, i int, v double")
    got = sketches.read(sketches.by_day(frame, ["g"], F.col("d"), "i", "v")).first()
    assert (got.n, got.day, got.distinct, got.q50) == (3, None, 0, None)


TEXTS = [
    '{"caption": "a cat", "n": 3, "list": ["a, b", " c ", null, 4, ""], "flags": {"x": true, "y": "no"}, "box": [1, 2, 4, 6]}',
    '{"caption": {"deep": 1}, "n": "7", "list": "a,b", "flags": [], "box": [1, 2, 4]}', "not json", None, "[1, 2, 3, 5]", "{}", '{"n": "x", "box": ["a", 1, 2, 3]}',
]


def test_defensive_reads(spark):
    v = unknown.parsed(F.col("t"))
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    rows = frame.select("k", unknown.read(v, "$.n", "int").alias("n"), unknown.text(v, "$.caption", 4).alias("c"), unknown.elements(v, "$.list").alias("l"), unknown.flags(v, "$.flags").alias("f"), unknown.box_area(v, "$.box").alias("b"), unknown.box_area(v).alias("whole")).orderBy("k").collect()
    assert [r.n for r in rows] == [3, 7, None, None, None, None, None]
    assert [r.c for r in rows] == ["a ca", '{"de', "", "", "", "", ""]
    assert [r.l for r in rows] == [["a", "b", "c", "4"], [], [], [], [], [], []]
    assert [r.f for r in rows] == [{"x": "true", "y": "no"}, {}, {}, {}, {}, {}, {}]
    assert [r.b for r in rows] == [12.0, 0, 0, 0, 0, 0, 0] and [r.whole for r in rows] == [0, 0, 0, 0, 6.0, 0, 0]
    assert unknown.shape(frame.where("k in (0, 1)"), "t").startswith("OBJECT<") and "n: VARIANT" in unknown.shape(frame.where("k in (0, 1)"), "t")


def test_islands(spark):
    page = '<p>x</p><script type="application/json" id="a">{"n": 5, "s": "<b>"}</script><p>{"n": 6}</p>'
    frame = spark.createDataFrame([(page,), ("<p>none</p>",), (None,), ('<script type="application/json">{bad</script>',)], "h string")
    assert [r[0] for r in frame.select(unknown.read(unknown.island(F.col("h")), "$.n", "int")).collect()] == [5, None, None, None]
