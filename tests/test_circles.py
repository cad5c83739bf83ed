import math
import random

import pytest

from calathea.operators import circles

POINTS, CIRCLES = "id long, lat double, lon double", "cid long, lat double, lon double, radius_km double"


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def model(points, table):
    good = [c for c in table if None not in c and c[3] >= 0]
    return {(i, c) for i, a, b in points if a is not None and b is not None for c, x, y, r in good if km(a, b, x, y) <= r}


@pytest.fixture(scope="module")
def world():
    """Points all over, at the poles, on both sides of the 180th meridian and on edges of cells; circles of all sizes."""
    rnd = random.Random(1)
    points = [(k, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for k in range(150)]
    points += [(200 + 2 * k + (s > 0), s * (90 - rnd.random() * 0.3), rnd.uniform(-180, 180)) for k in range(30) for s in (1, -1)]
    points += [(300 + 2 * k + (s > 0), rnd.uniform(-60, 60), s * (180 - rnd.random() * 0.2)) for k in range(30) for s in (1, -1)]
    points += [(400 + k, a, b) for k, (a, b) in enumerate([(90.0, 0.0), (-90.0, 77.0), (0.0, 180.0), (0.0, -180.0), (0.0, 0.0), (45.0, 90.0), (22.5, -45.0), (None, 1.0), (1.0, None), (10.0, 200.0)])]
    points += [(500 + k, 48.2, 16.37) for k in range(50)]
    table = [(k, a, b, rnd.choice([0.0, 0.1, 5.0, 40.0, 300.0, 2000.0])) for k, (_, a, b) in enumerate(points[:90])]
    table += [(1000 + 2 * k + (s > 0), s * (90 - rnd.random() * 0.2), rnd.uniform(-180, 180), rnd.choice([1.0, 30.0, 500.0])) for k in range(20) for s in (1, -1)]
    table += [(1100 + 2 * k + (s > 0), rnd.uniform(-60, 60), s * (180 - rnd.random() * 0.1), rnd.choice([1.0, 30.0, 500.0])) for k in range(20) for s in (1, -1)]
    table += [(1200, 48.2, 16.37, 0.0), (1201, 0.0, 0.0, 1e9), (1202, None, 0.0, 5.0), (1203, 0.0, None, 5.0), (1204, 0.0, 0.0, None), (1205, 0.0, 0.0, -1.0), (1206, 5.0, 5.0, 12000.0), (1207, 48.2, 16.37, 3.0)]
    return points, table


def test_pairs(spark, world):
    points, table = world
    found = circles.pairs(spark.createDataFrame(points, POINTS), "id", spark.createDataFrame(table, CIRCLES), "cid").collect()
    assert len(found) == len({(r.id, r.cid) for r in found})
    assert {(r.id, r.cid) for r in found} == model([p for p in points if p[2] is None or p[2] <= 180], table) | model([p for p in points if p[2] == 200.0], table)


@pytest.mark.parametrize("part", [slice(0, None), slice(0, 60), slice(60, 150), slice(90, 170)])
def test_in_any(spark, world, part):
    points, table = world
    table = [c for c in table[part] if c[0] != 1201]
    found = circles.in_any(spark.createDataFrame(points, POINTS), spark.createDataFrame(table, CIRCLES))
    assert found.columns == ["id", "lat", "lon", "near"]
    held = {i for i, _ in model(points, table)}
    assert {(r.id, r.near) for r in found.collect()} == {(i, i in held) for i, _, _ in points}


def test_nothing(spark, world):
    points = spark.createDataFrame(world[0], POINTS)
    assert circles.in_any(points, spark.createDataFrame([], CIRCLES)).where("near").count() == 0
    assert circles.in_any(points.limit(0), spark.createDataFrame(world[1], CIRCLES)).count() == 0


def test_few_cells_and_no_nested_loop(spark, world):
    table = spark.createDataFrame(world[1], CIRCLES)
    assert circles.cells_of_circles(table, "lat", "lon", "radius_km").groupBy("cid").count().where("count > 24").isEmpty()
    plan = circles.in_any(spark.createDataFrame(world[0], POINTS), table)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_homes_of_months(spark):
    homes = spark.createDataFrame(
        [("2020-01", "2020-12", 48.2, 16.37, 40.0, ["Vienna", None]), ("2021-01", None, 40.4, -3.7, 10.0, []), ("2021-01", None, None, None, None, ["Graz"])],
        "start string, end string, lat double, lon double, radius_km double, areas array<string>",
    )
    rows = [
        (1, 48.3, 16.4, "2020-05", None, True), (2, 48.3, 16.4, "2021-01", None, False), (3, None, None, "2020-12", "Vienna", True), (4, 0.0, 0.0, "2021-01", "Vienna", False),
        (5, 40.4, -3.7, "2030-01", "x", True), (6, 40.6, -3.7, "2030-01", "x", False), (7, None, None, "2022-02", "Graz", True), (8, 48.2, 16.37, None, "Vienna", False),
    ]
    points = spark.createDataFrame(rows, "id long, lat double, lon double, ym string, title string, want boolean")
    assert [(r.id, r.home) for r in circles.at_home(points, homes).collect() if r.home != r.want] == []
    assert circles.at_home(points, homes).count() == len(rows)
