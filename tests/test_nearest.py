import math
import random

from calathea.operators import nearest
from calathea.operators.nearest import nearest_place


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def model(points, places):
    good = [(p, a, b) for p, a, b in places if a is not None and b is not None]
    return {i: min((round(km(x, y, a, b), 6), p) for p, a, b in good) for i, x, y in points if x is not None and y is not None} if good else {}


def found(spark, points, places):
    rows = nearest_place(spark.createDataFrame(points, "k long, lat double, lon double").repartition(3), "k", spark.createDataFrame(places, "p long, lat double, lon double").repartition(3), "p").collect()
    assert len(rows) == len({r.k for r in rows})
    return {r.k: (r.km, r.p) for r in rows}


def same(got, want):
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-5 for k in want)
    assert sum(got[k][1] != want[k][1] for k in want) == 0


def test_all_over_the_globe(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF", 8)
    monkeypatch.setattr(nearest, "ASKING", 40)
    rnd = random.Random(1)
    some = lambda n: [(math.degrees(math.asin(rnd.uniform(-1, 1))), rnd.uniform(-180, 180)) for _ in range(n)]
    spots = some(250) + [(90.0, 0.0), (-90.0, 50.0), (0.0, 180.0), (10.0, -179.99)] + [(48 + rnd.random() * 0.01, 16 + rnd.random() * 0.01) for _ in range(150)]
    asks = some(300) + [(89.99, 120.0), (-89.9, -60.0), (0.1, -179.9), (10.0, 179.99), (-48.0, -164.0)] + [(48 + rnd.random() * 0.01, 16 + rnd.random() * 0.01) for _ in range(200)] + [spots[5]] * 3
    points, places = [(k, *x) for k, x in enumerate(asks)], [(1000 - k, *x) for k, x in enumerate(spots)] + [(5, *spots[5]), (6, *spots[5])]
    want = model(points, places)
    same(found(spark, points, places), want)
    assert want[len(points) - 1] == (0.0, 5)


def test_points_far_from_all_places(spark):
    """However far off: a dense spot of places on the other side of the globe."""
    rnd = random.Random(2)
    places = [(k, -33 + rnd.random() * 1e-4, 151 + rnd.random() * 1e-4) for k in range(3000)]
    points = [(k, 40 + rnd.random(), -3 + rnd.random()) for k in range(50)] + [(99, None, 1.0), (98, 1.0, None)]
    same(found(spark, points, places + [(-1, None, 0.0)]), model(points, places))


def test_dense_cells_make_few_pairs(monkeypatch):
    """Ten thousand places in a square kilometre: a leaf has some hundreds of them, a point asks a few leaves."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.stack([rng.random(10_000) * 1e-4, rng.random(10_000) * 1e-4, np.ones(10_000)], axis=1)
    tree = nearest.tree_of(x, len(x), nearest.LEAF)
    home, leaves = tree.home(x), len(tree.axis) + 1
    assert np.bincount(home, minlength=leaves).max() <= nearest.LEAF
    tree.bound(np.array([x[home == k].min(axis=0) for k in range(leaves)]), np.array([x[home == k].max(axis=0) for k in range(leaves)]))
    row, leaf = tree.within(x, np.full(len(x), 3e-6))
    assert len(row) < 2.5 * len(x)


def test_nothing(spark):
    assert found(spark, [(1, 0.0, 0.0)], []) == {} and found(spark, [], [(1, 0.0, 0.0)]) == {} and found(spark, [(1, None, 0.0)], [(1, 0.0, 0.0)]) == {}
