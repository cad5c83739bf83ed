import random

import pytest
from pyspark.sql import functions as F

from calathea.operators import rollups, vectors


def rows(seed, n, size=4):
    rnd = random.Random(seed)
    return [(k, [rnd.gauss(0, 1) for _ in range(size)]) for k in range(n)]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("limit", [1_000, 7])
def test_assign_to_any_number_of_centres(spark, limit):
    own, centres = rows(1, 60), [(f"c{k:02d}", v) for k, v in rows(2, 30)]
    centres += [("z", centres[3][1])]  # as near as c03, which is the smaller
    frame = spark.createDataFrame([*own, (99, None)], "id int, v array<double>")
    found = vectors.assign(frame, "id", "v", spark.createDataFrame(centres, "g string, centroid array<double>"), "g", limit).collect()
    want = {i: min((-dot(v, c), g) for g, c in centres) for i, v in own}
    assert {r.id: r.g for r in found if r.id != 99} == {i: g for i, (_, g) in want.items()}
    assert all(abs(r.score + want[r.id][0]) < 1e-9 for r in found if r.id != 99) and [r.g for r in found if r.id == 99] == [None]


@pytest.mark.parametrize("most", [4_096, 5])
def test_best_anchors_in_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(vectors, "MAX_QUERIES", most)
    own, anchors = rows(3, 80), [(k, v, "ab"[k % 2]) for k, v in rows(4, 23)]
    frame, few = spark.createDataFrame(own, "id long, v array<double>"), spark.createDataFrame(anchors, "k long, v array<double>, g string")
    found = vectors.best_anchor(frame, "id", "v", few, "k", "g", 6, frame.where("id < 5").select("id")).collect()
    want = {}
    for g in "ab":
        best = sorted((-max(dot(v, a) for _, a, h in anchors if h == g), i) for i, v in own if i >= 5)[:6]
        want |= {(g, n + 1): i for n, (_, i) in enumerate(best)}
    assert {(r.g, r["rank"]): r.id for r in found} == want
    assert vectors.best_anchor(frame, "id", "v", few.limit(0), "k", "g", 6).count() == 0


def test_coverage_of_a_real_gap_and_of_nothing(spark):
    ids = spark.range(10).toDF("id")
    faces, nsfw = ids.where("id > 2"), ids.where(F.lit(True))
    of = lambda *a, **b: {r.signal: (r.gap, r.passed) for r in rollups.coverage(*a, **b).collect()}
    assert of(ids, {"faces": faces, "nsfw": nsfw}) == {"faces": (3, False), "nsfw": (0, True)}
    assert of(ids, {"faces": ids.where("id > 0")}, limit=50) == {"faces": (1, True)} and of(ids, {"faces": ids.where("id > 0")}, limit=5) == {"faces": (1, False)}
    assert of(ids.where("id < 0"), {"faces": faces}) == {"faces": (0, False)}
