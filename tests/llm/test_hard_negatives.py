import math

import numpy as np
import pytest

from calathea.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def model(rows, k=5, positives=5):
    """By whole numbers, all against all."""
    good = [(n, i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, v, label) in enumerate(rows) if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, label, q in good:
        if i % 100:
            continue
        near = sorted((max(H.LOW, min(H.HIGH, sum(a * b for a, b in zip(q, w)))) * -1, j, other != label) for m, j, other, w in good if m != n and len(w) == len(q))
        for p, pid, _ in [x for x in near if not x[2]][:positives]:
            fit = [(s, j) for s, j, other in near if other and -80 * p <= -100 * s <= -100 * p][:k]
            out += [(i, pid, r + 1, j, -p, -s) for r, (s, j) in enumerate(fit)]
    return sorted(out)


def found(spark, rows, parts=3):
    return sorted(map(tuple, H.mine(spark.createDataFrame(rows, SCHEMA).repartition(parts)).select(COLUMNS).collect()))


def some(seed, n, size=8, spread=0.4, labels=4, ids=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size))
    return [(i * ids, (centres[i % 6] + spread * rng.normal(size=size)).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    """Many shards, leaves of few rows, few anchors at a time."""
    for name, value in (("_rows", lambda n, size: 16), ("LEAF", 4), ("BLOCK", 7), ("QUERIES", 9), ("SEED", 20)):
        monkeypatch.setattr(H, name, value)
    monkeypatch.setattr(H.Balanced.__init__, "__defaults__", (4,))


@pytest.mark.parametrize("seed", [0, 1])
def test_clusters(spark, small, seed):
    rows = some(seed, 400)
    assert found(spark, rows) == model(rows)


def test_no_structure(spark, small):
    rng = np.random.default_rng(3)
    rows = [(i * 25, rng.normal(size=24).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(300)]
    assert found(spark, rows) == model(rows)


def test_ties_and_equal_vectors(spark, small):
    rng = np.random.default_rng(4)
    rows = [(i * 10, [float(x) for x in rng.integers(-1, 2, size=4)], int(rng.integers(3))) for i in range(250)]
    rows += [(5000 + i, [1.0, 1.0, 0.0, 1.0], i % 3) for i in range(150)] + [(5100, [1.0, 1.0, 0.0, 1.0], 0)] * 3
    assert found(spark, rows) == model(rows)


def test_awkward_rows(spark, small):
    rows = some(5, 60, size=3)
    rows += [(None, [1.0, 1.0, 1.0], 1), (100, None, 1), (200, [1.0, None, 1.0], 1), (300, [1.0, float("nan"), 1.0], 1), (400, [float("inf"), 1.0, 1.0], 1), (500, [1.0, 1.0, 1.0], None)]
    rows += [(600, [1.0, 1.0], 1), (601, [1.0, 1.0], 1), (602, [0.9, 1.0], 2), (700, [], 1), (701, [], 1), (702, [], 2), (703, [], 2), (800, [0.0] * 3, 0), (-100, [0.1] * 3, 2)]
    assert found(spark, rows) == model(rows)
    assert any(r[0] == 700 for r in model(rows)) and any(r[0] == 600 for r in model(rows))


def test_scores_beyond_doubles_and_64_bits(spark, small):
    rng = np.random.default_rng(6)
    rows = [(i * 20, (rng.normal(size=3) * 10.0 ** int(rng.integers(5, 9))).astype(np.float32).tolist(), int(rng.integers(2))) for i in range(40)]
    assert any(abs(r[4]) > 2**53 for r in model(rows))
    assert found(spark, rows) == model(rows)


def test_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(100, [1.0], 1)]) == []
    assert found(spark, [(100, [1.0], 1), (1, [1.0], 1)]) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_more_columns_and_production_parameters(spark):
    rows = some(7, 300)
    frame = spark.createDataFrame([(*r, 1, "s", None) for r in rows], SCHEMA + ", `row` int, vec string, size long")
    assert sorted(map(tuple, H.mine(frame).select(COLUMNS).collect())) == model(rows)


def test_bounds_hold_every_row():
    rng = np.random.default_rng(8)
    x = np.floor(256 * rng.normal(size=(500, 6)))
    q = np.floor(256 * rng.normal(size=(20, 6)))
    space = H.Space(float((x * x).sum(axis=1).max()), False)
    s = q @ x.T
    tree = H.Balanced(x, space, 16)
    least, most = tree.bounds(q)
    for leaf, (a, b) in enumerate(tree.spans):
        own = s[:, tree.order[a:b]]
        assert (own.max(axis=1) <= most[:, leaf]).all() and (own.min(axis=1) >= least[:, leaf]).all()
    top = H.shells(x[:400], space, 20)
    leaf, (least, most) = top.assign(x), top.bounds(q)
    assert top.leaves == 20 and set(leaf) <= set(range(20))
    assert (s <= most[:, leaf]).all() and (s >= least[:, leaf]).all()


def test_far_leaves_are_not_visited(monkeypatch):
    """On clustered rows, most leaves are never scored."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 6)) * 5
    x = np.floor(256 * (centres[np.arange(8000) % 40] + 0.05 * rng.normal(size=(8000, 6))))
    space = H.Space(float((x * x).sum(axis=1).max()), False)
    seen = []
    among = H._among
    monkeypatch.setattr(H, "_among", lambda rows, who, *a: seen.append(len(rows) * len(who)) or among(rows, who, *a))
    full = np.full((20, 1), H.LOW), np.full((20, 1), H.HIGH)
    asked = H.Asked(np.arange(20), np.arange(20) % 2, x[:20], full[0].copy(), full[1])
    H.traverse(H.Balanced(x, space, 64), asked, np.arange(8000) % 2, np.arange(8000), np.arange(8000), 5, True)
    assert sum(seen) < 0.5 * 20 * 8000
