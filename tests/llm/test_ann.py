import numpy as np
import pytest
from pyspark.sql import functions as F

from calathea.llm import ann

SCHEMA = "vec_id long, embedding array<float>, leaf int, q string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def exact(rows, k=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    size = max({len(v) for _, v in good}, key=lambda n: sum(len(v) == n for _, v in good))
    good = [(i, v) for i, v in good if len(v) == size]
    return {i: sorted(((-(v * w).sum(), j) for j, w in good if j != i))[:k] for i, v in good if i % 20 == 0}


def recall(spark, rows):
    found = {}
    for r in ann.search(frame(spark, rows)).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(found[r.query_id])
    want = exact(rows)
    assert set(found) == {q for q, v in want.items() if v}
    for q, got in found.items():
        assert got == sorted(got) and len(got) == len(want[q])
        truth = {j: s for s, j in exact(rows, 10**9)[q]}
        assert all(truth[j] == pytest.approx(s, abs=1e-12) for s, j in got)
    return np.mean([len({j for _, j in found[q]} & {j for _, j in want[q]}) / len(want[q]) for q in found])


def test_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.5 * rng.normal(size=16)).tolist()) for i in range(1500)]
    assert recall(spark, rows) >= 0.9


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(1)
    assert recall(spark, [(i, rng.normal(size=4).tolist()) for i in range(30)]) == 1
    assert recall(spark, [(i, [1.0, 2.0]) for i in range(0, 100, 20)]) == 1


def test_equal_vectors_and_bad_ones(spark):
    rng = np.random.default_rng(2)
    hot = [0.6, 0.8, 0.0]
    rows = [(i, hot) for i in range(90)] + [(i, rng.normal(size=3).tolist()) for i in range(90, 160)]
    rows += [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 0.0]), (260, [1.0, float("nan"), 0.0]), (280, [float("inf"), 0.0, 0.0]), (300, [1.0, 0.0]), (None, hot)]
    assert recall(spark, rows) >= 0.95


def test_nothing(spark):
    assert ann.search(frame(spark, [])).count() == 0
    assert ann.search(frame(spark, [(1, [1.0])])).count() == 0
    assert ann.search(frame(spark, [(20, [1.0])])).count() == 0


def test_blocks_of_large_leaves(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 40)
    monkeypatch.setattr(ann, "SAMPLE", 50)
    rng = np.random.default_rng(3)
    assert recall(spark, [(i, rng.normal(size=6).tolist()) for i in range(600)]) >= 0.9


def test_many_queries_of_a_block(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES", 3)
    rng = np.random.default_rng(5)
    assert recall(spark, [(i * 5, rng.normal(size=6).tolist()) for i in range(300)]) >= 0.9


def test_own_row_among_equal_ids(spark):
    """Of two rows of one id, each query leaves out its own and finds the other."""
    rows = [(20, [1.0, 0.0]), (20, [0.9, 0.1]), (1, [0.5, 0.5])]
    found = ann.search(frame(spark, rows)).collect()
    first = [(r.vec_id, round(r.score, 6)) for r in found if r["rank"] == 1]
    assert sorted(first) == [(20, 0.9), (20, 0.9)] and len(found) == 4


def test_tree_visits_every_leaf_once():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 5))
    tree = ann.build(x, float(np.linalg.norm(x, axis=1).max()))
    assert sorted(tree.visit(x[0], 10**6)) == list(range(tree.leaves))
    assert set(tree.assign(x)) <= set(range(tree.leaves))
