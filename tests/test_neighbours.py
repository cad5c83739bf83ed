import numpy as np
import pytest

from calathea.operators import neighbours as N
from calathea.operators import vectors

SCHEMA = "id long, v array<float>"


def exact(rows, k, least):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for n, i in enumerate(ids):
        s = sorted((-float((x[n] * x[m]).sum()), ids[m]) for m in range(len(ids)) if ids[m] != i)
        out[i] = [(j, -a) for a, j in s if -a >= least][:k]
    return out


def found(spark, rows, k, least, **how):
    out = {}
    for r in N.edges(spark.createDataFrame(rows, SCHEMA), "id", "v", k, least, **how).orderBy("query", "rank").collect():
        out.setdefault(r.query, []).append((r.id, r.score))
        assert r["rank"] == len(out[r.query]) and r.score >= least
    return out


def recall(got, want):
    asked = sum(map(len, want.values()))
    return sum(len({j for j, _ in v} & {j for j, _ in got.get(i, [])}) for i, v in want.items()) / asked


def unit(x):
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).tolist()


def test_clusters(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    rows = list(enumerate(unit(centres[np.arange(1500) % 30] + 0.3 * rng.normal(size=(1500, 16)))))
    want = exact(rows, 6, 0.65)
    got = found(spark, rows, 6, 0.65, bucket=64)
    assert recall(got, want) >= 0.95
    scores = {(i, j): s for i, v in exact(rows, 10**6, -2).items() for j, s in v}
    assert all(scores[i, j] == pytest.approx(s, abs=1e-12) for i, v in got.items() for j, s in v)


def test_no_structure(spark):
    rng = np.random.default_rng(1)
    rows = list(enumerate(unit(rng.normal(size=(800, 24)))))
    assert recall(found(spark, rows, 5, 0.3, bucket=64), exact(rows, 5, 0.3)) >= 0.95


def test_one_bucket_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = list(enumerate(unit(rng.normal(size=(120, 6)))))
    want = exact(rows, 4, 0.5)
    got = found(spark, rows, 4, 0.5)
    assert {i: [j for j, _ in v] for i, v in want.items() if v} == {i: [j for j, _ in v] for i, v in got.items()}


def test_equal_vectors_in_parts(spark, monkeypatch):
    """A third of all rows alike, crowded buckets worked off in parts."""
    monkeypatch.setattr(N, "LEAST", 400)
    rng = np.random.default_rng(3)
    hot = [0.6, 0.8, 0.0, 0.0]
    rows = [(i, hot) for i in range(200)] + [(200 + i, v) for i, v in enumerate(unit(rng.normal(size=(400, 4))))]
    want = exact(rows, 7, 0.2)
    got = found(spark, rows, 7, 0.2, bucket=16)
    assert [j for j, _ in got[150]] == [0, 1, 2, 3, 4, 5, 6] and [j for j, _ in got[3]] == [0, 1, 2, 4, 5, 6, 7]
    assert recall(got, want) == 1


def test_awkward_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (None, [1.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [0.0, 1.0]), (8, [-0.0, 1.0])]
    assert found(spark, rows, 3, 0.5) == {1: [(2, 1.0)], 2: [(1, 1.0)], 7: [(8, 1.0)], 8: [(7, 1.0)]}
    assert found(spark, [], 3, 0.5) == {} and found(spark, [(1, [])], 3, 0.5) == {}


def test_search_and_assignment(spark):
    """Queries of their own, and the nearest of many centres."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 12))
    rows = list(enumerate(unit(centres[np.arange(900) % 60] + 0.25 * rng.normal(size=(900, 12)))))
    asked = [(5_000 + k, v) for k, v in enumerate(unit(centres + 0.1 * rng.normal(size=(60, 12))))] + [(9_000, None), (9_001, [1.0])]
    frames = [spark.createDataFrame(x, SCHEMA).repartition(3) for x in (rows, asked)]
    x = np.array([v for _, v in rows], np.float32).astype(float)
    found = {}
    for r in N.search(frames[0], "id", "v", frames[1], 5, bucket=64).collect():
        found.setdefault(r.query, {})[r["rank"]] = (r.id, r.score)
    want = {i: sorted((-float((np.array(v, np.float32).astype(float) * y).sum()), j) for j, y in enumerate(x))[:5] for i, v in asked[:60]}
    assert found.keys() == want.keys() and all(sorted(f) == [1, 2, 3, 4, 5] for f in found.values())
    assert np.mean([len({j for j, _ in found[i].values()} & {j for _, j in want[i]}) / 5 for i in want]) >= 0.95
    table = spark.createDataFrame([(k, v) for k, v in enumerate(unit(centres))], SCHEMA)
    own = {r.query: r.id for r in N.search(table, "id", "v", frames[0], 1, bucket=16).collect()}
    unit_centres = np.array(unit(centres), np.float32).astype(float)
    nearest = (x @ unit_centres.T).argmax(axis=1)
    assert len(own) == len(rows) and np.mean([own[i] == nearest[i] for i in own]) >= 0.95
    assert N.search(spark.createDataFrame([], SCHEMA), "id", "v", frames[1], 5).count() == 0


def test_clusters_need_few_probes():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    x = np.array(unit(centres[np.arange(4000) % 40] + 0.15 * rng.normal(size=(4000, 16))))
    tables = [N.planes(x, len(x), 64, seed) for seed in range(4)]
    s = x[:100] @ x.T
    s[np.arange(100), np.arange(100)] = -1
    near = [x[np.argsort(-s[i])[:5]] for i in range(100)]
    count, probes, share = N.calibrated(tables, x[:100], near, 0.97)
    assert share >= 0.97 and count * probes < 0.25 * tables[0].buckets


def test_tables_cover_all_buckets():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 5))
    table = N.planes(x, 50_000, 2_000, 0)
    assert table.buckets >= 25
    assert sorted(table.probes(table.margins(x[:1])[0], 10**6)) == list(range(table.buckets))
    own = table.own(x)
    assert all(table.probes(m, 1) == [b] for m, b in zip(table.margins(x), own.tolist(), strict=True))


def test_against_the_exact_edges_of_the_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    edges = lambda df: {(r.query, r.id) for r in df.select("query", "id").collect()}
    want = edges(vectors.neighbour_edges(table, "vec_id", "embedding", 5, 0.3))
    got = edges(N.edges(table, "vec_id", "embedding", 5, 0.3, bucket=256))
    assert len(want & got) >= 0.95 * len(want)
