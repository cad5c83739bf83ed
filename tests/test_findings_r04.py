"""What the fourth round's findings were about."""

import numpy as np
import pytest

from calathea.operators import neighbours

from .test_findings_r03 import same_as_sql


def test_heroes_without_an_id(spark, tmp_path):
    """A user's best clicks have no id, or the least there is: the best that has one is the hero."""
    events = "SELECT CASE WHEN i > 80 THEN i ELSE {} END AS event_id, i % 3 AS user_id, CASE WHEN i % 2 = 0 THEN 'click' ELSE 'signup' END AS event_type, -(i // 6)::DOUBLE AS value FROM range(300) AS r(i)"
    assert sorted(r["hero"] for r in same_as_sql(spark, tmp_path, "heroes", events=events.format("NULL"))) == [82, 84, 86]
    least = -(2**63)
    assert {r["hero"] for r in same_as_sql(spark, tmp_path, "heroes", events=events.format(f"({least + 1} - 1)::BIGINT"))} == {least}


def test_people_list_of_equal_scores(spark, tmp_path):
    """A thousand apart, faces score the same: the smallest id, as DuckDB has it where one thread reads them in order."""
    faces = "SELECT CASE WHEN i % 7 > 0 THEN i END AS vec_id, (i % 9)::INT AS label FROM range(30000) AS r(i)"
    assert len(same_as_sql(spark, tmp_path, "people_list", embeddings=faces)) == 9


def best_of_all(ids, x, k, least):
    exact = np.array([(x * y).sum(axis=1) for y in x])
    return {int(q): sorted((-float(s), int(j)) for j, s in zip(ids, row, strict=True) if j != q and s >= least)[:k] for q, row in zip(ids, exact, strict=True)}


@pytest.mark.parametrize("held", [131_072, 70])
def test_rows_without_structure_are_sent_to_few_buckets(spark, monkeypatch, held):
    """Vectors that would ask nearly all of some sixty buckets: larger buckets are asked, in slices and in parts."""
    sent = []
    monkeypatch.setattr(neighbours, "_dealt", lambda tables, probes, parts, lies, asks, *slices, deal=neighbours._dealt: sent.append((len(tables) * probes, parts, slices)) or deal(tables, probes, parts, lies, asks, *slices))
    for name, value in (("HELD", held), ("PIECE", 256)):
        monkeypatch.setattr(neighbours, name, value, raising=False)
    x = np.random.default_rng(23).normal(size=(1_500, 24)).astype(np.float32)
    x = np.r_[x, x[:100] + np.float32(0.01)]
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "id long, v array<float>")
    got, want = {}, best_of_all(np.arange(1_600), x.astype(float), 5, 0.3)
    for r in neighbours.edges(frame, "id", "v", 5, 0.3, bucket=32).collect():
        got.setdefault(r.query, []).append((-r.score, r.id))
    assert max(copies for copies, *_ in sent) <= 8 and sent[-1][2][0] > 1 and bool(sent[-1][1]) == (held == 70)
    assert all(len(h) == 5 for h in got.values())
    assert sum(len(set(got.get(q, [])) & set(h)) for q, h in want.items()) >= 0.95 * sum(map(len, want.values()))


def test_best_of_many_pieces(monkeypatch):
    """Equal to all pairs piece by piece: with ties, near ties, large and tiny vectors, in single precision and in double."""
    monkeypatch.setattr(neighbours, "PIECE", 50, raising=False)
    rng = np.random.default_rng(29)
    x = rng.normal(size=(1_000, 8))
    x[300:600] = x[:300] + rng.normal(size=(300, 8)) * 1e-9
    x[600:640], x[640:680] = x[:40], x[640:680] * 1e-6
    ids = np.arange(1_000) * 3
    for scale, kind in ((1.0, np.float64), (1.0, np.float32), (1e20, np.float64)):
        y = (x * scale).astype(kind)
        z = y.astype(float)
        for least in (0.3 * scale * scale, -np.inf):
            got = {}
            for q, i, score in zip(*neighbours._scored(ids[:700], z[:700], ids, y, neighbours._far(y), 6, least), strict=True):
                got.setdefault(int(q), []).append((-float(score), int(i)))
            for n in range(700):
                exact = (z * z[n]).sum(axis=1)
                bar = max(least, np.sort(exact)[-6])
                assert sorted(got.get(n * 3, [])) == sorted((-float(s), int(i)) for i, s in zip(ids, exact, strict=True) if s >= bar)
