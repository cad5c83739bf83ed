import numpy as np
import pytest
from pyspark.sql import functions as F

from calathea.operators import training

SCHEMA = "id long, v array<float>, y double, w double, part string"


def ranks(x):
    order = np.argsort(x, kind="stable")
    out = np.empty(len(x))
    out[order] = np.arange(len(x))
    for v in np.unique(x):
        out[x == v] = out[x == v].mean()
    return out


def model(x, y, w, vx, vy, delta, ridge, rounds, patience):
    """The same fit in one place."""
    x, vx = (np.concatenate([a, np.ones((len(a), 1))], axis=1) for a in (x, vx))
    keep = np.eye(x.shape[1]) * ridge * w.sum()
    keep[-1, -1] = 0

    def solve(b):
        r = np.abs(y - x @ b) if b is not None else np.zeros(len(y))
        own = w * np.where(r <= delta, 1, delta / np.maximum(r, delta))
        return np.linalg.solve((x * own[:, None]).T @ x + keep, (x * own[:, None]).T @ y)

    b, best, idle, seen = solve(None), None, 0, []
    for n in range(rounds):
        rho = round(np.corrcoef(ranks(vx @ b), ranks(vy))[0, 1], 6)
        if best is None or rho > best[0]:
            best, idle = (rho, b, n + 1), 0
        else:
            idle += 1
        seen.append(rho)
        after = solve(b)
        if idle >= patience or np.abs(after - b).max() < 1e-12:
            break
        b = after
    return best[1], best[2], seen


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 6)).astype(np.float32)
    y = x @ rng.normal(size=6) + 0.5 + 0.05 * rng.normal(size=600)
    y[::17] += 20 * rng.random(len(y[::17]))  # outliers
    return x, y, rng.uniform(0.3, 3, size=600), ["train"] * 450 + ["val"] * 100 + ["test"] * 50


def frame(spark, data):
    x, y, w, part = data
    return spark.createDataFrame([(k, x[k].tolist(), float(y[k]), float(w[k]), part[k]) for k in range(len(y))], SCHEMA).repartition(5)


def test_against_numpy(spark, data):
    x, y, w, _ = data
    got = training.fit(frame(spark, data), "v", "y", "w", "part", delta=0.2, rounds=8, patience=3)
    b, best, seen = model(x[:450].astype(float), y[:450], w[:450], x[450:550].astype(float), y[450:550], 0.2, 1e-6, 8, 3)
    assert got.best == best and [h[1] for h in got.history] == pytest.approx(seen, abs=1e-6)
    assert np.abs(got.coefficients - b).max() < 1e-6
    losses = [h[0] for h in got.history]
    assert losses == sorted(losses, reverse=True)


def test_without_validation_and_without_rows(spark, data):
    rows = frame(spark, data)
    got = training.fit(rows.where("part = 'train'"), "v", "y", "w", "part", delta=0.2, rounds=6)
    assert got.best >= len(got.history) - 1 and all(h[1] is None for h in got.history)
    assert training.fit(rows.where("part = 'test'"), "v", "y", "w", "part") is None
    holes = rows.union(spark.createDataFrame([(900, None, 1.0, 1.0, "train"), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1.0, 1.0, "train"), (902, [1.0] * 6, None, 1.0, "train")], SCHEMA))
    assert np.abs(training.fit(holes.where("part = 'train'"), "v", "y", "w", "part", delta=0.2, rounds=6).coefficients - got.coefficients).max() < 1e-9


def test_predictions_and_split(spark, data):
    got = training.fit(frame(spark, data), "v", "y", "w", "part", delta=0.2, rounds=2)
    x = data[0].astype(float)
    found = {r.id: r.predicted for r in training.predicted(frame(spark, data), "v", got.coefficients).collect()}
    assert max(abs(found[k] - (x[k] @ got.coefficients[:-1] + got.coefficients[-1])) for k in found) < 1e-9
    split = training.weighted_split(frame(spark, data).drop("part", "w").withColumn("d", F.col("id") % 3), "d", "id")
    assert {r.part: r["count"] for r in split.groupBy("part").count().collect()} == {"train": 480, "val": 60, "test": 60}
    assert split.where("weight is null").count() == 0


def test_query_against_numpy(spark):
    from calathea.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    found = {r.name: r.value for r in QUERIES["huber_head"](spark, sf).collect()}
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda r: (r.label, r.vec_id))
    x, y = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows], float)
    part = []
    for label in sorted(set(y)):
        n = int((y == label).sum())
        a, b = round(n * 0.8), round(n * 0.1)
        part += ["train"] * a + ["val"] * b + ["test"] * (n - a - b)
    part = np.array(part)
    w = 1 / np.sqrt(np.array([(y == v).sum() for v in y]))
    w = np.clip(w / w.mean(), 0.3, 6.0)
    tr, va = part == "train", part == "val"
    b, _, _ = model(x[tr], y[tr], w[tr], x[va], y[va], 1.0, 1e-6, 8, 3)
    assert [found[f"x{k}"] for k in range(64)] + [found["intercept"]] == pytest.approx(b.tolist(), abs=2e-6)
