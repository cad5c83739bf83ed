"""A linear head, fitted to weighted rows with a loss that outliers don't rule, and stopped by rank agreement.

Iteratively reweighted least squares: each round weighs a row by its own weight and by what Huber's loss makes of its
residual under the last coefficients, and solves the normal equations. Their entries are summed where the rows are, in
one array for each partition, then by place in a second aggregation; the driver sees one vector of the model's size a
round, never a row. After each round the validation rows are ranked by prediction; the coefficients with the best
Spearman agreement stay, and `patience` rounds without a better one end the fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluation
from .durable import written


@dataclass
class Fit:
    """Coefficients (the last one is the intercept), the round they are from, and (loss, agreement) of each round."""

    coefficients: np.ndarray
    best: int
    history: list[tuple[float, float | None]]


def _matrix(vectors: pa.Array) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def _sums(coefficients: np.ndarray | None, delta: float) -> Callable:
    """Of a partition (vector, target, weight): the upper normal equations, the right sides, the loss and the weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, w = _matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            residual = y - x @ coefficients if coefficients is not None else np.zeros(len(y))
            size = np.abs(residual)
            loss = np.where(size <= delta, residual**2 / 2, delta * (size - delta / 2))
            own = w * np.where(size <= delta, 1.0, delta / np.maximum(size, delta))
            part = np.concatenate([(x * own[:, None]).T @ x, ((x * own[:, None]).T @ y)[:, None]], axis=1).ravel()
            part = np.concatenate([part, [float((loss * w).sum()), float(w.sum())]])
            total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    return run


def _solve(rows: DataFrame, coefficients: np.ndarray | None, delta: float, ridge: float) -> tuple[np.ndarray | None, float]:
    """(new coefficients, loss under the old ones)."""
    parts = rows.select("vec", "target", "weight").mapInArrow(_sums(coefficients, delta), "sums array<double>")
    found = parts.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    if not found:
        return None, 0.0
    sums = np.array([r.x for r in found])
    n = int(round((-1 + (1 + 4 * (len(sums) - 2)) ** 0.5) / 2))
    both = sums[:-2].reshape(n, n + 1)
    keep = np.eye(n) * ridge * sums[-1]
    keep[-1, -1] = 0.0  # the intercept is free
    return np.linalg.solve(both[:, :n] + keep, both[:, n]), float(sums[-2] / sums[-1])


def predicted(rows: DataFrame, vec: str, coefficients: np.ndarray, name: str = "predicted") -> DataFrame:
    """The rows with their prediction, as an expression."""
    terms = F.zip_with(F.col(vec).cast("array<double>"), F.array(*map(F.lit, coefficients[:-1].tolist())), lambda a, b: a * b)
    return rows.withColumn(name, F.aggregate(terms, F.lit(float(coefficients[-1])), lambda a, x: a + x))


def fit(rows: DataFrame, vec: str, target: str, weight: str, part: str, delta: float = 0.1, ridge: float = 1e-6, rounds: int = 30, patience: int = 5) -> Fit | None:
    """Fits on rows whose `part` is train and validates on val; None without training rows. Rows with a null take no part.
    Without validation rows the last round counts, and rounds end when the loss does not fall any more."""
    table = rows.select(F.col(vec).alias("vec"), F.col(target).cast("double").alias("target"), F.col(weight).cast("double").alias("weight"), F.col(part).alias("part"))
    sound = F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull()) & F.col("target").isNotNull() & F.col("weight").isNotNull()
    table = written(table.where(sound & F.col("part").isin("train", "val")), "training")
    train, val = (table.where(F.col("part") == p) for p in ("train", "val"))
    now, _ = _solve(train, None, delta, ridge)
    if now is None:
        return None
    best, history, idle = Fit(now, 0, []), [], 0
    for n in range(rounds):
        after, loss = _solve(train, now, delta, ridge)
        rank = evaluation.spearman(predicted(val, "vec", now), "predicted", "target").first().spearman
        better = (rank is not None and (best.best == 0 or rank > history[best.best - 1][1])) or (rank is None and (not history or loss < history[-1][0] - 1e-12))
        history.append((loss, rank))
        idle = 0 if better else idle + 1
        if better:
            best = Fit(now, n + 1, history)
        if idle >= patience or np.abs(after - now).max() < 1e-12:
            break
        now = after
    return Fit(best.coefficients, best.best, history)


def weighted_split(rows: DataFrame, stratum: str, order: str) -> DataFrame:
    """`part` and `weight` of rows for training: a stratified split, and weights that balance the strata."""
    return evaluation.balance_weights(evaluation.stratified_split(rows, stratum, [order]), stratum)


def coefficient_rows(spark: SparkSession, found: Fit) -> DataFrame:
    """(name, value): x0, x1, ... and intercept."""
    names = [*(f"x{k}" for k in range(len(found.coefficients) - 1)), "intercept"]
    return spark.createDataFrame(list(zip(names, map(float, found.coefficients), strict=True)), "name string, value double")


