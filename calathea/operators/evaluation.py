"""Agreement and calibration statistics, splits and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ranges, windows


def confusion(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """(truth, predicted, n)."""
    return rows.groupBy(truth.alias("truth"), predicted.alias("predicted")).agg(F.count("*").alias("n"))


def class_scores(rows: DataFrame, truth: Column, predicted: Column, positive) -> DataFrame:
    """n, accuracy, precision and recall of one class."""
    hit = (truth == positive) & (predicted == positive)
    return rows.agg(F.count("*").alias("n"), F.round(F.avg((truth == predicted).cast("double")), 6).alias("accuracy"), F.round(F.try_divide(F.count_if(hit), F.count_if(predicted == positive)), 6).alias("precision"), F.round(F.try_divide(F.count_if(hit), F.count_if(truth == positive)), 6).alias("recall"))


def errors(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(n, mae, rmse)."""
    d = F.col(predicted) - F.col(truth)
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(d)), 6).alias("mae"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"))


def reliability(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(decile, n, mean_predicted, mean_truth) by predicted decile."""
    return rows.groupBy(S.decile(F.col(predicted)).alias("decile")).agg(F.count("*").alias("n"), F.round(F.avg(predicted), 6).alias("mean_predicted"), F.round(F.avg(truth), 6).alias("mean_truth"))


def average_rank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks from 1, ties sharing the average of theirs."""
    table = windows.value_ranks(rows, column).select(column, (F.col("__below") + (F.col("__count") + 1) / 2.0).alias(name))
    return rows.join(table, column)


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, pearson, spearman) of pairs without nulls."""
    some = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = average_rank(average_rank(some, a, "__ra"), b, "__rb")
    return ranked.agg(F.count("*").alias("n"), F.round(F.corr(a, b), 6).alias("pearson"), F.round(F.corr("__ra", "__rb"), 6).alias("spearman"))


def topk_recall(rows: DataFrame, key: str, a: str, b: str, k: int) -> DataFrame:
    """(k, common, recall): overlap of the k best by either score."""
    best = lambda c: rows.orderBy(F.col(c).desc_nulls_last(), key).limit(k).select(key)
    common = best(a).join(best(b), key, "left_semi")
    return common.agg(F.count("*").alias("common")).select(F.lit(k).alias("k"), "common", F.round(F.col("common") / k, 6).alias("recall"))


def agreement(judgments: DataFrame, winner: str, loser: str) -> DataFrame:
    """(n, agree, rate, low, high): how often the preferred one scores higher, ties and nulls skipped; Wilson at z = 1.96."""
    fair = F.coalesce(F.col(winner) != F.col(loser), F.lit(False))
    z = 1.96
    out = judgments.agg(F.count_if(fair).alias("n"), F.count_if(fair & (F.col(winner) > F.col(loser))).alias("agree"))
    n, p = F.col("n"), F.try_divide(F.col("agree"), F.col("n"))
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    some = lambda c: F.when(n > 0, F.round(c, 6)).otherwise(0.0)
    return out.select("n", "agree", some(p).alias("rate"), some(centre - half).alias("low"), some(centre + half).alias("high"))


def stratified_split(rows: DataFrame, stratum: str, order: Sequence[Column], train: float = 0.8, val: float = 0.1) -> DataFrame:
    """`part`: the first round(train * n) rows of each stratum, then round(val * n), half-even, then test."""
    placed = ranges.running(rows, [stratum], order, "__at", "__n")
    at, a, b = F.col("__at"), F.bround(F.col("__n") * train), F.bround(F.col("__n") * val)
    return placed.withColumn("part", F.when(at <= a, "train").when(at <= a + b, "val").otherwise("test")).drop("__at", "__n")


def balance_weights(rows: DataFrame, bucket: str, low: float = 0.3, high: float = 6.0) -> DataFrame:
    """`weight`: one over the root of the bucket's count, over the mean, clipped."""
    counts = rows.groupBy(bucket).agg(F.count("*").alias("__c"))
    raw = counts.withColumn("__w", 1 / F.sqrt("__c"))
    mean = raw.agg((F.sum(F.col("__w") * F.col("__c")) / F.sum("__c")).alias("__m"))
    table = raw.crossJoin(F.broadcast(mean))
    return rows.join(table.select(bucket, F.least(F.greatest(F.col("__w") / F.col("__m"), F.lit(low)), F.lit(high)).alias("weight")), bucket)


def moments(rows: DataFrame, column: str, bars: Sequence[float]) -> DataFrame:
    """Least, largest, mean, population deviation, median, and counts at or above bars. The median is exact, and found by
    ranges of the values: no buffer holds them."""
    c = F.col(column)
    some = rows.agg(F.min(c).alias("low"), F.max(c).alias("high"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("deviation"), F.count(c).alias("__n"), *(F.count_if(c >= b).alias(f"at_least_{k}") for k, b in enumerate(bars)))
    places = windows.value_ranks(rows, column).crossJoin(F.broadcast(some.select("__n")))  # one row
    at = lambda p: F.max(F.when((F.col("__below") <= p) & (p < F.col("__below") + F.col("__count")), c.cast("double")))
    n = F.col("__n")
    middle = places.agg(((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"))
    return some.crossJoin(middle).select("low", "high", "mean", "deviation", "median", *(f"at_least_{k}" for k in range(len(bars))))  # one row each


def histogram(rows: DataFrame, column: str, low: float, high: float, parts: int) -> DataFrame:
    """(part, n) of equal parts; the last one holds its upper edge."""
    at = F.least(F.floor((F.col(column) - low) / (high - low) * parts), F.lit(parts - 1)).cast("int")
    return rows.where(F.col(column).between(low, high)).groupBy(at.alias("part")).agg(F.count("*").alias("n"))


def faithfulness(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, max_abs, mean_abs): how far two models' scores of the same rows are apart."""
    gap = F.abs(F.col(a) - F.col(b))
    return rows.where(gap.isNotNull()).agg(F.count("*").alias("n"), F.max(gap).alias("max_abs"), F.avg(gap).alias("mean_abs"))
