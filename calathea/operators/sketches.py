"""Distinct counts and quantiles that add up: sketches by day, merged to any longer period.

``by_day`` keeps, for each group and day, a count, a theta and an HLL sketch of what is counted distinctly, and a KLL
sketch of a value. ``merged`` adds days to periods, and periods to longer ones, without a row of the table: a new day costs
that day. What the numbers are off by does not depend on how days were merged:

* theta: exact up to 2 ** `lg` distinct items (4,096), beyond that 1 / sqrt(2 ** lg - 1) of them as a standard error;
  also tells how many items two periods share (``shared``).
* HLL: about 0.8 / sqrt(2 ** 12), 1.3 %, in a fixed few kB; for counts that need no intersections.
* KLL: exact while a period has no more values than `k`, beyond that a rank error of about 2.3 / k ** 0.9.

Where the numbers have to be exact at any size, ``exact`` gives those of the periods that outgrew the sketches from the rows.

Nulls are neither counted nor ranked; a group or day that is null is one of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranges


def by_day(rows: DataFrame, group: Sequence[str], day: Column, item: str, value: str, lg: int = 12, k: int = 4_096) -> DataFrame:
    """(group, day, n, theta, hll, kll): a row for each group and day, to be stored and appended to."""
    return rows.groupBy(*group, day.cast("date").alias("day")).agg(
        F.count("*").alias("n"), F.theta_sketch_agg(item, lg).alias("theta"), F.hll_sketch_agg(item, 12).alias("hll"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("kll")
    )


def merged(sketches: DataFrame, group: Sequence[str], period: Column | None = None, name: str = "period", lg: int = 12) -> DataFrame:
    """The sketches of longer periods (of all time, without one)."""
    keys = [*group, *([period.alias(name)] if period is not None else [])]
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.theta_union_agg("theta", lg).alias("theta"), F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll").alias("kll"))


def read(sketches: DataFrame, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """The sketches with `distinct`, `distinct_hll` and a quantile each as q50, q90, ... (null without values)."""
    full = F.kll_sketch_get_n_double("kll") > 0
    out = sketches.withColumn("distinct", F.round(F.theta_sketch_estimate("theta")).cast("long")).withColumn("distinct_hll", F.hll_sketch_estimate("hll"))
    return out.withColumns({f"q{round(q * 100)}": F.when(full, F.kll_sketch_get_quantile_double("kll", F.lit(float(q)))) for q in quantiles})


def exact(rows: DataFrame, group: Sequence[str], period: Column, item: str, value: str, quantiles: Sequence[float] = (0.5,), name: str = "period") -> DataFrame:
    """(group, period, n, distinct, q50, ...): the same without sketches, from the rows. Quantiles are values of the rows:
    the first that a share of them does not exceed. Values are counted and ranked by ranges, so no task holds a period."""
    keys = [*group, name]
    own = rows.withColumn(name, period)
    counts = own.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(item).alias("distinct"))
    tally = own.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    placed = ranges.running(tally, keys, ["__v"], "__at", "__of", F.col("__c"))
    names = [f"q{round(q * 100)}" for q in quantiles]
    found = placed.groupBy(*(F.col(c).alias(f"__{c}") for c in keys)).agg(*(F.min(F.when(F.col("__at") >= q * F.col("__of"), F.col("__v"))).alias(a) for q, a in zip(quantiles, names, strict=True)))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return counts.join(found, same, "left").select(*keys, "n", "distinct", *names)


def shared(a: DataFrame, b: DataFrame, on: Sequence[str], name: str = "shared") -> DataFrame:
    """(on, shared): about how many items the sketches of two sides have in common, by group."""
    left, right = (x.select(*on, F.col("theta").alias(f"__{n}")) for n, x in enumerate((a, b)))
    return left.join(right, list(on)).select(*on, F.round(F.theta_sketch_estimate(F.theta_intersection("__0", "__1"))).cast("long").alias(name))
