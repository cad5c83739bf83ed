"""Order within groups of any size: ranges of (group, order) in place of one task a group.

Rows are dealt by Spark's range partitioning on the group's and the order's columns together, and written, so that a
range keeps its rows. A group of many rows then lies in many ranges and a range holds many small groups. What a range
needs of the ranges before it is an offset for the group that reaches into it, or that group's last rows. At most two
groups of a range go on beyond it, so the tables of offsets have two rows a range and are broadcast.

The number of ranges is that of the shuffle partitions; adaptive execution joins small ones. Order columns should tell
rows apart; equal ones all fall into one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .durable import written

RANGE = "__range"


def dealt(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The rows with the number of their range, written out; ranges follow (group, order)."""
    return written(rows.repartitionByRange(*group, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def offsets(rows: DataFrame, group: Sequence[str], amount: Column) -> DataFrame:
    """(range, group, __offset, __total): for groups that lie in several ranges, the amount in lower ranges and in all."""
    sums = rows.groupBy(RANGE, *group).agg(F.sum(amount).alias("__sum"))
    spans = W.partitionBy(*group)  # a row for each range of a group
    lower = F.sum("__sum").over(spans.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1))
    found = sums.withColumns({"__offset": F.coalesce(lower, F.lit(0)), "__total": F.sum("__sum").over(spans), "__parts": F.count("*").over(spans)})
    return found.where(F.col("__parts") > 1).drop("__sum", "__parts")


def running(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], at: str, total: str, amount: Column | None = None) -> DataFrame:
    """The rows with the sum of an amount (1, if none is given) over their group up to and with each, and over all of it."""
    one = F.lit(1) if amount is None else amount
    table = dealt(rows, group, order)
    before = offsets(table, group, one)
    low = before.select(*(F.col(c).alias(f"__b{k}") for k, c in enumerate([RANGE, *group])), "__offset", "__total")
    same = F.lit(True)
    for k, c in enumerate([RANGE, *group]):
        same = same & F.col(c).eqNullSafe(F.col(f"__b{k}"))
    joined = table.join(F.broadcast(low), same, "left")
    own = W.partitionBy(RANGE, *group)
    here = F.sum(one).over(own.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) if amount is not None else F.row_number().over(own.orderBy(*order)).cast("long")
    out = joined.withColumn(at, F.coalesce("__offset", F.lit(0)) + here).withColumn(total, F.coalesce("__total", F.sum(one).over(own)))
    return out.select(*rows.columns, at, total)


def with_last(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], last: int, own: str = "__own") -> DataFrame:
    """The rows by range, and with `own` false, once more for each range that their group reaches into, the `last` rows
    before it. Windows over (range, group) that look back at most so far are then those over the group."""
    table = dealt(rows, group, order)
    within = W.partitionBy(RANGE, *group)
    before = offsets(table, group, F.lit(1)).where(F.col("__offset") > 0)
    # the last rows before a range are among the last of their own ranges; their places in the group tell which
    spans = offsets(table, group, F.lit(1))
    names = [RANGE, *group]
    low = spans.select(*(F.col(c).alias(f"__b{k}") for k, c in enumerate(names)), F.col("__offset").alias("__from"))
    same = F.lit(True)
    for k, c in enumerate(names):
        same = same & F.col(c).eqNullSafe(F.col(f"__b{k}"))
    tail = table.join(F.broadcast(low), same)
    place = F.row_number().over(within.orderBy(*order))
    tail = tail.withColumn("__place", F.col("__from") + place).withColumn("__left", F.count("*").over(within) - place)
    tail = tail.where(F.col("__left") < last).drop("__left", "__from", *(f"__b{k}" for k in range(len(names))))
    # a range wants the places offset - last + 1 .. offset: two blocks of `last` places
    block = F.floor((F.col("__offset") - 1) / last)
    wants = before.select(*(F.col(c).alias(f"__w{k}") for k, c in enumerate(names)), "__offset", F.explode(F.array(block, block - 1)).alias("__block"))
    meets = (F.floor((F.col("__place") - 1) / last) == F.col("__block")) & (F.col("__place") <= F.col("__offset")) & (F.col("__place") > F.col("__offset") - last)
    for k, c in enumerate(group, 1):
        meets = meets & F.col(c).eqNullSafe(F.col(f"__w{k}"))
    halo = tail.join(F.broadcast(wants), meets).select(*rows.columns, F.col("__w0").alias(RANGE), F.lit(False).alias(own))
    return table.select(*rows.columns, RANGE, F.lit(True).alias(own)).unionByName(halo)
