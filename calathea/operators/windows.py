"""Window derivations: keep ranks, gap-chained groups, runs, order statistics, samples, rates and streaks.

Windows partition by a key where its groups are small. Ranks and samples of groups of any size, and of all rows, go by
ranges (``ranges.running``): each is ranked on its own and adds the counts of the lower ones, so no task holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ranges


def keep_rank(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "keep_rank") -> DataFrame:
    """Rank within a group by preference; 1 is kept."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)))


def chains(rows: DataFrame, group: Sequence[str], at: str, tie: str, gap: float, name: str = "chain") -> DataFrame:
    """Numbers, within a group, runs of rows whose steps along `at` are at most `gap`."""
    w = W.partitionBy(*group).orderBy(at, tie)
    step = F.col(at) - F.lag(at).over(w)
    new = F.when(step.isNull() | (step > gap), 1).otherwise(0)
    return rows.withColumn(name, F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)))


def chain_extras(rows: DataFrame, group: Sequence[str], at: str, tie: str, gap: float, least: int, keep: int, best: str) -> DataFrame:
    """Members of chains of at least `least` rows beyond the `keep` best, with size and rank (nulls rank last)."""
    chained = chains(rows, group, at, tie, gap)
    w = W.partitionBy(*group, "chain")
    ranked = chained.withColumn("chain_size", F.count("*").over(w)).withColumn("best_rank", F.row_number().over(w.orderBy(F.col(best).desc_nulls_last(), at, tie)))
    return ranked.where((F.col("chain_size") >= least) & (F.col("best_rank") > keep))


def sessions(rows: DataFrame, group: Sequence[str], at: str, tie: str, gap: float, least: int = 1) -> DataFrame:
    """(group, chain, start, end, n) of sessions with at least `least` rows."""
    found = chains(rows, group, at, tie, gap).groupBy(*group, "chain")
    return found.agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).where(F.col("n") >= least)


def runs(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str = "run") -> DataFrame:
    """Numbers, within a group, runs of equal consecutive values."""
    w = W.partitionBy(*group).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return rows.withColumn(name, F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)))


def numbered(rows: DataFrame, column: str, tie: str, name: str = "rn") -> DataFrame:
    """Global row numbers from 1 by a column, then a tie-break; each range is numbered in a task of its own."""
    return ranges.running(rows, [], [column, tie], name, "__n").drop("__n")


def value_ranks(rows: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, value, __count, __below): how often each value occurs, and how many values of the group are below it.
    Without groups, nulls are left out; else they are below all others."""
    some = rows if group else rows.where(F.col(column).isNotNull())
    counts = some.groupBy(*group, column).agg(F.count("*").alias("__count"))
    upto = ranges.running(counts, group, [column], "__upto", "__of", F.col("__count"))
    return upto.select(*group, column, "__count", (F.col("__upto") - F.col("__count")).alias("__below"), "__of")


def order_statistic(rows: DataFrame, column: str, percent: int) -> DataFrame:
    """(threshold): the value at place min(n - 1, n * percent div 100) of the sorted non-null values; no row of none."""
    n = rows.agg(F.count(column).alias("__n"))
    place = F.least(F.col("__n") - 1, F.floor(F.col("__n") * percent / 100))
    found = value_ranks(rows, column).crossJoin(F.broadcast(n))  # one row
    return found.where((F.col("__below") <= place) & (F.col("__below") + F.col("__count") > place)).select(F.col(column).alias("threshold"))


def library_percentile(rows: DataFrame, column: str, name: str = "percentile") -> DataFrame:
    """round(100 * values below / n), half-even, of each row's value."""
    total = rows.agg(F.count(column).alias("__n"))
    table = value_ranks(rows, column).crossJoin(F.broadcast(total)).select(column, F.bround(100.0 * F.col("__below") / F.col("__n")).cast("int").alias(name))
    return rows.join(table, column)


def rank_share(rows: DataFrame, column: str, tie: str, name: str = "share") -> DataFrame:
    """(row number - 1) / (n - 1): 0 to 1 without ties."""
    total = rows.agg(F.count("*").alias("__n"))
    out = numbered(rows, column, tie, "__rn").crossJoin(F.broadcast(total))
    return out.withColumn(name, F.when(F.col("__n") > 1, (F.col("__rn") - 1) / (F.col("__n") - 1)).otherwise(F.lit(0.0))).drop("__rn", "__n")


def even_sample(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], k: int, ends: bool = True) -> DataFrame:
    """k rows of each group at even steps of an order: both ends included, or at floor(i * n / k)."""
    ranked = ranges.running(rows, group, order, "__at", "__n").withColumn("__at", F.col("__at") - 1)
    n, i = F.col("__n"), F.sequence(F.lit(0), F.lit(k - 1))
    places = F.transform(i, lambda x: F.floor(x * (n - 1) / max(1, k - 1)) if ends else F.floor(x * n / k))
    return ranked.where((n <= k) | F.array_contains(places, F.col("__at").cast("long"))).drop("__at", "__n")


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], cap: Column | int) -> DataFrame:
    """The first rows of each group; the cap may differ by row."""
    ranked = rows.withColumn("__at", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("__at") <= cap).drop("__at")


def rolling_rate(rows: DataFrame, group: Sequence[str], at: str, seconds: int, name: str = "rate", cells: int = 16) -> DataFrame:
    """Rows per second over the window that ends at each row.

    Time is cut into cells of `cells` windows, so that a group with many rows is many tasks' work; a cell also gets the
    rows of the window before it."""
    width, t = cells * seconds, F.col(at)
    own = F.floor(t / width)
    both = F.when(t >= (own + 1) * width - seconds, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = rows.withColumn("__cell", F.explode(both)).withColumn("__own", F.col("__cell").eqNullSafe(own))
    w = W.partitionBy(*group, "__cell").orderBy(at).rangeBetween(-seconds, 0)
    return dealt.withColumn(name, F.count("*").over(w) / F.lit(float(seconds))).where("__own").drop("__cell", "__own")


def rolling_median(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: str, last: int, least: int, name: str = "median") -> DataFrame:
    """Median of the last rows, null before there are `least`."""
    dealt = ranges.with_last(rows, group, order, last - 1)
    w = W.partitionBy(ranges.RANGE, *group).orderBy(*order).rowsBetween(-(last - 1), 0)
    found = dealt.withColumn(name, F.when(F.count(value).over(w) >= least, F.percentile(value, 0.5).over(w)))
    return found.where("__own").select(*rows.columns, name)


def recent_rate(rows: DataFrame, group: Sequence[str], at: str, tie: str, seconds: int, last: int, name: str = "rate") -> DataFrame:
    """Steps per minute over the last rows up to each, those of the last seconds and at most `last`: their number less one,
    over the time from the first to the last of them; null where that is no time."""
    dealt = ranges.with_last(rows, group, [at, tie], last - 1)
    # a look back of so many rows, whatever the seconds hold; what is too old goes there
    w = W.partitionBy(ranges.RANGE, *group).orderBy(at, tie).rowsBetween(-(last - 1), 0)
    dealt = dealt.withColumn("__back", F.collect_list(at).over(w))
    recent = F.filter("__back", lambda x: x >= F.col(at) - seconds)
    n, time = F.size(recent), F.col(at) - F.array_min(recent)
    found = dealt.withColumn(name, F.when(time > 0, (n - 1) / time * 60.0))
    return found.where("__own").select(*rows.columns, name)


def streaks(rows: DataFrame, group: Sequence[str], order: Sequence[str], holds: Column, name: str = "streak") -> DataFrame:
    """How many rows in a row, up to each, a condition has held; null conditions leave the streak as it was."""
    w = W.partitionBy(*group).orderBy(*order)
    flagged = rows.withColumn("__h", holds).withColumn("__breaks", F.sum(F.when(F.col("__h") == F.lit(False), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    inner = W.partitionBy(*group, "__breaks").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return flagged.withColumn(name, F.sum(F.when(F.col("__h"), 1).otherwise(0)).over(inner)).drop("__h", "__breaks")
