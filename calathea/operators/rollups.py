"""Aggregations over a calendar hierarchy, decisions, rules and coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S


def decision_counts(rows: DataFrame, keys: Sequence[str | Column], state: str = "state") -> DataFrame:
    """total, decided, cut, kept, pct and label of each group; undecided states are null."""
    s = F.col(state)
    out = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count(s).alias("decided"), F.count_if(s == "cut").alias("cut"), F.count_if(s == "keep").alias("kept"))
    return out.withColumn("pct", S.pct(F.col("decided"), F.col("total"))).withColumn("label", S.state_label(F.col("decided"), F.col("total")))


def calendar(rows: DataFrame, date: str, state: str = "state") -> DataFrame:
    """(m, d, total, decided, cut, pct, label) for each of the 366 days of a leap year, zero-filled."""
    spark = rows.sparkSession
    spine = spark.range(366).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    spine = spine.select(F.month("day").alias("m"), F.dayofmonth("day").alias("d"))
    counts = decision_counts(rows.where(F.col(date).isNotNull()), [F.month(date).alias("m"), F.dayofmonth(date).alias("d")], state)
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "decided", "cut")}
    return spine.join(counts, ["m", "d"], "left").select("m", "d", *zero.values(), F.coalesce("pct", F.lit(0.0)).alias("pct"), F.coalesce("label", F.lit("untouched")).alias("label"))


def hierarchy(rows: DataFrame, levels: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Measures at each level of a hierarchy and in total; `level` tells how many keys a row is grouped by."""
    out = rows.rollup(*levels).agg(*(m.alias(n) for n, m in measures.items()), F.grouping_id().alias("__g"))
    level = F.lit(len(levels)) - F.length(F.regexp_replace(F.bin("__g"), "0", ""))
    return out.withColumn("level", level.cast("int")).drop("__g")


def pivot_counts(rows: DataFrame, key: str | Column, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of given values side by side, with the row's total over them; one pass of conditional sums."""
    cells = [F.count_if(F.col(column) == v).alias(v) for v in values]
    return rows.groupBy(key).agg(*cells, F.count_if(F.col(column).isin(*values)).alias("total"))


def rule_model(nominations: DataFrame, sizes: DataFrame, key: str = "id", size: str = "size") -> DataFrame:
    """(rule, n, gb, amber): amber marks the rule with most bytes."""
    found = nominations.distinct().join(sizes, key).groupBy("rule").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    top = F.max("bytes").over(W.partitionBy())
    return found.select("rule", "n", F.round(F.col("bytes") / 1e9, 6).alias("gb"), (F.col("bytes") == top).alias("amber"))


def coverage(population: DataFrame, processed: Mapping[str, DataFrame], key: str = "id", limit: float = 1.0) -> DataFrame:
    """(signal, total, covered, gap, gap_pct, passed) of each signal over a population of ids. An empty population passes
    nothing: what sees none of its subjects can't vouch for them."""
    parts = []
    for name, ids in processed.items():
        seen = ids.select(key).distinct().withColumn("__seen", F.lit(1))
        n = population.select(key).join(seen, key, "left").agg(F.count("*").alias("total"), F.count("__seen").alias("covered"))
        gap = F.col("total") - F.col("covered")
        parts.append(n.select(F.lit(name).alias("signal"), "total", "covered", gap.alias("gap"), F.when(F.col("total") > 0, F.round(100.0 * gap / F.col("total"), 2)).otherwise(0.0).alias("gap_pct")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("passed", (F.col("total") > 0) & (F.col("gap_pct") <= limit))


def modal(rows: DataFrame, group: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent non-null value of each group; ties go to the smallest."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).count()
    return counts.groupBy(*group).agg(F.max_by(value, F.struct(F.col("count"), F.lit(0))).alias("__any"), F.max("count").alias("__top")).join(counts, list(group)).where(F.col("count") == F.col("__top")).groupBy(*group).agg(F.min(value).alias(name))


def period_facts(rows: DataFrame, group: Sequence[str], ts: str, duration: str, camera: str) -> DataFrame:
    """Counts, longest duration, modal time of day, two commonest cameras, busiest day and whether it is a spike."""
    t = F.timestamp_seconds(F.col(ts)) if dict(rows.dtypes)[ts] in ("bigint", "int") else F.col(ts)
    dated = rows.withColumn("__day", F.to_date(t)).withColumn("__tod", S.time_of_day(F.hour(t)))
    base = dated.groupBy(*group).agg(F.count("*").alias("n"), F.round(F.max(duration)).cast("long").alias("longest"), F.count_distinct("__day").alias("days"))
    tod = modal(dated, group, "__tod", "time_of_day")
    cameras = dated.where(F.col(camera).isNotNull()).groupBy(*group, camera).count()
    two = cameras.withColumn("__r", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("count"), camera))).where("__r <= 2")
    two = two.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(camera).alias("c")))), lambda x: x["c"]).alias("cameras"))
    by_day = dated.where(F.col("__day").isNotNull()).groupBy(*group, "__day").count()
    busy = by_day.groupBy(*group).agg(F.max_by("__day", F.struct(F.col("count"), -F.unix_date("__day"))).alias("busiest"), F.max("count").alias("__top"), F.avg("count").alias("__mean"))
    busy = busy.select(*group, "busiest", (F.col("__top") >= F.greatest(F.lit(20.0), 2.5 * F.col("__mean"))).alias("spike"))
    return base.join(tod, list(group), "left").join(two, list(group), "left").join(busy, list(group), "left")
