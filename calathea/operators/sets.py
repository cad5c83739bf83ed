"""Filters and set algebra over ids: null-safe exclusion, closures, rule nominations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Portrait screen sizes of phones.
SCREENS = (
    (640, 1136), (750, 1334), (828, 1792), (1080, 1920), (1125, 2436), (1170, 2532), (1179, 2556),
    (1206, 2622), (1242, 2208), (1242, 2688), (1284, 2778), (1290, 2796), (1320, 2868),
)


def exclude(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among the ids; null keys stay (unlike NOT IN)."""
    return rows.join(ids.select(key), key, "left_anti")


def keep_only(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_semi")


def union_ids(*parts: DataFrame) -> DataFrame:
    """Distinct ids of one-column tables."""
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def closure(ids: DataFrame, bridge: DataFrame, source: str, target: str, key: str = "id") -> DataFrame:
    """The ids and those that a bridge leads to from them."""
    more = bridge.join(ids, bridge[source] == ids[key], "left_semi").select(F.col(target).alias(key))
    return union_ids(ids.select(key), more)


def flagged(rows: DataFrame, name: str, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows with a boolean column: whether the key is among the ids."""
    marks = ids.select(key).distinct().withColumn(name, F.lit(True))
    return rows.join(marks, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def nominate(rows: DataFrame, rules: Mapping[str, Column], key: str = "id") -> DataFrame:
    """(key, rule) for each rule that holds: one pass over the rows, however many rules there are."""
    hits = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()))
    return rows.select(key, F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("rule"))


def merge_rules(nominations: DataFrame, key: str = "id", hidden: DataFrame | None = None) -> DataFrame:
    """(key, rules) with each key's distinct rules in order, without hidden keys."""
    kept = nominations if hidden is None else exclude(nominations, hidden, key)
    return kept.groupBy(key).agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def rule_summary(nominations: DataFrame, key: str = "id") -> DataFrame:
    """(rule, n): distinct keys of each rule."""
    return nominations.groupBy("rule").agg(F.count_distinct(key).alias("n"))


def screen_sized(width: Column, height: Column, screens: Sequence[tuple[int, int]] = SCREENS) -> Column:
    """Whether a size is a screen's, upright or turned."""
    pairs = sorted({*screens, *((h, w) for w, h in screens)})
    return F.struct(width.cast("int").alias("w"), height.cast("int").alias("h")).isin(*(F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in pairs))


def above_unless_cleared(scores: DataFrame, score: str, bar: float, cleared: DataFrame, key: str = "id") -> DataFrame:
    """Ids that score at the bar or above and are not cleared."""
    return exclude(scores.where(F.col(score) >= bar), cleared, key).select(key)


def held_back(cut: DataFrame, guards: Mapping[str, DataFrame], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(cut without all guards, (guard, n) of what each holds back); guards may overlap."""
    clean, counts = cut, []
    for name, ids in guards.items():
        clean = exclude(clean, ids, key)
        counts.append(keep_only(cut, ids, key).agg(F.count("*").alias("n")).select(F.lit(name).alias("guard"), "n"))
    total = counts[0]
    for c in counts[1:]:
        total = total.union(c)
    return clean, total
