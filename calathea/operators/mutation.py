"""Writes as append-only logs with a latest view, guarded updates, and atomic publishing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(log: DataFrame, key: Sequence[str], order: Sequence[Column], deleted: Column | None = None) -> DataFrame:
    """The last entry of each key; keys whose last entry is a deletion go."""
    w = W.partitionBy(*key).orderBy(*order)
    out = log.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return out if deleted is None else out.where(~F.coalesce(deleted, F.lit(False)))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Old rows without new ones of their key, and of the new ones the first of each key by `order` (by a hash of the row,
    if there is none)."""
    new = latest(new, key, order or [F.xxhash64(*new.columns)])
    return old.join(new, list(key), "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there yet."""
    return old.unionByName(new.dropDuplicates(list(key)).join(old, list(key), "left_anti"))


def guarded_update(rows: DataFrame, changes: DataFrame, key: str, column: str, expected: str, value: str) -> DataFrame:
    """Rows with changed values where each change's expected old value holds; raises, changing nothing, if one does not."""
    joined = rows.join(changes, key, "left")
    found = joined.where(F.col(expected).isNotNull()).agg(F.count("*").alias("n"), F.count_if(F.col(column).eqNullSafe(F.col(expected))).alias("ok")).first()
    wanted = changes.count()
    if (found.n, found.ok) != (wanted, wanted):
        raise ValueError(f"{wanted} changes, {found.n} rows found, {found.ok} with the expected value")
    return joined.withColumn(column, F.when(F.col(expected).isNotNull(), F.col(value)).otherwise(F.col(column))).select(rows.columns)


def redirected(decisions: DataFrame, bridge: DataFrame, source: str, target: str, key: str = "id", state: str = "state") -> DataFrame:
    """Decisions on bridged sources move to their targets, unless those have one of their own; of several that move to one
    target, the smallest."""
    moved = decisions.join(bridge, decisions[key] == bridge[source]).select(F.col(target).alias(key), F.col(state))
    own = decisions.join(bridge, decisions[key] == bridge[source], "left_anti").select(key, state)
    return own.unionByName(moved.groupBy(key).agg(F.min(state).alias(state)).join(own, key, "left_anti"))


def publish(rows: DataFrame, path: str, least: int = 1, keep: str | None = None) -> int:
    """Write beside the target, check the count, and swap: the old version is moved aside, to `keep` if given, and deleted
    only when the new one has its name. A run that was broken off between leaves the old version under `<path>.old`,
    which the next run puts back first. Returns the count."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    named = lambda end: jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end)
    target, part, old = named(""), named(".next"), named(".old")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def move(source, to) -> None:  # noqa: ANN001
        if not fs.rename(source, to):
            raise OSError(f"cannot rename {source} to {to}")

    if fs.exists(old) and not fs.exists(target):
        move(old, target)
    rows.write.mode("overwrite").parquet(part.toString())
    n = spark.read.parquet(part.toString()).count()
    if n < least:
        fs.delete(part, True)
        raise ValueError(f"{n} rows, at least {least} wanted")
    fs.delete(old, True)
    if fs.exists(target):
        move(target, old)
    move(part, target)
    if fs.exists(old):
        if keep:
            last = jvm.org.apache.hadoop.fs.Path(keep)
            fs.delete(last, True)
            move(old, last)
        else:
            fs.delete(old, True)
    return n


def claimed(clusters: DataFrame, claims: DataFrame, cluster: str = "cluster", person: str = "person") -> DataFrame:
    """Clusters with the person that claims them; a cluster that is claimed already keeps its person, and of several new
    claims the smallest person's holds."""
    first = claims.groupBy(cluster).agg(F.min(person).alias("__new"))
    return clusters.join(first, cluster, "left").withColumn(person, F.coalesce(person, "__new")).select(clusters.columns)


def dismissed(clusters: DataFrame, ids: DataFrame, cluster: str = "cluster", flag: str = "dismissed") -> DataFrame:
    """Clusters with those of the ids marked as dismissed; earlier marks stay."""
    marks = ids.select(cluster).distinct().withColumn("__now", F.lit(True))
    return clusters.join(marks, cluster, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) | F.coalesce("__now", F.lit(False))).select(clusters.columns)


def paired_anew(assets: DataFrame, pairs: DataFrame, still: str = "still", clip: str = "clip", key: str = "asset") -> DataFrame:
    """Assets with is_still, is_clip and partner set from the pairs alone: what earlier runs set is forgotten."""
    first = lambda a, b: pairs.groupBy(F.col(a).alias(key)).agg(F.min(b).alias("__partner"))
    sides = first(still, clip).withColumn("__side", F.lit("still")).unionByName(first(clip, still).withColumn("__side", F.lit("clip")))
    kept = [c for c in assets.columns if c not in ("is_still", "is_clip", "partner")]
    of = lambda side: F.coalesce(F.col("__side") == side, F.lit(False))
    return assets.select(kept).join(sides, key, "left").select(*kept, of("still").alias("is_still"), of("clip").alias("is_clip"), F.col("__partner").alias("partner"))
