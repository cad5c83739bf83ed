"""Derivations over asset tables: orders, groups, representatives, overrides, summaries, scoring heads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ranges, windows


def like_any_case(text: Column, pattern: str) -> Column:
    """A pattern whose letters match in either case, null-safe: false of null."""
    return F.coalesce(text.ilike(pattern), F.lit(False))


def protected(path: Column, model: Column, models: Sequence[str], prefixes: Sequence[str]) -> Column:
    """Whether an asset is of a protected camera, carries its mark, or lies below a protected folder."""
    out = F.coalesce(model.isin(*models), F.lit(False)) | like_any_case(path, r"%\_singular\_display%")
    for p in prefixes:
        out = out | F.coalesce(F.lower(path).startswith(p.lower()), F.lit(False))
    return out


def clip_tier(kind: Column, live: Column, seconds: Column, kinds: Sequence[str] = ("MOV",)) -> Column:
    """A2a under a second, A2b under three, of clips that are not live; unknown lengths have no tier."""
    clip = F.upper(kind).isin(*kinds) & ~F.coalesce(live, F.lit(False))
    return F.when(clip & (seconds < 1), "A2a").when(clip & (seconds >= 1) & (seconds < 3), "A2b")


def bare(*columns: Column) -> Column:
    """Whether all are null."""
    out = F.lit(True)
    for c in columns:
        out = out & c.isNull()
    return out


def screenshots_or_documents(labels: DataFrame, assets: DataFrame, key: str, kind: str, category: str = "category", ocr_least: int = 4, images: Sequence[str] = ("PNG", "JPG", "JPEG", "HEIC")) -> DataFrame:
    """Ids of images with a document label, with many text labels, or PNGs with any."""
    marks = labels.groupBy(key).agg(F.max((F.col(category) == "document").cast("int")).alias("__d"), F.count_if(F.col(category) == "ocr").alias("__o"))
    hit = (F.col("__d") == 1) | (F.col("__o") >= ocr_least) | ((F.upper(kind) == "PNG") & (F.col("__o") > 0))
    return assets.join(marks, key).where(hit & F.upper(kind).isin(*images)).select(key)


def manifest(cut: DataFrame, clips: DataFrame, key: str, size: str, still: str, clip: str) -> DataFrame:
    """(position keys, id, role): cut assets by size, largest first, each followed by its motion clip."""
    own = cut.select(F.col(key).alias("still"), F.col(size).alias("still_size"), F.col(key).alias("id"), F.lit("still").alias("role"))
    more = clips.join(cut, clips[still] == cut[key]).select(F.col(still).alias("still"), F.col(size).alias("still_size"), F.col(clip).alias("id"), F.lit("live_motion").alias("role"))
    return own.unionByName(more).orderBy(F.desc("still_size"), "still", F.desc("role"))


def in_order(rows: DataFrame, ids: Sequence[int], key: str) -> DataFrame:
    """The rows of given ids, in their order; a caller's list, so it is small."""
    table = rows.sparkSession.createDataFrame([(k, i) for k, i in enumerate(ids)], f"__at int, {key} long")
    return rows.join(F.broadcast(table), key).orderBy("__at").drop("__at")


def prioritised(rows: DataFrame, source: str, priority: Sequence[str], key: str, seed: int, k: int) -> DataFrame:
    """k rows by the rank of their source, then in keyed random order."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(source))
    return rows.orderBy(F.when(rank > 0, rank).otherwise(len(priority) + 1), F.xxhash64(key, F.lit(seed)), key).limit(k)


def best_then_random(rows: DataFrame, score: str, key: str, seed: int, k: int) -> DataFrame:
    """k rows: the scored ones, best first, topped up by others in keyed random order."""
    return rows.orderBy(F.col(score).isNull(), F.desc(score), F.xxhash64(key, F.lit(seed)), key).limit(k)


def duplicate_groups(rows: DataFrame, by: Sequence[Column], digest: str, key: str, bad: str = "ERR:") -> DataFrame:
    """(key, group): members of groups of two or more equal rows; a group is named by its smallest key."""
    named = [c.alias(f"__b{k}") for k, c in enumerate(by)]
    some = rows.where(F.col(digest).isNotNull() & ~F.col(digest).startswith(bad)).select(key, digest, *named)
    on = [digest, *(f"__b{k}" for k in range(len(by)))]
    groups = some.groupBy(*on).agg(F.min(key).alias("group"), F.count("*").alias("__n")).where("__n > 1")
    match = [some[c].eqNullSafe(groups[c]) for c in on]
    return some.join(groups, match).select(some[key], "group")


def top_labels(labels: DataFrame, key: str, category: str, term: str, score: str, n: int) -> DataFrame:
    """(key, category, terms): the n best terms of each category of an asset."""
    w = W.partitionBy(key, category).orderBy(F.col(score).desc_nulls_last(), term)
    top = labels.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    return top.groupBy(key, category).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", term))), lambda x: x[term]).alias("terms"))


def _best(key: str, score: str, where: Column | None = None) -> Column:
    """The key of the largest score, of equal ones the smallest; rows without key or score are passed over."""
    some = F.col(key).isNotNull() & F.col(score).isNotNull()
    return F.max_by(key, F.when(some if where is None else some & where, F.struct(score, F.bitwise_not(key))))


def people(faces: DataFrame, person: str, face: str, asset: str, confirmed: str, score: str) -> DataFrame:
    """(person, faces, assets, confirmed, face): counts, and the face that was detected best, of equal ones the smallest."""
    return faces.groupBy(person).agg(
        F.count("*").alias("faces"), F.count_distinct(asset).alias("assets"), F.count_if(F.col(confirmed)).alias("confirmed"),
        _best(face, score).alias("face"),
    )


def single_seeds(names: DataFrame, faces: DataFrame, asset: str, person: str, face: str) -> DataFrame:
    """(asset, person, face) of assets with one name and one face."""
    a = names.groupBy(asset).agg(F.count_distinct(person).alias("__n"), F.min(person).alias(person)).where("__n = 1")
    b = faces.groupBy(asset).agg(F.count("*").alias("__f"), F.min(face).alias(face)).where("__f = 1")
    return a.join(b, asset).select(asset, person, face)


def by_representative(left: DataFrame, right: DataFrame, digest: str, key: str) -> DataFrame:
    """Left rows with the smallest key of the right rows of the same content, null where there is none."""
    first = right.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(key).alias(f"first_{key}"))
    return left.join(first, digest, "left")


def overridden(rows: DataFrame, renders: DataFrame, key: str, path: str, new_path: str) -> DataFrame:
    """Rows whose path is the rendered one where there is one."""
    return rows.join(renders.select(key, new_path), key, "left").withColumn(path, F.coalesce(new_path, path)).drop(new_path)


def edit_marks(members: DataFrame, key: str, group: str, role: str) -> DataFrame:
    """(key, is_edit, has_edits): roles in edit groups; originals of groups with an edit have edits."""
    groups = members.groupBy(group).agg(F.max((F.col(role) == "edit").cast("int")).alias("__e"))
    out = members.join(groups, group)
    edit = F.coalesce(F.col(role) == "edit", F.lit(False))
    return out.select(key, edit.alias("is_edit"), (~edit & (F.col("__e") == 1)).alias("has_edits"))


def hero(rows: DataFrame, group: Sequence[str], key: str, score: str, blur: str, still: str) -> DataFrame:
    """(group, hero): the still with the best score, else the sharpest, else none; of equal ones the smallest."""
    return rows.groupBy(*group).agg(F.coalesce(*(_best(key, c, F.col(still)) for c in (score, blur))).alias("hero"))


def live_pairs(assets: DataFrame, key: str, uuid: str, name: str, kind: str, ts: str, live: str, stills: Sequence[str] = ("HEIC", "JPG", "JPEG")) -> DataFrame:
    """(still, mov, method, confidence): pairs of one uuid; then, by stem, the nearest free still within a day.

    One candidate is taken whatever its time. Clips of one stem choose one after another within the stem's group. Clips
    meet the stills of their day and the days beside it, so a stem that many have is never multiplied out; those without
    a time are as near to all.
    """
    from ..functions import scalars as S
    from . import greedy

    up = F.upper(kind)
    sure = assets.where(F.col(uuid).isNotNull()).groupBy(uuid).agg(
        F.count_if(up.isin(*stills)).alias("__s"), F.count_if(up == "MOV").alias("__m"), F.max(F.when(up.isin(*stills), F.col(key))).alias("still"), F.max(F.when(up == "MOV", F.col(key))).alias("mov")
    ).where("__s = 1 and __m = 1").select("still", "mov", F.lit("uuid").alias("method"), F.lit(1.0).alias("confidence"))
    base = S.live_base(F.col(name))
    free_s = assets.where(up.isin(*stills)).join(sure, F.col(key) == F.col("still"), "left_anti").select(base.alias("stem"), F.col(key).alias("still"), F.col(ts).alias("__ts"))
    free_m = assets.where((up == "MOV") & F.col(live)).join(sure, F.col(key) == F.col("mov"), "left_anti").select(base.alias("stem"), F.col(key).alias("mov"), F.col(ts).alias("__tm"))
    many = free_s.groupBy("stem").agg(F.count("*").alias("__n"))
    one, more = (free_s.join(many.where(c), "stem", "left_semi") for c in ("__n = 1", "__n > 1"))
    day = lambda t: F.floor(F.col(t) / 86_400)
    around = free_m.where("__tm is not null").withColumn("__day", F.explode(F.array(day("__tm") - 1, day("__tm"), day("__tm") + 1)))
    near = around.join(more.withColumn("__day", day("__ts")), ["stem", "__day"]).drop("__day")
    untimed = free_m.where("__tm is null").join(more, "stem").unionByName(free_m.where("__tm is not null").join(more.where("__ts is null"), "stem"))
    cost = F.coalesce(F.abs(F.col("__ts") - F.col("__tm")).cast("double"), F.lit(0.0))
    single = free_m.join(one, "stem").withColumn("cost", cost)
    pairs = single.unionByName(near.unionByName(untimed).withColumn("cost", cost).where("cost <= 86400")).withColumn("order", F.col("mov"))
    found = greedy.one_to_one(pairs, "stem", "mov", "still", "cost", "order")
    return sure.unionByName(found.select("still", "mov", F.lit("name").alias("method"), F.lit(0.9).alias("confidence")))


def visible_decile(rows: DataFrame, group: str, score: str, name: str = "decile") -> DataFrame:
    """min(9, floor(10 * rows below / n)) within a group; nulls are below all others."""
    table = windows.value_ranks(rows.select(group, score), score, [group])
    table = table.select(F.col(group).alias("__group"), F.col(score).alias("__score"), F.least(F.lit(9), F.floor(10 * F.col("__below") / F.col("__of"))).cast("int").alias(name))
    same = F.col(group).eqNullSafe(F.col("__group")) & F.col(score).eqNullSafe(F.col("__score"))
    return rows.join(table, same, "left").select(*rows.columns, name)


def _gelu(x: np.ndarray) -> np.ndarray:
    """x * Phi(x), with the error function to about 1e-7 by a rational approximation."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-z * z)
    return x * 0.5 * (1 + np.sign(x) * erf)


def head_scores(rows: DataFrame, key: str, vec: str, layers: Sequence[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(key, score) of a dense head: GELU between layers, a sigmoid at the end; its weights go to every task."""

    @F.pandas_udf(T.DoubleType())
    def run(v: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(a, float) for a in v]) if len(v) else np.zeros((0, len(layers[0][0])))
        for k, (w, b) in enumerate(layers):
            x = x @ w + b
            if k < len(layers) - 1:
                x = _gelu(x)
        return pd.Series(1 / (1 + np.exp(-x[:, 0])))

    return rows.select(key, run(vec).alias("score"))


def shown(rows: DataFrame, key: str, sets: Mapping[str, DataFrame]) -> DataFrame:
    """A lean projection: rows with a boolean for each set of ids that they are in."""
    out = rows
    for name, ids in sets.items():
        marks = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn(name, F.lit(True))
        out = out.join(marks, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def item_details(rows: DataFrame, key: str, width: str, height: str, size: str, make: str, model: str) -> DataFrame:
    """(key, dims, megabytes, camera) as labelled strings, a dash where nothing is known."""
    dash = F.lit("—")
    dims = F.format_string("%d × %d (%.1f MP)", F.col(width), F.col(height), F.col(width) * F.col(height) / 1e6)
    camera = F.concat_ws(" ", make, model)
    return rows.select(key, F.coalesce(F.when(F.col(width).isNotNull() & F.col(height).isNotNull(), dims), dash).alias("dims"), F.coalesce(F.when(F.col(size).isNotNull(), F.format_string("%.1f MB", F.col(size) / 1e6)), dash).alias("megabytes"), F.when(camera == "", dash).otherwise(camera).alias("camera"))


def shared_item(flag: Column, name: Column) -> Column:
    """Whether an asset is flagged as shared or has a mark of shared items in its name."""
    from ..functions import scalars as S

    return F.coalesce(flag, F.lit(False)) | F.coalesce(S.shared_flag(name), F.lit(False))


def in_dated_folder(path: Column) -> Column:
    """Whether a path leads through a folder of a year and one of its months."""
    return F.coalesce(path.rlike("/[0-9]{4}/[0-9]{2}/"), F.lit(False))


def copies(rows: DataFrame, digest: str, ts: str, path: str, key: str) -> DataFrame:
    """Rows of contents that occur twice or more, with keep_rank: dated ones first, then those in dated folders, then by
    key; rank 1 is kept."""
    w = W.partitionBy(digest)
    order = F.col(ts).isNull(), ~in_dated_folder(F.col(path)), F.col(key)
    ranked = rows.where(F.col(digest).isNotNull()).withColumn("__n", F.count("*").over(w)).withColumn("keep_rank", F.row_number().over(w.orderBy(*order)))
    return ranked.where("__n > 1").drop("__n")


def in_period(year: Column, month: Column, y: int | None, m: int | None) -> Column:
    """Whether a row is of a month, of a year without a month, or (y null) undated."""
    if y is None:
        return year.isNull()
    return F.coalesce(year == y, F.lit(False)) & (month.isNull() if m is None else F.coalesce(month == m, F.lit(False)))


def seen(rows: DataFrame, key: str, hidden: DataFrame, vault: DataFrame, reveal: bool) -> DataFrame:
    """Rows that a view shows: none that is hidden, or, where hidden ones are to be revealed, none of the vault."""
    return rows.join((vault if reveal else hidden).select(F.col(hidden.columns[0] if not reveal else vault.columns[0]).alias(key)), key, "left_anti")


def keepers_first(rows: DataFrame, group: Sequence[str], key: str, keeper: Column, seed: int, k: int) -> DataFrame:
    """(group, key, place): k rows of each group in keyed random order, keepers before others."""
    w = W.partitionBy(*group).orderBy(~F.coalesce(keeper, F.lit(False)), F.xxhash64(key, F.lit(seed)), key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(*group, key, "place")


def anchors(rows: DataFrame, group: Sequence[str], key: str, live: str, cap: int = 300) -> DataFrame:
    """(group, key): at most `cap` anchors of each group: the live ones first, in order of keys; what room they leave goes
    to the others, at even steps of their order, both ends included."""
    ranked = ranges.running(rows, [*group, live], [key], "__at", "__n").withColumn("__at", F.col("__at") - 1)
    # the live ones of a group, a row for each group
    alive = rows.groupBy(*(F.col(c).alias(f"__g{k}") for k, c in enumerate(group))).agg(F.count_if(F.col(live)).alias("__alive"))
    same = F.lit(True)
    for k, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{k}"))
    ranked = ranked.join(alive, same).withColumn("__need", F.greatest(F.lit(0), cap - F.col("__alive")))
    need = F.col("__need")
    # place i of the sample is row floor(i * (n - 1) / (need - 1)); the place that a row could be, and whether it is
    last, steps = F.greatest(F.lit(1), F.col("__n") - 1), F.greatest(F.lit(1), need - 1)
    place = F.expr("(__at * greatest(1, __need - 1) + greatest(1, __n - 1) - 1) div greatest(1, __n - 1)")
    drawn = (F.col("__n") <= need) | ((need == 1) & (F.col("__at") == 0)) | ((need > 1) & (F.floor(place * last / steps + 1e-9) == F.col("__at")))
    return ranked.where(F.when(F.col(live), F.col("__at") < cap).otherwise(drawn & (need > 0))).select(*group, key)


def by_day(rows: DataFrame, ts: str, key: str) -> DataFrame:
    """In order of time, undated first, then key."""
    return rows.orderBy(F.coalesce(F.col(ts), F.lit(0)), key)


def worst_first(rows: DataFrame, score: str, ts: str, key: str) -> DataFrame:
    """In order of score, unscored last, then time, then key."""
    return rows.orderBy(F.col(score).asc_nulls_last(), ts, key)


def newest(rows: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """Newest (greatest) keys first, all or the first k."""
    out = rows.orderBy(F.desc(key))
    return out if k is None else out.limit(k)


def overlap_and_rest(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, part) of the first set's keys: both, or first only."""
    marks = b.select(key).distinct().withColumn("__b", F.lit(True))
    return a.select(key).distinct().join(marks, key, "left").select(key, F.when(F.col("__b"), "both").otherwise("first").alias("part"))


def without_chips(rows: DataFrame, key: str, categories: DataFrame, category: str, chosen: Sequence[str]) -> DataFrame:
    """Rows that are in none of the chosen categories."""
    return rows.join(categories.where(F.col(category).isin(*chosen)).select(key), key, "left_anti")


def dense_ids(rows: DataFrame, cell: Sequence[str], chain: str, start: str, name: str = "cluster_id") -> DataFrame:
    """(cell, chain, start, size, cluster_id): chains numbered from 1 in order of cell and start, over all of them; each
    range of cells is numbered in a task of its own."""

    found = rows.groupBy(*cell, chain).agg(F.min(start).alias("start"), F.count("*").alias("size"))
    order = F.struct(*cell, "start", chain)
    return windows.numbered(found.withColumn("__order", order), cell[0], "__order", name).drop("__order")
