"""Greedy choices: an order decides, and each choice closes others.

Where a choice depends on what few rows were chosen before, a fold over an array in Catalyst keeps them as its state;
where it only matters which of two rows comes first, rounds take all choices that nothing open can precede. Orders are
by hash of id and seed, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .durable import written
from .windows import numbered

#: (greatest hash distance, greatest time distance) at which two items are alike, one tier after another.
PORTRAIT_TIERS = ((8, 8), (4, 4), (2, 2), (0, 0))
LANDSCAPE_TIERS = ((8, 8), (2, 2), (0, 0))


def hash_order(rows: DataFrame, key: str, seed: int, name: str = "hash_order") -> DataFrame:
    return rows.withColumn(name, F.xxhash64(key, F.lit(seed)))


def diverse_pick(rows: DataFrame, group: str, key: str, phash: str, ts: str, k: int, seed: int = 1, landscape: str | None = None, depth: int = 256) -> DataFrame:
    """(group, key, place): up to k rows of each group in hash order, none alike one chosen before, first among those
    that `landscape` (a boolean column) doesn't mark, with ever stricter ideas of alike, then among those it does.

    phash is 16 hex digits. A round looks at the first `depth` rows of a group that nothing chosen rules out, and
    folds the choices over them, so a group of any size costs top lists and no task sees all of it.
    """
    phases = [(False, *t) for t in PORTRAIT_TIERS] + [(True, *t) for t in LANDSCAPE_TIERS if landscape]
    half = lambda at: F.conv(F.col(phash).substr(at, 8), 16, 10).cast("long")
    wide = F.coalesce(F.col(landscape), F.lit(False)) if landscape else F.lit(False)
    item = F.struct(F.xxhash64(key, F.lit(seed)).alias("order"), F.col(key).alias("key"), half(1).alias("high"), half(9).alias("low"), F.col(ts).cast("double").alias("ts"))
    known = F.col(phash).rlike("^[0-9a-fA-F]{16}$") & F.col(ts).isNotNull()
    pool = written(rows.where(known).select(F.col(group).alias("grp"), wide.alias("wide"), item.alias("item")), "diverse")
    tier = lambda p, at: F.get(F.array(*(F.lit(x[at]) for x in phases)), p)

    def alike(a: Column, b: Column, phase: Column) -> Column:
        apart = F.bit_count(a["high"].bitwiseXOR(b["high"])) + F.bit_count(a["low"].bitwiseXOR(b["low"]))
        return (apart <= tier(phase, 1)) | (F.abs(a["ts"] - b["ts"]) <= tier(phase, 2))

    kind = pool.schema["item"].dataType
    none = F.array().cast(f"array<{kind.simpleString()}>")
    at = F.struct(F.col("item.order"), F.col("item.key"))
    state = written(pool.select("grp").distinct().select("grp", F.lit(0).alias("phase"), F.lit(None).cast(pool.select(at.alias("a")).schema["a"].dataType).alias("after"), none.alias("chosen")), "diverse")
    done = (F.col("phase") >= len(phases)) | (F.size("chosen") >= k)
    while not state.where(~done).isEmpty():
        open_ = state.where(~done)
        fit = pool.join(open_, "grp").where((F.col("wide") == tier(F.col("phase"), 0)) & (F.col("after").isNull() | (at > F.col("after"))))
        fit = fit.where(~F.exists("chosen", lambda c: alike(c, F.col("item"), F.col("phase"))))
        first = fit.withColumn("__at", F.row_number().over(W.partitionBy("grp").orderBy("item.order", "item.key"))).where(F.col("__at") <= depth)
        seen = first.groupBy("grp").agg(F.array_sort(F.collect_list("item")).alias("seen"))
        turn = open_.join(seen, "grp", "left").withColumn("seen", F.coalesce("seen", none))
        add = lambda acc, x: F.when((F.size(acc) < k) & ~F.exists(acc, lambda c: alike(c, x, F.col("phase"))), F.concat(acc, F.array(x))).otherwise(acc)
        more = F.size("seen") >= depth
        last = F.element_at("seen", -1)
        after = F.when(more, F.struct(last["order"].alias("order"), last["key"].alias("key")))
        turn = turn.select("grp", F.when(more, F.col("phase")).otherwise(F.col("phase") + 1).alias("__phase"), after.cast(state.schema["after"].dataType).alias("__after"), F.aggregate("seen", F.col("chosen"), add).alias("__chosen"))
        turn = turn.toDF(*state.columns)
        state = written(state.where(done).unionByName(turn), "diverse")
    return state.select(F.col("grp").alias(group), F.posexplode("chosen").alias("place", "item")).select(group, F.col("item.key").alias(key), (F.col("place") + 1).alias("place"))


def place_clusters(cells: DataFrame, group: str, radius_km: float = 2.0, most: int = 12, least: int = 3, top: int = 6, radius: float = 6371.0) -> DataFrame:
    """(group, place, lat, lon, n): of each period's cells (lat, lon, n), the largest places.

    Cells, largest first, each go to the earliest place whose centre is within the radius, and move it to the weighted
    mean, or else found a place: a fold over the sorted cells of a period, with the places as its state. Of the `most`
    largest places, the first `top` with at least `least` items stay.
    """
    cell = F.struct(F.negative(F.col("n").cast("double")).alias("rank"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    sorted_cells = cells.where("lat is not null and lon is not null and n > 0").groupBy(group).agg(F.array_sort(F.collect_list(cell)).alias("cells"))

    def settle(places: Column, c: Column) -> Column:
        near = F.transform(places, lambda p: S.haversine_km(p["lat"], p["lon"], c["lat"], c["lon"], radius) <= radius_km)
        home = F.array_position(near, True)
        mean = lambda p, x: (p[x] * p["n"] - c[x] * c["rank"]) / (p["n"] - c["rank"])
        moved = lambda p: F.struct((p["n"] - c["rank"]).alias("n"), mean(p, "lat").alias("lat"), mean(p, "lon").alias("lon"))
        own = F.struct(F.negative(c["rank"]).alias("n"), c["lat"].alias("lat"), c["lon"].alias("lon"))
        return F.when(home == 0, F.concat(places, F.array(own))).otherwise(F.transform(places, lambda p, i: F.when(i + 1 == home, moved(p)).otherwise(p)))

    none = F.array().cast("array<struct<n:double,lat:double,lon:double>>")
    ranked = F.transform(F.aggregate("cells", none, settle), lambda p, i: F.struct(F.negative(p["n"]).alias("rank"), i.alias("i"), p["lat"].alias("lat"), p["lon"].alias("lon")))
    largest = F.filter(F.slice(F.array_sort(ranked), 1, most), lambda p: p["rank"] <= -least)
    found = sorted_cells.select(group, F.posexplode(F.slice(largest, 1, top)).alias("i", "p"))
    return found.select(group, (F.col("i") + 1).alias("place"), "p.lat", "p.lon", F.negative("p.rank").cast("long").alias("n"))


def one_to_one(pairs: DataFrame, group: str, left: str, right: str, cost: str, order: str, rounds: int = 12) -> DataFrame:
    """(left, right, cost): in order of rows, each left takes its cheapest right not yet taken, within conflict groups.

    A left whose cheapest free right no earlier open left wants takes it, whatever else happens: each round settles all
    such lefts at once. What is still open after `rounds` (crowds of lefts that want the same rights) is folded by group.
    """
    ranks = [F.col(order), F.col(left), F.col(cost), F.col(right)]
    pairs = pairs.select(group, left, right, cost, order)
    taken, rest = _mutual(pairs, [group, left], [group, right], ranks, rounds)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for _, own in pdf.sort_values([order, left]).groupby(left, sort=False):
            free = own[~own[right].isin(used)].sort_values([cost, right])
            if len(free):
                used.add(free[right].iloc[0])
                out.append(free.iloc[0])
        return pd.DataFrame(out, columns=pdf.columns)[[left, right, cost]]

    t = dict(pairs.dtypes)
    found = pairs.limit(0) if taken is None else taken
    found = found.select(left, right, cost)
    return found if rest is None else found.unionByName(rest.groupBy(group).applyInPandas(run, f"{left} {t[left]}, {right} {t[right]}, {cost} {t[cost]}"))


def _mutual(pairs: DataFrame, left: list[str], right: list[str], order: Sequence[Column], rounds: int | None) -> tuple[DataFrame | None, DataFrame | None]:
    """(pairs taken, pairs still open after so many rounds); None for none."""
    open_, taken, done = written(pairs, "mutual"), None, 0
    while not open_.isEmpty():
        if rounds is not None and done == rounds:
            return taken, open_
        first = lambda c: F.row_number().over(W.partitionBy(*c).orderBy(*order)) == 1
        best = written(open_.withColumn("__l", first(left)).withColumn("__r", first(right)).where("__l and __r").drop("__l", "__r"), "mutual")
        taken = best if taken is None else taken.unionByName(best)
        open_ = written(open_.join(best.select(left), left, "left_anti").join(best.select(right), right, "left_anti"), "mutual")
        done += 1
    return taken, None


def mutual_best(pairs: DataFrame, left: str, right: str, order: Sequence[Column]) -> DataFrame:
    """The pairs that a greedy one-to-one choice takes, best first. `order` must rank all pairs apart.

    A pair that is the best of both its ends is taken whatever else happens, so each round takes all such pairs and
    drops those that share an end with one; rounds end when no pair is left.
    """
    taken, _ = _mutual(pairs, [left], [right], order, None)
    return pairs.limit(0) if taken is None else taken


def stable_names(clusters: DataFrame, old: DataFrame, member: str, cluster: str, name: str, carried: Sequence[str] = ()) -> DataFrame:
    """(cluster, name, shared, carried columns): each cluster of `clusters` (member, cluster) gets the name of the group of `old`
    (member, name, carried columns) that it shares most members with, each name once, best overlaps first (ties to the
    greater cluster, then the greater name); the others get fresh names above all old ones, in order of clusters, and
    share 0. What is carried (a claim, a dismissal) is kept with the name, null for fresh ones.
    """
    shared = clusters.join(old.select(member, name), member).groupBy(cluster, name).agg(F.count("*").alias("shared"))
    kept = mutual_best(shared, cluster, name, [F.desc("shared"), F.desc(cluster), F.desc(name)])
    rest = clusters.select(cluster).distinct().join(kept.select(cluster), cluster, "left_anti")
    above = old.agg(F.coalesce(F.max(name), F.lit(-1)).alias("__top"))
    fresh = numbered(rest, cluster, cluster, "__rn").crossJoin(F.broadcast(above))  # one row
    fresh = fresh.select(cluster, (F.col("__top") + F.col("__rn")).alias(name), F.lit(0).cast("long").alias("shared"))
    out = kept.unionByName(fresh)
    return out.join(old.select(name, *carried).distinct(), name, "left").select(cluster, name, "shared", *carried) if carried else out


def opposed_pairs(rows: DataFrame, key: str, a: str, b: str, high: float, low: float, gap_b: float, most: int) -> DataFrame:
    """(x, y): rows that a puts far apart (at `high` or above, at `low` or below) and b the other way round.

    The high rows with the least b meet the low rows with the greatest b, rank by rank, while b differs by more than
    `gap_b`; a top list of `most` pairs at most.
    """
    nth = lambda *order: F.row_number().over(W.orderBy(*order))
    x = rows.where((F.col(a) >= high) & F.col(b).isNotNull()).orderBy(b, key).limit(most).select(F.col(key).alias("x"), F.col(b).alias("__bx"), nth(b, key).alias("__n"))
    y = rows.where((F.col(a) <= low) & F.col(b).isNotNull()).orderBy(F.desc(b), key).limit(most).select(F.col(key).alias("y"), F.col(b).alias("__by"), nth(F.desc(b), key).alias("__n"))
    return x.join(y, "__n").where(F.col("__by") - F.col("__bx") > gap_b).select("x", "y")


def unordered_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs whichever way round, smaller first; pairs of one id go."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


#: Degrees at which a machine is hot, and soft, below which it is cool; the margin to its limit at which it is hot; how
#: many readings in a row count.
HOT_C, SOFT_C, COOL_C, HOT_MARGIN, SUSTAIN = 83.0, 80.0, 77.0, 2.0, 3


def throttle_actions(readings: DataFrame, machine: str, order: str, temperature: str, margin: str) -> DataFrame:
    """(machine, order, action) of the readings that change a machine's state: soft, recover or halt.

    A condition that has held for SUSTAIN readings in a row is an event; readings without a temperature aren't there.
    The first halt ends all. Before it, a machine's state is that of its last event, and an action is a change of it.
    """
    w = W.partitionBy(machine).orderBy(order)
    t = F.col(temperature)
    held = lambda c: (F.min(F.coalesce(c, F.lit(False)).cast("int")).over(w.rowsBetween(1 - SUSTAIN, 0)) == 1) & (F.row_number().over(w) >= SUSTAIN)
    flags = readings.where(t.isNotNull()).select(machine, order, held((t >= HOT_C) | (F.col(margin) <= HOT_MARGIN)).alias("__h"), held(t >= SOFT_C).alias("__s"), held(t < COOL_C).alias("__c"))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    halts = flags.withColumn("__halts", F.sum(F.col("__h").cast("int")).over(upto))
    event = F.when(F.col("__s"), "soft").when(F.col("__c"), "recover")
    states = halts.withColumn("__state", F.coalesce(F.last(event, True).over(upto), F.lit("recover")))
    change = F.when(F.col("__state") != F.lag("__state", 1, "recover").over(w), F.col("__state"))
    action = F.when((F.col("__halts") == 1) & F.col("__h"), "halt").when(F.col("__halts") == 0, change)
    return states.withColumn("action", action).where("action is not null").select(machine, order, "action")


def _held(flags: np.ndarray, before: int) -> np.ndarray:
    """How long each flag has held, `before` the first one too."""
    at = np.arange(len(flags))
    broken = np.maximum.accumulate(np.where(flags, -1, at)) if len(flags) else at
    return np.where(broken < 0, at + 1 + before, at - broken)


def throttle_batch(state: tuple[str, int, int, int], temperature: np.ndarray, margin: np.ndarray) -> tuple[list, tuple[str, int, int, int]]:
    """Actions of a machine's next readings (NaN: missing) by throttle_actions' rules, and its state after them: nominal,
    soft or halted, and how long hot, soft and cool have held."""
    known = np.flatnonzero(~np.isnan(temperature))
    t, m = temperature[known], margin[known]
    runs = [_held(f, n) for f, n in zip(((t >= HOT_C) | (m <= HOT_MARGIN), t >= SOFT_C, t < COOL_C), state[1:], strict=True)]
    hot, soft, cool = (r >= SUSTAIN for r in runs)
    end = 0 if state[0] == "halted" else int(np.argmax(hot)) if hot.any() else len(t)
    # the state is that of the last event, or as it was
    codes = np.where(soft, 1, np.where(cool, 0, -1))[:end]
    last = np.maximum.accumulate(np.where(codes >= 0, np.arange(end), -1)) if end else np.zeros(0, int)
    now = np.where(last >= 0, codes[np.maximum(last, 0)], int(state[0] == "soft")) if end else last
    changed = now != np.concatenate([[int(state[0] == "soft")], now[:-1]])[: len(now)]
    actions = np.full(len(temperature), None, object)
    actions[known[:end][changed]] = np.where(now[changed] == 1, "soft", "recover")
    name = "halted" if end < len(t) or state[0] == "halted" else ("nominal", "soft")[int(now[-1])] if end else state[0]
    if end < len(t) and state[0] != "halted":
        actions[known[end]] = "halt"
    return actions.tolist(), (name, *(int(r[-1]) if len(t) else n for r, n in zip(runs, state[1:], strict=True)))
