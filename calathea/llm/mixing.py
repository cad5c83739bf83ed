"""Mixing of sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Method. A document's copies are fractional: its source's target over its source's size. The whole part is taken; the
fractions are rounded by the pivotal method: pairs of a source's documents trade mass, so that their words stay
the same in sum, until one of the two is integral, which of the two by a keyed draw with the right odds. A block of
documents folds in one pass and leaves at most one fraction; these residuals go through a tree of blocks, level by
level, until a source has one left, which a last draw rounds. Blocks fold from large to small, so that a small one is left. So a source's words miss its target by less than its
largest document, whatever its size. Blocks are dealt by hash within a source, so a hot source fills many blocks.

Equal rows (of one source, id and size) are counted, not gathered: each brings as many items as it has rows, and gets
back how many of them are rounded up; where its rows lie, so many of them take one copy more.

Targets: source k in order of code points (null last) weighs 1, 2, 3, repeating; targets share all words by weight,
none above 3 times its source's words, what is cut off shared again by weight among the others.

Defined results: a null text has size 0 and takes 0 words; a null source is a source of its own; a source without
words has the target 0; equal rows are rounded each; an empty table gives no rows. Draws are keyed by the seed and
the documents' ids and sizes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import column, cut

BLOCK = 64
CHUNK = 1_000
WORD = r"[^\x20\x09-\x0D]+"
EPSILON = 1e-9


def size_of(text: Column) -> Column:
    """Number of words of a text, 0 of null."""
    return F.coalesce(F.size(F.split(F.regexp_replace(F.concat(F.lit(" "), text), r"[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")) - 1, F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, docs, target) from a row (source, source_size, docs) for each source.

    Sources whose cap is lowest for their weight are capped first; the level at which the caps stop is found by running sums.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    caps = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("cap", 3.0 * F.col("source_size"))
    ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    level = (F.sum("source_size").over(every) - (F.sum("cap").over(ratio) - F.col("cap"))) / F.sum("weight").over(ratio.rowsBetween(0, W.unboundedFollowing))
    found = caps.withColumn("level", level).withColumn("own", F.col("cap") / F.col("weight")).withColumn("nth", F.row_number().over(ratio))
    stop = F.min_by("level", F.when(F.col("own") >= F.col("level"), F.col("nth"))).over(every)
    return found.withColumn("target", F.least("cap", F.coalesce(stop, F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "docs", "target")


def _draw(*keys: Column) -> Column:
    """A number in [0, 1) from keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def _fold(items: Column, seed: int) -> Column:
    """Pivotal rounding of an array of (id, size, mass, tie), one after another; mass is the open fraction.

    Ends as (done: [(id, tie, up)], open: the item left with a fraction, or null).
    """
    done = "array<struct<id:bigint,tie:bigint,up:int>>"
    start = F.struct(F.array().cast(done).alias("done"), F.lit(None).cast("struct<id:bigint,size:bigint,mass:double,tie:bigint>").alias("open"))

    def step(state: Column, x: Column) -> Column:
        y = state["open"]
        # y's mass moves up by a / y.size and x's down by a / x.size (words a), or the other way round (words b)
        a = F.least((1 - y["mass"]) * y["size"], x["mass"] * x["size"])
        b = F.least(y["mass"] * y["size"], (1 - x["mass"]) * x["size"])
        first = _draw(F.lit(seed), y["id"], x["id"], y["tie"], x["tie"]) * (a + b) < b
        words = F.when(first, a).otherwise(-b)
        my, mx = y["mass"] + words / y["size"], x["mass"] - words / x["size"]
        sy, sx = (F.when(m < EPSILON, 0).when(m > 1 - EPSILON, 1) for m in (my, mx))
        row = lambda i, m, s: F.struct(i["id"].alias("id"), i["size"].alias("size"), m.alias("mass"), i["tie"].alias("tie"))
        out = lambda i, s: F.when(s.isNotNull(), F.array(F.struct(i["id"].alias("id"), i["tie"].alias("tie"), s.cast("int").alias("up")))).otherwise(F.array().cast(done))
        both = F.struct(
            F.concat(state["done"], out(y, sy), out(x, sx)).alias("done"),
            F.when(sy.isNull(), row(y, my, sy)).when(sx.isNull(), row(x, mx, sx)).alias("open"),
        )
        return F.when(y.isNull(), F.struct(state["done"].alias("done"), row(x, x["mass"], None).alias("open"))).otherwise(both)

    return F.aggregate(items, start, step)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken, source) of every document."""
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, source_col).cast("string").alias("source"), size_of(column(docs, text_col).cast("string")).alias("size"))
    rows = cut(rows, "sizes")
    goal = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))), "targets")
    wish = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("wish", F.when(F.abs(wish - F.round(wish)) < EPSILON, F.round(wish)).otherwise(wish))
    goal = goal.withColumn("base", F.floor("wish").cast("int")).withColumn("part", F.col("wish") - F.col("base"))
    joined = rows.join(goal, rows["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    # rows that are equal here have one key; where each lies is written with it, and so the same whatever is run again
    joined = cut(joined.withColumn("id", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("part_id", F.spark_partition_id()), "joined")

    open_ = joined.where((F.col("part") > 0) & (F.col("size") > 0)).groupBy("source", "id", "docs", "part").agg(F.first("size").alias("size"), F.count("*").alias("rows"))
    many = open_.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK))))
    many = many.where("rows > 1").repartition("source", "id", "chunk")
    nth = F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("rows"), (F.col("chunk") + 1) * CHUNK) - 1))
    numbers = open_.where("rows = 1").withColumn("chunk", F.lit(0).cast("long")).unionByName(many).withColumn("nth", nth)
    open_ = numbers.select("source", "id", "size", F.col("part").alias("mass"), F.when(F.col("nth") == 0, F.col("id")).otherwise(F.xxhash64("id", "nth")).alias("tie"), "docs")
    decided, level = None, 0
    while True:
        blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK))
        dealt = open_.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), "tie", "id"), blocks))
        groups = dealt.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct(F.negative("size").alias("order"), "tie", "id", "size", "mass"))).alias("items"), F.max(blocks).alias("docs"))
        items = F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"), x["mass"].alias("mass"), x["tie"].alias("tie")))
        folded = cut(groups.select("source", "docs", _fold(items, seed + level).alias("r")), "folded")
        out = folded.select("source", F.explode("r.done").alias("d")).select("source", "d.id", "d.tie", "d.up")
        decided = out if decided is None else decided.unionByName(out)
        left = folded.where("r.open is not null")
        if left.where("docs > 1").isEmpty():
            last = left.select("source", "r.open.id", "r.open.tie", F.when(_draw(F.lit(seed), F.col("r.open.id"), F.col("r.open.tie")) < F.col("r.open.mass"), 1).otherwise(0).alias("up"))
            decided = decided.unionByName(last)
            break
        open_ = left.select("source", "r.open.id", "r.open.size", "r.open.mass", "r.open.tie", "docs")
        level += 1
    ups = decided.groupBy(F.col("source").alias("s"), F.col("id").alias("i")).agg(F.sum("up").cast("long").alias("ups"))
    # the first so many of equal rows: by where they lie, and then within
    places = joined.groupBy("source", "id", "part_id").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("source", "id").orderBy("part_id").rowsBetween(W.unboundedPreceding, -1))
    places = places.select(F.col("source").alias("ps"), F.col("id").alias("pi"), F.col("part_id").alias("pp"), F.coalesce(before, F.lit(0)).alias("before"))
    own = joined.withColumn("nth", F.row_number().over(W.partitionBy("source", "id", "part_id").orderBy("doc_id")))
    own = own.join(places, own["source"].eqNullSafe(places["ps"]) & (own["id"] == places["pi"]) & (own["part_id"] == places["pp"]))
    result = own.join(ups, own["source"].eqNullSafe(ups["s"]) & (own["id"] == ups["i"]), "left")
    up = (F.col("before") + F.col("nth") <= F.col("ups")).cast("int")
    copies = F.col("base") + F.coalesce(up, F.lit(0))
    return result.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "source")
