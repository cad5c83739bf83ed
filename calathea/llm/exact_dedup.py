"""Exact copies of texts by progressive refinement: by length, then by a hash of the beginning, then by a full hash.

Texts are equal when they are identical after replacing each run of [\\x20\\x09-\\x0D] by one space. A first scan keeps a
length and a hash of the first HEAD characters of each row. Lengths that occur once are done; of the others, beginnings
that occur once are done. A second scan hashes whole texts of surviving groups alone. Survivors are told by bitmaps of at
most 2 ** BITS bits, broadcast so that no row is shuffled for it; their chance hits only cost a hash. Then the rows, without
their texts, meet their group's count and smallest row: groups are aggregated first, so one that holds most rows is a
row, and the largest groups (fewer than HOT can be so large) come to their members, not these to one task.

Defined results: null texts count as empty; null ids come after all others, so keep_id is null only where all are;
of rows with equal texts and equal smallest ids exactly one is kept; an empty table gives none. Very long texts are
hashed as they are. Columns of any name may be carried along, null or not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import column, cut, fresh

HEAD, BITS, HOT = 64, 26, 1_024


def normalised(text: Column) -> Column:
    """The text with one space for each run of white space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _shape(text: Column) -> list[Column]:
    return [F.char_length(text).alias("len"), F.xxhash64(F.substring(text, 1, HEAD)).alias("head")]


def marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows with a column `open`: whether their values of the keys' columns may be among the keys."""
    place = F.pmod(F.xxhash64(*keys.columns), F.lit(1 << BITS)) + 1
    bucket, at = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = keys.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(at).alias("bits"))
    rows = rows.withColumn("bucket", bucket).join(F.broadcast(maps), "bucket", "left")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("open", F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0, F.lit(False)))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """The rows with keep_id, group_size and kept; `carry` names the columns that go along (all, if not given)."""
    carry = [c for c in (docs.columns if carry is None else carry) if c != id_col]
    shapes = cut(docs.select(normalised(column(docs, text_col)).alias("text")).select(*_shape(F.col("text"))), "shapes")
    lengths = shapes.groupBy("len").count().where("count > 1").select("len")
    # a hot length is never gathered: lengths are told by their bitmap, too
    heads = marked(shapes, lengths).where("open").groupBy("len", "head").count().where("count > 1").select("len", "head")

    rows = docs.select(column(docs, id_col).alias("id"), F.struct(*(column(docs, c).alias(f"c{n}") for n, c in enumerate(carry)), F.lit(0)).alias("own"), normalised(column(docs, text_col)).alias("text"))
    rows = marked(rows.select("*", *_shape(F.col("text"))), heads)
    full = F.when(F.col("open"), F.unhex(F.sha2("text", 256)))
    # a number for each row, lasting as soon as it is written
    rows = cut(rows.select("id", "own", full.alias("full"), F.monotonically_increasing_id().alias("row")), "hashed")
    some = rows.where("full is not null")
    least = F.min(F.struct(F.isnull("id").alias("no_id"), "id", "row")).alias("least")
    groups = some.groupBy("full").agg(F.count("*").alias("group_size"), least).where("group_size > 1")
    groups = cut(groups.select("full", "group_size", F.col("least.id").alias("keep_id"), F.col("least.row").alias("first")), "groups")
    # fewer than HOT groups can hold a part in HOT of the rows each: those are broadcast, and their members stay where they are
    members = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = groups.where(F.col("group_size") > members / HOT).select("full", *(F.col(c).alias(f"hot_{c}") for c in ("group_size", "keep_id", "first")))
    some = some.join(F.broadcast(hot), "full", "left")
    at_hand = some.where("hot_group_size is not null").select("id", "own", "row", *(F.col(f"hot_{c}").alias(c) for c in ("group_size", "keep_id", "first")))
    met = some.where("hot_group_size is null").select("id", "own", "row", "full").join(groups.hint("merge"), "full", "left").drop("full")
    found = at_hand.unionByName(met).select("id", "own", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.coalesce(F.col("row") == F.col("first"), F.lit(True)).alias("kept"))
    alone = rows.where("full is null").select("id", "own", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    names = [id_col, *carry]
    added = [fresh(names, c) for c in ("keep_id", "group_size", "kept")]
    out = found.unionByName(alone)
    return out.select(F.col("id").alias(id_col), *(F.col(f"own.c{n}").alias(c) for n, c in enumerate(carry)), *(F.col(c).alias(a) for c, a in zip(("keep_id", "group_size", "kept"), added, strict=True)))
