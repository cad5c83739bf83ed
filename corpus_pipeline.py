"""A training-corpus pipeline over the documents table, each stage one operator.

Quality rules drop bad documents, one document of each group of near copies stays, personal data becomes surrogates,
sources are mixed to their targets (a document's copies follow each other as rows of its own), and the rest is packed
into sequences of token ids. Stages before the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calathea.llm.jaccard_join import jaccard_components
from calathea.llm.mixing import mix, size_of
from calathea.llm.packing import pack, piece_digests
from calathea.llm.quality import keep_good
from calathea.llm.shared import cut, fresh, shared_dir, ship
from calathea.llm.surrogates import replace
from calathea.operators.ranges import running

KEY = "change this key and keep it secret"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and whose posterior of being good is high enough."""
    return keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies; documents without words stay, and so do
    rows without an id. Of rows with equal ids in a component of others, all go; in their own, all stay."""
    found = jaccard_components(docs)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(cut(gone, "gone"), "doc_id", "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; n_chars follows the text."""
    out = replace(docs, KEY)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents of size 0 go, as they bring no words. Rows are told apart
    by id, source and size, nulls too; those equal in all three share their decisions out among them."""
    names = [fresh(docs.columns, f"mix_{k}") for k in range(5)]
    # parts of a key without nulls: the numbering and the join then deal the rows once
    keys = lambda size: [x.alias(n) for x, n in zip((F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.isnull(F.col("doc_id").cast("long")), F.coalesce(F.col("source").cast("string"), F.lit("")), F.isnull("source"), size), names, strict=True)]
    # of equal rows, some take one copy more than the others
    most, many, least = (fresh(docs.columns, f"mix_{x}") for x in ("most", "many", "least"))
    mixed = mix(docs).where("size > 0").select(*keys(F.col("size")), "copies")
    mixed = mixed.groupBy(*names).agg(F.max("copies").alias(most), F.min("copies").alias(least), F.sum("copies").alias(many), F.count("*").alias("n"))
    more = F.when(F.col(most) > F.col(least), F.col(many) - F.col(least) * F.col("n")).otherwise(F.col("n"))
    nth, row, of = (fresh(docs.columns, f"mix_{x}") for x in ("nth", "row", "of"))
    taken = cut(mixed.where(F.col(most) > 0).select(*names, most, least, more.alias(many), F.col("n").alias(of)), "taken")
    rows = docs.select("*", *keys(size_of(F.col("text").cast("string"))))
    if taken.where(F.col(of) > 1).isEmpty():
        rows = rows.withColumn(nth, F.lit(1))
    else:  # rows alike are numbered by ranges, however many there are
        rows = rows.withColumn(row, F.monotonically_increasing_id())
        rows = running(rows, names, [F.xxhash64(*docs.columns), F.col(row)], nth, fresh(rows.columns, "mix_total"))
    taken = taken.drop(of)
    # always the same join: the table of copies grows with the documents
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col(nth) <= F.col(many), F.col(most)).otherwise(F.col(least)).cast("int")))
    return rows.join(taken.hint("merge"), names).withColumn(nth, copies).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of up to 2048 ids."""
    return piece_digests(pack(docs))


STAGES = [("quality rules", quality), ("near copies", near_copies), ("personal data", personal_data), ("mixing", mixture), ("packing", packing)]

#: Fitted rules, keyed draws and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
