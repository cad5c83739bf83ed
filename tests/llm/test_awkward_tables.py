"""Every operator on tables with columns named like its own, with nulls everywhere, and on tables of nulls alone."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from calathea.llm import exact_dedup, hard_negatives, jaccard_join, lm, mixing, packing, prefix_trie, quality, rans, substring_dedup, surrogates, warc
from calathea.llm.shared import shared_dir

#: Names that the operators use for columns of their own.
NAMES = """key n sig block blob s1 s2 rep label component_id ids start length held_out base score tie part mass docs id copies taken target
wish ups before part_id nth f posterior kept is_open sequence_id offset runs members ranks grams surrogate_marked surrogate_new
quality_features mix_0 mix_nth mix_many chunk rows grp unit path words count""".split()


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("doc_id", "text", "source", *(F.when(F.col("doc_id") % 2 == 0, F.lit(k)).alias(x) for k, x in enumerate(NAMES)))


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(None, None, None)] * 3, "doc_id long, text string, source string")


def packed(df, tmp):
    return packing.piece_digests(packing.pack(df)).select("doc_id", "start").where("start = 0")


def coded(df, tmp):
    folder = shared_dir(df.sparkSession, "t")
    return rans.read_ids(df.sparkSession, folder, rans.write_ids(df, folder))


OPERATORS = {
    "packing": packed, "surrogates": lambda df, tmp: surrogates.replace(df, "k"), "lm": lambda df, tmp: lm.score(df), "quality": lambda df, tmp: quality.assess(df),
    "mixing": lambda df, tmp: mixing.mix(df), "rans": coded, "jaccard": lambda df, tmp: jaccard_join.jaccard_components(df), "repeats": lambda df, tmp: substring_dedup.remove_repeats(df),
    "near copies": lambda df, tmp: P.near_copies(df.sparkSession, df, tmp), "mixture": lambda df, tmp: P.mixture(df.sparkSession, df, tmp), "quality stage": lambda df, tmp: P.quality(df.sparkSession, df, tmp),
    "exact copies": lambda df, tmp: exact_dedup.exact_copies(df, carry=[]), "personal data stage": lambda df, tmp: P.personal_data(df.sparkSession, df, tmp),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_of_the_same_names(wide, docs, name, tmp_path):
    run = OPERATORS[name]
    few = docs.select("doc_id", "text", "source")
    got, want = (run(df, str(tmp_path)) for df in (wide, few))
    shared = [c for c in want.columns if c not in ("sequence_id", "offset")]
    plain = lambda df: sorted(map(repr, df.select(shared).collect()))
    assert plain(got) == plain(want)
    if "stage" in name or name in ("near copies", "mixture", "surrogates"):
        assert got.columns == wide.columns


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_nothing_but_nulls(nulls, name, tmp_path):
    n = OPERATORS[name](nulls, str(tmp_path)).count()
    assert n == (0 if name in ("quality stage", "mixture") else 3)


def test_conversations_and_vectors(spark):
    """Columns named like the operators' own, and rows of nulls alone."""
    rows = [(k % 7, k, "u", f"t{k % 3}") for k in range(40)]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wide = plain.select("*", *(F.lit(k).alias(x) for k, x in enumerate(("path", "lens", "sig", "k", "rep", "key", "crowded", "bucket", "depth", "above"))))
    assert sorted(map(repr, prefix_trie.prefix_trie(wide).collect())) == sorted(map(repr, prefix_trie.prefix_trie(plain).collect()))
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, None, None, None)] * 3, plain.schema)).count() == 0
    vectors = spark.createDataFrame([(k * 20, [float(k % 5), float(k % 3)], k % 2) for k in range(40)], "vec_id long, embedding array<float>, label int")
    wide = vectors.select("*", *(F.lit(k).alias(x) for k, x in enumerate(("row", "id", "size", "vec", "leaf", "shard", "share", "low", "high", "mark", "rank"))))
    assert sorted(map(repr, hard_negatives.mine(wide).collect())) == sorted(map(repr, hard_negatives.mine(vectors).collect()))
    assert hard_negatives.mine(spark.createDataFrame([(None, None, None)] * 3, vectors.schema)).count() == 0


def test_pages(spark, tmp_path):
    rows = [(k, None if k % 3 == 0 else f"http://x/{k}", None if k % 4 == 0 else "p" * (k * 300)) for k in range(12)] + [(None, "http://y", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    wide = pages.select("*", *(F.lit(1).alias(x) for x in ("digest", "kind", "payload", "first", "part", "refers_to", "payload_bytes")))
    found = [sorted(map(repr, warc.read(warc.write(df, shared_dir(spark, "w"))).select("page_id", "payload_bytes", "payload_digest", "kind", "refers_to").collect())) for df in (pages, wide)]
    assert found[0] == found[1] and len(found[0]) == 13
