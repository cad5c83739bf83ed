"""Queries of the corpus operators: each applies one to its whole table, with production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import warc
from .ann import search
from .exact_dedup import exact_copies, normalised
from .hard_negatives import mine
from .jaccard_join import jaccard_components
from .lm import score
from .mixing import mix
from .packing import pack, piece_digests
from .prefix_trie import prefix_trie
from .quality import assess
from .rans import read_ids, write_ids
from .shared import shared_dir, ship
from .substring_dedup import remove_repeats
from .surrogates import replace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


@_query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


@_query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(pack(_table(spark, sf_dir, "documents")))


@_query
def op8_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "op8")
    found = read_ids(spark, folder, write_ids(_table(spark, sf_dir, "documents"), folder))
    return found.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@_query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assess(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@_query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")

SURROGATE_KEY = "change this key and keep it secret"


@_query
def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(_table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY, count_col="n_findings")


@_query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(_table(spark, sf_dir, "pages"), shared_dir(spark, "op4"))
    # of archives just written, a gap is a lost page
    lost = F.raise_error(F.concat(F.lit("gap in "), "file", F.lit(": "), "reason"))
    found = warc.read(archives).withColumn("kind", F.when(F.col("kind") == "gap", lost.cast("string")).otherwise(F.col("kind")))
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


ORACLES["op4_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
     f AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f"""


@_query
def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "embeddings"))


@_query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_table(spark, sf_dir, "documents"))


@_query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    return exact_copies(docs, carry=["text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op13_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1 AS kept, h AS text_sha256
FROM t"""


@_query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, sf_dir, "embeddings").withColumn("label", label))


ORACLES["op11_hard_negatives"] = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, b.label = a.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND b.id <> a.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5"""


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def _crc32(text: str) -> str:
    """crc32 in SQL, bit by bit: DuckDB has none."""
    step = lambda c: f"CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
    byte = f"list_reduce(list_prepend(xor(acc, b), range(8)), lambda c, i: {step('c')})"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))), lambda acc, b: {byte}), 4294967295)"


ORACLES["op12_prefix_trie"] = f"""
WITH own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hs AS (SELECT *, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM own),
paths AS (SELECT a.conv_id, list_concat(coalesce(d.t, [])[:a.h], a.t[a.h + 1:]) AS p FROM hs a LEFT JOIN own d ON d.conv_id = a.conv_id - a.conv_id % 100),
steps AS (SELECT conv_id, CAST(unnest(range(0, len(p) + 1)) AS BIGINT) AS depth, p FROM paths),
nodes AS (SELECT p[:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(p) = depth), '')) AS ends_sha256
          FROM steps GROUP BY 1, 2),
kids AS (SELECT k[:depth - 1] AS k, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
own_nodes AS (SELECT n.*, coalesce(c.n, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * length(n.k[n.depth].text) ELSE 0 END AS saved
              FROM nodes n LEFT JOIN kids c ON c.k = n.k AND c.depth = n.depth),
up AS (SELECT unnest(range(0, depth + 1)) AS d, k, saved, (n_children = 0)::INT AS leaf FROM own_nodes),
totals AS (SELECT k[:d] AS k, d AS depth, sum(leaf) AS n_leaves, sum(saved) AS saved FROM up GROUP BY 1, 2)
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children,
       CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM own_nodes n JOIN totals t ON t.k = n.k AND t.depth = n.depth
LEFT JOIN nodes a ON a.depth = n.depth - 1 AND a.k = n.k[:n.depth - 1] AND n.depth > 0"""


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


ORACLES["op9_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, gram FROM (
        SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
          ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS gram FROM w)),
n AS (SELECT w.doc_id, count(g.gram) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY w.doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 75 * (p.n + q.n - i)),
r(doc_id, near) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.near)
SELECT n.doc_id, n.n AS n_shingles, min(near) AS component_id FROM n JOIN r USING (doc_id) GROUP BY 1, 2"""

ORACLES["op10_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i+34], ' ') AS win FROM w, unnest(range(1, len(ws) - 33)) AS t(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS c FROM s) WHERE c > 1),
d AS (SELECT DISTINCT doc_id, i + k AS pos FROM r, unnest(range(0, 35)) AS t(k)),
k AS (SELECT w.doc_id, p.pos, ws[p.pos] AS word, d.pos IS NOT NULL AS gone FROM w, unnest(range(1, len(ws) + 1)) AS p(pos) LEFT JOIN d ON d.doc_id = w.doc_id AND d.pos = p.pos)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(count(k.pos) FILTER (gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY k.pos) FILTER (NOT gone), '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) GROUP BY w.doc_id, ws"""
