"""Queries over vectors and scores: search, clusters, assignment, agreement statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluation, greedy, neighbours, training, vectors, windows
from ..registry import Tables, query

_DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_SCORED_SQL = """WITH s AS (SELECT d.doc_id, quality AS truth, CASE WHEN (d.n_chars * 37 + d.doc_id) % 100 < 30 THEN 0 ELSE 1 END AS guess, ((d.n_chars * 37 + d.doc_id) % 100) / 100.0 AS score,
(d.doc_id * 53 % 97) / 97.0 AS other FROM labels l JOIN documents d USING (doc_id))
"""


def _scored(t: Tables) -> DataFrame:
    mixed = (F.col("n_chars") * 37 + F.col("doc_id")) % 100
    rows = t.labels.join(t.documents, "doc_id")
    return rows.select("doc_id", F.col("quality").alias("truth"), F.when(mixed < 30, 0).otherwise(1).alias("guess"), (mixed / 100.0).alias("score"), (F.col("doc_id") * 53 % 97 / 97.0).alias("other"))


@query(f"""SELECT query, id, round(s, 9) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT q.vec_id AS query, v.vec_id AS id, {_DOT.format(a='q.embedding', b='v.embedding')} AS s,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT.format(a='q.embedding', b='v.embedding')} DESC, v.vec_id) AS r FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) WHERE r <= 10""")
def knn_topk(t: Tables) -> DataFrame:
    few = t.embeddings.where("vec_id % 20 = 0").select("vec_id", "embedding")
    return vectors.search(t.embeddings, "vec_id", "embedding", few, 10).select("query", "id", F.round("score", 9).alias("score"), "rank")


@query(f"""WITH a AS (SELECT * FROM embeddings WHERE vec_id < 40), c AS (SELECT a.label, v.vec_id, max({_DOT.format(a='a.embedding', b='v.embedding')}) AS s FROM embeddings v, a WHERE v.vec_id >= 40 GROUP BY 1, 2)
SELECT label, vec_id, round(s, 9) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM c) WHERE r <= 5""")
def anchor_suggestions(t: Tables) -> DataFrame:
    anchors = t.embeddings.where("vec_id < 40")
    found = vectors.best_anchor(t.embeddings, "vec_id", "embedding", anchors, "vec_id", "label", 5, anchors.select("vec_id"))
    return found.select("label", "vec_id", F.round("score", 9).alias("score"), "rank")


_CENTRES = """WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM u),
m AS (SELECT label, i, avg(e[i]) AS x FROM n, unnest(range(1, 65)) AS r(i) GROUP BY 1, 2), c0 AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1),
c AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM c0),
s AS (SELECT vec_id, c.label, list_dot_product(u.e, c.c) AS score FROM u, c), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM s)
"""


@query(_CENTRES + "SELECT vec_id, label, round(score, 9) AS score, score >= 0.6 AS sure FROM b WHERE r = 1")
def centroid_assign(t: Tables) -> DataFrame:
    centres = vectors.centroids(t.embeddings, "label", "embedding")
    found = vectors.assign(t.embeddings, "vec_id", "embedding", centres, "label")
    return found.select("vec_id", "label", F.round("score", 9).alias("score"), (F.col("score") >= 0.6).alias("sure"))


@query(_CENTRES + "SELECT vec_id, label FROM b WHERE r = 1 AND label IN (1, 3, 5) AND score > 0")
def zero_shot_argmax(t: Tables) -> DataFrame:
    centres = vectors.centroids(t.embeddings, "label", "embedding")
    return vectors.assign(t.embeddings, "vec_id", "embedding", centres, "label").where("label in (1, 3, 5) and score > 0").select("vec_id", "label")


_EDGES = f"""WITH RECURSIVE e AS (SELECT query, id FROM (SELECT q.vec_id AS query, v.vec_id AS id, {_DOT.format(a='q.embedding', b='v.embedding')} AS s,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT.format(a='q.embedding', b='v.embedding')} DESC, v.vec_id) AS r FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id) WHERE r <= 5 AND s >= 0.3),
u AS (SELECT query AS x, id AS y FROM e UNION SELECT id, query FROM e), w(x, y) AS (SELECT x, x FROM u UNION SELECT w.x, u.y FROM w JOIN u ON u.x = w.y)
"""


@query(_EDGES + "SELECT x AS node, min(y) AS component FROM w GROUP BY x")
def knn_components(t: Tables) -> DataFrame:
    return vectors.components(vectors.neighbour_edges(t.embeddings, "vec_id", "embedding", 5, 0.3), "query", "id")


@query(_EDGES.replace("WITH RECURSIVE", "WITH").split(",\nu AS")[0] + " SELECT query, id FROM e")
def knn_edges(t: Tables) -> DataFrame:
    return vectors.neighbour_edges(t.embeddings, "vec_id", "embedding", 5, 0.3).select("query", "id")


@query()
def knn_edges_lsh(t: Tables) -> DataFrame:
    """The edges of knn_edges by an index: at least 0.95 of them, calibrated for 0.97."""
    return neighbours.edges(t.embeddings, "vec_id", "embedding", 5, 0.3, bucket=256).select("query", "id", F.round("score", 9).alias("score"), "rank")


@query()
def knn_topk_lsh(t: Tables) -> DataFrame:
    """The ten nearest of every twentieth vector by the index, itself among them."""
    few = t.embeddings.where("vec_id % 20 = 0").select("vec_id", "embedding")
    return neighbours.search(t.embeddings, "vec_id", "embedding", few, 10, bucket=256).select("query", "id", F.round("score", 9).alias("score"), "rank")


@query("""WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT label, vec_id FROM r WHERE n <= 6 OR i IN (SELECT (k * (n - 1)) // 5 FROM range(0, 6) AS s(k))""")
def cluster_spread_sample(t: Tables) -> DataFrame:
    return windows.even_sample(t.embeddings.select("label", "vec_id"), ["label"], [F.col("vec_id")], 6)


@query(_CENTRES + "SELECT label, count(*) AS n, round(avg(score), 9) AS mean, round(max(score), 9) AS tightest, round(min(score), 9) AS loosest FROM s JOIN embeddings e USING (vec_id) WHERE s.label = e.label GROUP BY label".replace("SELECT label,", "SELECT s.label,").replace("GROUP BY label", "GROUP BY s.label"))
def cluster_cohesion(t: Tables) -> DataFrame:
    centres = vectors.centroids(t.embeddings, "label", "embedding").select("label", "centroid")
    scored = t.embeddings.join(centres, "label").withColumn("s", S.dot(F.col("embedding"), F.col("centroid")))
    return scored.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("s"), 9).alias("mean"), F.round(F.max("s"), 9).alias("tightest"), F.round(F.min("s"), 9).alias("loosest"))


@query(_SCORED_SQL + "SELECT truth, guess AS predicted, count(*) AS n FROM s GROUP BY 1, 2")
def eval_confusion(t: Tables) -> DataFrame:
    return evaluation.confusion(_scored(t), F.col("truth"), F.col("guess"))


@query(_SCORED_SQL + """SELECT count(*) AS n, round(avg((truth = guess)::INT), 6) AS accuracy, round(count(*) FILTER (truth = 1 AND guess = 1) / count(*) FILTER (guess = 1)::DOUBLE, 6) AS precision,
round(count(*) FILTER (truth = 1 AND guess = 1) / count(*) FILTER (truth = 1)::DOUBLE, 6) AS recall FROM s""")
def eval_class_scores(t: Tables) -> DataFrame:
    return evaluation.class_scores(_scored(t), F.col("truth"), F.col("guess"), 1)


@query(_SCORED_SQL + "SELECT count(*) AS n, round(avg(abs(score - truth)), 6) AS mae, round(sqrt(avg((score - truth) * (score - truth))), 6) AS rmse FROM s")
def eval_errors(t: Tables) -> DataFrame:
    return evaluation.errors(_scored(t), "truth", "score")


@query(_SCORED_SQL + "SELECT CAST(least(greatest(floor(score * 10), 0), 9) AS INTEGER) AS decile, count(*) AS n, round(avg(score), 6) AS mean_predicted, round(avg(truth), 6) AS mean_truth FROM s GROUP BY 1")
def calibration(t: Tables) -> DataFrame:
    return evaluation.reliability(_scored(t), "truth", "score")


@query(_SCORED_SQL + """, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ra, rank() OVER (ORDER BY other) + (count(*) OVER (PARTITION BY other) - 1) / 2.0 AS rb FROM s)
SELECT count(*) AS n, round(corr(score, other), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r""")
def spearman(t: Tables) -> DataFrame:
    return evaluation.spearman(_scored(t), "score", "other")


@query(_SCORED_SQL + """SELECT 50 AS k, count(*) AS common, round(count(*) / 50.0, 6)::DOUBLE AS recall FROM (SELECT doc_id FROM s ORDER BY score DESC, doc_id LIMIT 50) a JOIN (SELECT doc_id FROM s ORDER BY other DESC, doc_id LIMIT 50) b USING (doc_id)""")
def topk_recall(t: Tables) -> DataFrame:
    return evaluation.topk_recall(_scored(t), "doc_id", "score", "other", 50)


@query(_SCORED_SQL + """, c AS (SELECT count(*) FILTER (score <> other)::DOUBLE AS n, count(*) FILTER (score > other)::DOUBLE AS a FROM s), p AS (SELECT n, a, a / n AS p FROM c)
SELECT CAST(n AS BIGINT) AS n, CAST(a AS BIGINT) AS agree, round(p, 6) AS rate, round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS low,
round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS high FROM p""")
def wilson_agreement(t: Tables) -> DataFrame:
    return evaluation.agreement(_scored(t), "score", "other")


@query(_SCORED_SQL + """, r AS (SELECT doc_id, truth, row_number() OVER (PARTITION BY truth ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY truth) AS n FROM s)
SELECT doc_id, CASE WHEN i <= round_even(n * 0.8, 0) THEN 'train' WHEN i <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'test' END AS part FROM r""")
def stratified_split(t: Tables) -> DataFrame:
    return evaluation.stratified_split(_scored(t), "truth", [F.col("doc_id")]).select("doc_id", "part")


@query(_SCORED_SQL + """, b AS (SELECT doc_id, CAST(least(floor(score * 10), 9) AS INTEGER) AS d FROM s), w AS (SELECT doc_id, 1 / sqrt(count(*) OVER (PARTITION BY d)) AS w FROM b)
SELECT doc_id, round(least(greatest(w / avg(w) OVER (), 0.3), 6.0), 9) AS weight FROM w""")
def balance_weights(t: Tables) -> DataFrame:
    rows = _scored(t).withColumn("d", S.decile(F.col("score")))
    return evaluation.balance_weights(rows, "d").select("doc_id", F.round("weight", 9).alias("weight"))


@query("""SELECT min(n_chars) AS low, max(n_chars) AS high, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS deviation, median(n_chars)::DOUBLE AS median, count(*) FILTER (n_chars >= 1000) AS at_least_0, count(*) FILTER (n_chars >= 10000) AS at_least_1 FROM documents""")
def moments(t: Tables) -> DataFrame:
    return evaluation.moments(t.documents, "n_chars", [1000, 10000])


@query(_SCORED_SQL + "SELECT CAST(least(floor((score - 0) / 1 * 10), 9) AS INTEGER) AS part, count(*) AS n FROM s WHERE score BETWEEN 0 AND 1 GROUP BY 1")
def histogram(t: Tables) -> DataFrame:
    return evaluation.histogram(_scored(t), "score", 0, 1, 10)


@query(_SCORED_SQL + """SELECT doc_id, CASE WHEN score >= 0.6 THEN 'good' WHEN score <= 0.25 THEN 'bad' ELSE 'mid' END AS badge, round(1 / (1 + exp((other - score) / 0.05)), 9) AS share FROM s""")
def badges(t: Tables) -> DataFrame:
    return _scored(t).select("doc_id", S.badge(F.col("score")).alias("badge"), F.round(S.softmax2(F.col("score"), F.col("other")), 9).alias("share"))


@query(_SCORED_SQL + """, x AS (SELECT doc_id AS x, other, row_number() OVER (ORDER BY other, doc_id) AS n FROM s WHERE score >= 0.7), y AS (SELECT doc_id AS y, other, row_number() OVER (ORDER BY other DESC, doc_id) AS n FROM s WHERE score <= 0.2)
SELECT x, y FROM x JOIN y USING (n) WHERE n <= 100 AND y.other - x.other > 0.03""")
def pair_mining(t: Tables) -> DataFrame:
    """Pairs that two scores order in opposite ways: a top list of 100."""
    return greedy.opposed_pairs(_scored(t), "doc_id", "score", "other", 0.7, 0.2, 0.03, 100)


@query("""WITH o AS (SELECT vec_id, label AS name, label % 2 = 0 AS claimed FROM embeddings), c AS (SELECT vec_id, 10 * label + vec_id % 2 AS cluster FROM embeddings),
s AS (SELECT cluster, name, count(*) AS shared FROM c JOIN o USING (vec_id) GROUP BY 1, 2), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY shared DESC, cluster DESC) AS r FROM s) WHERE r = 1),
f AS (SELECT cluster, (SELECT max(name) FROM o) + row_number() OVER (ORDER BY cluster) AS name, 0 AS shared FROM (SELECT DISTINCT cluster FROM c WHERE cluster NOT IN (SELECT cluster FROM k)))
SELECT cluster, name, shared, CASE WHEN shared > 0 THEN name % 2 = 0 END AS claimed FROM (SELECT cluster, name, shared FROM k UNION ALL SELECT cluster, name, shared FROM f)""")
def stable_clusters(t: Tables) -> DataFrame:
    """Names of a second generation of clusters; each of its clusters overlaps one of the first, so SQL can say it."""
    v, label = F.col("vec_id"), F.col("label").cast("long")
    old = t.embeddings.select("vec_id", label.alias("name"), (label % 2 == 0).alias("claimed"))
    new = t.embeddings.select("vec_id", (10 * label + v % 2).alias("cluster"))
    return greedy.stable_names(new, old, "vec_id", "cluster", "name", ["claimed"])


@query()
def huber_head(t: Tables) -> DataFrame:
    """A linear head for the label of the vectors, balanced by label, stopped by rank agreement on a tenth of them."""
    rows = training.weighted_split(t.embeddings, "label", "vec_id")
    found = training.fit(rows, "embedding", "label", "weight", "part", delta=1.0, rounds=8, patience=3)
    out = training.coefficient_rows(t.spark, found) if found else t.spark.createDataFrame([], "name string, value double")
    return out.select("name", F.round("value", 6).alias("value"))
