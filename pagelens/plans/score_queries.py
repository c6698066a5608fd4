"""Catalogue queries over vectors and label scores. Scores come from the tables by fixed formulas, so that SQL can follow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pagelens.operators import decide, models, vectorize
from pagelens.plans.catalog import query
from pagelens.plans.url_queries import read

GRID = [i / 100 for i in range(5, 100, 5)]
CLASSES = ["good", "toxic"]
SCORES = """SELECT doc_id, 'good' AS label, ((doc_id * 37 + 11 * quality * 40) % 101) / 101.0::DOUBLE AS score, quality AS y FROM labels
UNION ALL SELECT doc_id, 'toxic', ((doc_id * 53 + 7 * toxic * 30) % 97) / 97.0::DOUBLE, toxic FROM labels"""
F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END"
PRED = f"SELECT *, CASE WHEN score >= 0.5 THEN 1 WHEN max(score) OVER (PARTITION BY doc_id) < 0.5 AND row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1 THEN 1 ELSE 0 END AS pred FROM ({SCORES})"
COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def scores(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    good = labels.select("doc_id", F.lit("good").alias("label"), ((F.col("doc_id") * 37 + F.lit(440) * F.col("quality")) % 101 / F.lit(101.0)).alias("score"), F.col("quality").alias("y"))
    toxic = labels.select("doc_id", F.lit("toxic").alias("label"), ((F.col("doc_id") * 53 + F.lit(210) * F.col("toxic")) % 97 / F.lit(97.0)).alias("score"), F.col("toxic").alias("y"))
    return good.unionByName(toxic)


def predictions(spark, sf_dir):
    thr = spark.createDataFrame([(c, 0.5) for c in CLASSES], "label string, thr double")
    return decide.decoded(scores(spark, sf_dir), thr, "doc_id")


@query("threshold_sweep", f"WITH s AS ({SCORES}), t AS (SELECT label, g / 100.0::DOUBLE AS thr, count(*) FILTER (score >= g / 100.0::DOUBLE AND y = 1) AS tp, count(*) FILTER (score >= g / 100.0::DOUBLE AND y = 0) AS fp, count(*) FILTER (score < g / 100.0::DOUBLE AND y = 1) AS fn FROM s, (SELECT unnest(range(5, 100, 5)) AS g) GROUP BY label, g) SELECT label, thr, tp, fp, fn, round({F1}, 6) AS f1 FROM t")
def threshold_sweep(spark, sf_dir):
    return decide.sweep(scores(spark, sf_dir), GRID).withColumn("f1", F.round("f1", 6))


@query("threshold_best", f"WITH s AS ({SCORES}), t AS (SELECT label, g / 100.0::DOUBLE AS thr, count(*) FILTER (score >= g / 100.0::DOUBLE AND y = 1) AS tp, count(*) FILTER (score >= g / 100.0::DOUBLE AND y = 0) AS fp, count(*) FILTER (score < g / 100.0::DOUBLE AND y = 1) AS fn FROM s, (SELECT unnest(range(5, 100, 5)) AS g) GROUP BY label, g), f AS (SELECT label, thr, {F1} AS f1 FROM t) SELECT label, CASE WHEN max(f1) > 0 THEN first(thr ORDER BY f1 DESC, thr) ELSE 0.5 END AS thr FROM f GROUP BY label")
def threshold_best(spark, sf_dir):
    return decide.best_thresholds(decide.sweep(scores(spark, sf_dir), GRID))


@query("threshold_decode", f"SELECT doc_id, label, pred FROM ({PRED})")
def threshold_decode(spark, sf_dir):
    return predictions(spark, sf_dir).select("doc_id", "label", "pred")


@query("multilabel_metrics", f"WITH p AS ({PRED}), m AS (SELECT label, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1) AS n FROM p GROUP BY label) SELECT label, tp, fp, fn, n, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round({F1}, 6) AS f1 FROM m")
def multilabel_metrics(spark, sf_dir):
    out = decide.label_metrics(predictions(spark, sf_dir))
    return out.select("label", "tp", "fp", "fn", "n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("overall_metrics", f"""
WITH p AS ({PRED}), m AS (SELECT label, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1) AS n FROM p GROUP BY label),
a AS (SELECT 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro_f1, avg({F1}) AS macro_f1, sum(({F1}) * n) / sum(n) AS weighted_f1 FROM m),
d AS (SELECT doc_id, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) AS k FROM p GROUP BY doc_id),
b AS (SELECT avg({F1}) AS samples_f1, avg(CASE WHEN fp + fn = 0 THEN 1.0 ELSE 0.0 END) AS exact, sum(fp + fn) / sum(k) AS hamming, avg(CASE WHEN tp + fp = 0 THEN 1.0 ELSE 0.0 END) AS empty FROM d)
SELECT round(micro_f1, 6) AS micro_f1, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1, round(samples_f1, 6) AS samples_f1, round(exact, 6) AS exact, round(hamming, 6) AS hamming, round(empty, 6) AS empty FROM a, b""")
def overall_metrics(spark, sf_dir):
    out = decide.overall_metrics(predictions(spark, sf_dir), "doc_id")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("label_auc", f"WITH s AS ({SCORES}), r AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0 AS r FROM s), a AS (SELECT label, sum(r) FILTER (y = 1) AS r, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM r GROUP BY label) SELECT label, round((r - p * (p + 1) / 2) / (p * q), 6) AS auc FROM a WHERE p > 0 AND q > 0")
def label_auc(spark, sf_dir):
    return decide.auc(scores(spark, sf_dir)).select("label", F.round("auc", 6).alias("auc"))


@query("confusion_pivot", "SELECT quality, count(*) FILTER (toxic = 0) AS \"0\", count(*) FILTER (toxic = 1) AS \"1\" FROM labels GROUP BY quality")
def confusion_pivot(spark, sf_dir):
    return decide.confusion(read(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])


@query("missed_predicted_matrix", f"WITH p AS ({PRED}) SELECT a.label AS \"true\", b.label AS predicted, count(*) AS n FROM p a JOIN p b ON a.doc_id = b.doc_id WHERE a.y = 1 AND a.pred = 0 AND b.pred = 1 GROUP BY ALL")
def missed_predicted_matrix(spark, sf_dir):
    return decide.missed(predictions(spark, sf_dir), "doc_id")


@query("doc_z_scores", f"WITH s AS ({SCORES}), w AS (SELECT doc_id, label, score, avg(score) OVER (PARTITION BY doc_id) AS m, stddev_pop(score) OVER (PARTITION BY doc_id) AS d FROM s) SELECT doc_id, label, round((score - m) / CASE WHEN d < 1e-9 THEN 1 ELSE d END, 6) AS score FROM w")
def doc_z_scores(spark, sf_dir):
    return decide.row_z(scores(spark, sf_dir), "doc_id").select("doc_id", "label", F.round("score", 6).alias("score"))


@query("topk_labels_per_doc", f"SELECT doc_id, label, rank FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rank FROM ({SCORES})) WHERE rank <= 1")
def topk_labels_per_doc(spark, sf_dir):
    return decide.top_k(scores(spark, sf_dir), "doc_id", 1).select("doc_id", "label", F.col("rank").cast("long").alias("rank"))


@query("embedding_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def embedding_norms(spark, sf_dir):
    v = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(vectorize.dot(v, v)), 6).alias("norm"))


@query("embedding_label_centroids", "SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY label, pos")
def embedding_label_centroids(spark, sf_dir):
    return vectorize.mean_vectors(read(spark, sf_dir, "embeddings"), "label", "embedding").select("label", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@query("embedding_reference_cosine", f"""
SELECT a.label AS ref, b.vec_id, round({COSINE}, 6) AS cosine FROM (SELECT label, list(m ORDER BY pos) AS embedding FROM (SELECT label, pos, round(avg(x), 6) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label) a, embeddings b""")
def embedding_reference_cosine(spark, sf_dir):
    """Every vector against the centroid of every label: as many references as labels."""
    e = read(spark, sf_dir, "embeddings")
    means = vectorize.mean_vectors(e, "label", "embedding").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.round("mean", 6).alias("mean")))), lambda x: x["mean"]).alias("other"))
    refs = means.agg(F.collect_list(F.struct(F.col("label").alias("ref"), "other")).alias("refs"))
    wide = e.select("vec_id", "embedding").crossJoin(F.broadcast(refs)).select("vec_id", "embedding", F.explode("refs").alias("r"))
    return wide.select(F.col("r.ref").alias("ref"), "vec_id", F.round(vectorize.cosine(F.col("embedding"), F.col("r.other")), 6).alias("cosine"))


@query("ovr_fixed_scores", """
WITH l AS (SELECT unnest(range(0, 10)) AS l), x AS (SELECT vec_id, l, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * (((i - 1) * 7 + l * 3) % 11 - 5) / 10.0::DOUBLE)) + (l - 5) / 10.0::DOUBLE AS z FROM embeddings, l)
SELECT vec_id, l::VARCHAR AS label, CASE WHEN l = 9 THEN 0 ELSE round(1 / (1 + exp(-z)), 6) END AS score FROM x""")
def ovr_fixed_scores(spark, sf_dir):
    """Heads with given weights, the last of them without positive rows."""
    labels, dim = np.arange(10), np.arange(64)
    heads = models.Heads([str(c) for c in labels], ((dim * 7 + labels[:, None] * 3) % 11 - 5) / 10, (labels - 5) / 10, labels == 9)
    return models.head_scores(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", heads).withColumn("score", F.round("score", 6))


@query("best_labels_per_doc", f"""
WITH s AS ({SCORES}), g AS (SELECT *, score >= CASE label WHEN 'good' THEN 0.6 ELSE 0.4 END AND score >= 0.45 AS good FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY good DESC, score DESC, label) AS rank, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS best, bool_or(good) OVER (PARTITION BY doc_id) AS any_good FROM g)
SELECT doc_id, label, round(score, 4) AS score, CASE WHEN good THEN rank ELSE 1 END AS rank FROM r WHERE CASE WHEN any_good THEN good AND rank <= 2 ELSE best = 1 END""")
def best_labels_per_doc(spark, sf_dir):
    thr = spark.createDataFrame([("good", 0.6), ("toxic", 0.4)], "label string, thr double")
    return decide.best_labels(scores(spark, sf_dir), thr, "doc_id", 2, 0.45).withColumn("rank", F.col("rank").cast("long"))


@query("ovr_logreg_scores")
def ovr_logreg_scores(spark, sf_dir):
    return models.embedding_one_vs_rest(read(spark, sf_dir, "embeddings"))


@query("gbt_scores")
def gbt_scores(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    found = sorted(r["label"] for r in e.where("label is not null").select("label").distinct().collect())
    return models.embedding_one_vs_rest(e, kind="gbt", classes=found or range(10))


@query("svd_embedding_block")
def svd_embedding_block(spark, sf_dir):
    return models.svd_block(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


@query("lda_topics")
def lda_topics(spark, sf_dir):
    return models.lda_topics(read(spark, sf_dir, "documents").select("doc_id", "text"))
