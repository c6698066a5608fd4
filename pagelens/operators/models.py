"""Classifiers and decompositions: dense one-vs-rest heads and SVD by sums over Arrow batches, the rest on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import LDA
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, StringIndexer, UnivariateFeatureSelector
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import text
from pagelens.operators import vectorize


def balanced(df: DataFrame, y: str) -> DataFrame:
    """``df`` with ``weight``, so that both classes weigh the same."""
    counts = df.agg(F.count("*").alias("n_"), F.sum(y).alias("p_"))
    share = F.when(F.col(y) == 1, F.col("n_") / (2 * F.greatest(F.col("p_"), F.lit(1)))).otherwise(F.col("n_") / (2 * F.greatest(F.col("n_") - F.col("p_"), F.lit(1))))
    return df.crossJoin(F.broadcast(counts)).withColumn("weight", share).drop("n_", "p_")


def classifier(kind: str, c: float = 4.0, trees: int = 20, depth: int = 5):
    if kind == "gbt":
        return GBTClassifier(featuresCol="features", labelCol="y", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.85, seed=0)
    return LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", regParam=1.0 / (c * 1000), standardization=False, maxIter=50)


def one_vs_rest(df: DataFrame, key: str, features: str, is_label: dict[str, Column], kind: str = "logreg", fit_on: DataFrame | None = None) -> DataFrame:
    """``key, label, score`` of every row and label; a label without positive rows scores 0.

    One model for each label, as labels need not exclude each other.
    """
    out = None
    for label, y in is_label.items():
        rows = (df if fit_on is None else fit_on).select(key, F.col(features).alias("features"), y.cast("double").alias("y"))
        positive = rows.agg(F.sum("y")).first()[0] or 0
        if positive:
            model = classifier(kind).fit(balanced(rows, "y"))
            scored = model.transform(df.select(key, F.col(features).alias("features"))).select(key, F.lit(label).alias("label"), F.element_at(vector_to_array("probability"), 2).alias("score"))
        else:
            scored = df.select(key, F.lit(label).alias("label"), F.lit(0.0).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


#: Length of vectors up to which heads are fitted together by Newton steps, whose matrices have its square.
NEWTON_DIM = 1024


@dataclass
class Heads:
    """One logistic regression a label over dense vectors: weights (labels x dim) and intercepts; labels without positive rows score 0."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    empty: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(x @ self.weights.T + self.bias, -500, 500)))
        p[:, self.empty] = 0.0
        return p


def fit_heads(df: DataFrame, vector: str, y: dict[str, Column], c: float = 4.0, steps: int = 25, tolerance: float = 1e-8) -> Heads:
    """All labels' regressions at once: balanced classes, an L2 penalty of weight 1 / ``c`` that spares no weight, by Newton steps.

    Each step is one pass that sums every label's gradient and Hessian in Arrow batches; what comes to the
    driver is labels x dim x dim, whatever the rows. Rows with a null vector take no part.
    """
    labels = list(y)
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), F.array(*[F.coalesce(col.cast("double"), F.lit(0.0)) for col in y.values()]).alias("y"))
    first = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), *[F.sum(F.element_at("y", i + 1)).alias(f"p{i}") for i in range(len(labels))]).first()
    n, dim = first["n"], first["dim"] or 0
    if dim > NEWTON_DIM:
        raise ValueError(f"vectors of {dim} components are too long for Newton steps")
    positive = np.array([first[f"p{i}"] or 0.0 for i in range(len(labels))])
    empty = positive == 0
    weight = np.stack([n / np.maximum(2 * (n - positive), 1), n / np.maximum(2 * positive, 1)])
    theta = np.zeros((len(labels), dim + 1))
    if not n:
        return Heads(labels, theta[:, :-1], theta[:, -1], empty)
    context = df.sparkSession.sparkContext
    for _ in range(steps):
        shared = context.broadcast((theta, weight))

        def run(batches, shared=shared):
            theta, weight = shared.value
            k = theta.shape[1]
            gradient, hessian = np.zeros(theta.shape), np.zeros((len(theta), k, k))
            for b in batches:
                x = np.concatenate([b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), np.ones((b.num_rows, 1))], 1)
                y = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                p = 1 / (1 + np.exp(-np.clip(x @ theta.T, -500, 500)))
                own = np.where(y > 0, weight[1], weight[0])
                gradient += ((p - y) * own).T @ x
                curve = p * (1 - p) * own
                for i in range(len(theta)):
                    hessian[i] += x.T @ (x * curve[:, i : i + 1])
            yield pa.RecordBatch.from_arrays([pa.array([gradient.tobytes()]), pa.array([hessian.tobytes()])], ["g", "h"])

        parts = rows.mapInArrow(run, "g binary, h binary").collect()
        gradient = sum(np.frombuffer(r["g"]).reshape(theta.shape) for r in parts) + theta / c
        hessian = sum(np.frombuffer(r["h"]).reshape(len(labels), dim + 1, dim + 1) for r in parts) + np.eye(dim + 1) / c
        step = np.linalg.solve(hessian, gradient[..., None])[..., 0]
        # a full step can overshoot where classes part cleanly
        step *= np.minimum(1, 10 / np.maximum(np.abs(step).max(1, keepdims=True), 1e-300))
        step[empty] = 0
        theta = theta - step
        if np.abs(step).max() < tolerance:
            break
    return Heads(labels, theta[:, :-1], theta[:, -1], empty)


def head_scores(df: DataFrame, key: str, vector: str, heads: Heads) -> DataFrame:
    """``key, label, score`` of every row with a vector and every label, in one pass."""
    shared = df.sparkSession.sparkContext.broadcast(heads)

    def run(batches):
        heads = shared.value
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, heads.weights.shape[1]))
            p = heads.scores(x)
            index = pa.array(np.repeat(np.arange(b.num_rows), len(heads.labels)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(index), pa.array(heads.labels * b.num_rows, pa.string()), pa.array(p.ravel())], [key, "label", "score"])

    rows = df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, label string, score double")


def embedding_one_vs_rest(vectors: DataFrame, kind: str = "logreg", classes: Iterable[int] = range(10), **options) -> DataFrame:
    is_label = {str(c): F.col("label") == c for c in classes}
    if kind == "logreg":
        made = head_scores(vectors, "vec_id", "embedding", fit_heads(vectors, "embedding", is_label, **options))
    else:
        rows = vectors.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
        made = one_vs_rest(rows, "vec_id", "features", is_label, kind)
    return made.select("vec_id", "label", F.round("score", 6).alias("score"))


def right_singular(vectors: DataFrame, vector: str, k: int) -> np.ndarray:
    """The first ``k`` right singular vectors (dim x k) of the uncentred rows, each with its largest component positive.

    Tasks sum up their Gram matrices in Arrow batches; what comes to the driver is dim x dim.
    """

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["g"])

    parts = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "g binary").collect()
    if not parts:
        return np.zeros((0, 0))
    gram = sum(np.frombuffer(r["g"]) for r in parts)
    dim = int(np.sqrt(len(gram)))
    _, basis = np.linalg.eigh(gram.reshape(dim, dim))
    basis = basis[:, ::-1][:, :k]
    return basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])


def projected(vector: Column, basis: np.ndarray) -> Column:
    """The coordinates of a vector on the columns of a basis."""
    return F.array(*[vectorize.dot(vector, F.lit([float(x) for x in b])) for b in basis.T])


def svd_block(vectors: DataFrame, key: str, vector: str, k: int, scale: float = 16.0) -> DataFrame:
    """``key, pos, value``: uncentred projections on the first ``k`` right singular vectors, as clipped z-scores times ``scale``."""
    rows = vectors.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
    basis = right_singular(rows, "v", k)
    long = rows.select(key, F.posexplode(projected(F.col("v"), basis) if basis.size else F.array().cast("array<double>")).alias("pos", "x"))
    stats = long.groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = (F.col("x") - F.col("m")) / F.when(F.col("s") < 1e-6, 1.0).otherwise(F.col("s"))
    return long.join(F.broadcast(stats), "pos").select(key, "pos", F.round(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z)) * scale, 6).alias("value"))


def lda_topics(docs: DataFrame, k: int = 30, words: int = 10, vocabulary: int = 5000, seed: int = 0, optimizer: str = "online", weighted: bool = False, rounds: int = 5) -> DataFrame:
    """``topic, rank, word, weight`` of an LDA on word counts, or with ``weighted`` on tf-idf; online or em."""
    tokens = docs.select("doc_id", text.words(F.col("text")).alias("words"))
    counter = CountVectorizer(inputCol="words", outputCol="counts", vocabSize=vocabulary, minDF=3).fit(tokens)
    counted = counter.transform(tokens)
    ready = IDF(inputCol="counts", outputCol="features").fit(counted).transform(counted) if weighted else counted.withColumnRenamed("counts", "features")
    model = LDA(k=k, maxIter=rounds, optimizer=optimizer, seed=seed).fit(ready)
    names = F.array(*[F.lit(w) for w in counter.vocabulary])
    topics = model.describeTopics(words).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    return topics.select("topic", "rank", F.element_at(names, F.col("t.termIndices") + 1).alias("word"), F.round("t.termWeights", 6).alias("weight"))


def text_pipeline(kind: str = "logreg", buckets: int = 1 << 14) -> Pipeline:
    """Hashed words, word pairs and character n-grams to a multinomial classifier; persists as a whole.

    Expects ``tokens array<string>`` and ``label string``.
    """
    last = NaiveBayes(labelCol="y") if kind == "bayes" else LogisticRegression(labelCol="y", maxIter=30, regParam=1e-4)
    return Pipeline(stages=[StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="skip"), HashingTF(inputCol="tokens", outputCol="features", numFeatures=buckets), last])


def text_tokens(column: Column) -> Column:
    words = text.words(column, 1)
    return F.concat(words, vectorize.word_ngrams(words, 2), vectorize.char_ngrams(column, 2, 5))


def at_one(predicted: DataFrame, label: str = "label", guess: str = "guess") -> DataFrame:
    """``n, p1, r1``: precision and recall of the first guess, over rows with one true label."""
    hit = F.sum((F.col(label) == F.col(guess)).cast("double"))
    return predicted.agg(F.count("*").alias("n"), (hit / F.greatest(F.count(guess), F.lit(1))).alias("p1"), (hit / F.greatest(F.count(label), F.lit(1))).alias("r1"))


def quantised(model: LogisticRegressionModel, most: int, bits: int = 8) -> Heads:
    """The features with the largest weights kept (``most`` of them, over all classes), weights rounded to ``bits`` bits of their range."""
    w = model.coefficientMatrix.toArray().copy()
    norm = np.sqrt((w**2).sum(0))
    if most < w.shape[1]:
        w[:, np.argsort(-norm, kind="stable")[most:]] = 0
    unit = np.abs(w).max() / (2 ** (bits - 1) - 1) or 1.0
    return Heads([str(i) for i in range(len(w))], np.round(w / unit) * unit, np.asarray(model.interceptVector.toArray()), np.zeros(len(w), bool))


def selected(df: DataFrame, features: str, y: str, k: int) -> DataFrame:
    """``df`` with ``selected``: the ``k`` features whose chi-squared test against the classes is strongest."""
    picker = UnivariateFeatureSelector(featuresCol=features, labelCol=y, outputCol="selected", selectionMode="numTopFeatures").setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(k)
    return picker.fit(df).transform(df)


def compare(df: DataFrame, folds: int = 3, seed: int = 0) -> list[tuple[str, float]]:
    """Cross-validated accuracy of five classifiers over ``features`` (not negative) and ``y``, best first."""
    first = df.select("features", "y").first()
    n_classes = int(df.agg(F.max("y")).first()[0]) + 1
    tried = (
        LogisticRegression(labelCol="y"), RandomForestClassifier(labelCol="y", seed=seed), DecisionTreeClassifier(labelCol="y", seed=seed), NaiveBayes(labelCol="y"),
        MultilayerPerceptronClassifier(labelCol="y", layers=[first["features"].size, 16, n_classes], seed=seed, maxIter=50),
    )
    found = []
    for model in tried:
        cv = CrossValidator(estimator=model, estimatorParamMaps=ParamGridBuilder().build(), evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy"), numFolds=folds, seed=seed)
        found.append((type(model).__name__, cv.fit(df).avgMetrics[0]))
    return sorted(found, key=lambda x: -x[1])


def save(model: PipelineModel, thresholds: DataFrame, path: str) -> None:
    """A model with its thresholds as one folder."""
    model.write().overwrite().save(f"{path}/model")
    thresholds.write.mode("overwrite").parquet(f"{path}/thresholds")


def load(spark, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/thresholds")


def encoded(df: DataFrame, key: str, windows: str, encode: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """``key, vector``: an encoder that the caller brings, over each row's text windows, averaged and of unit length."""

    def run(parts):
        for part in parts:
            flat = [(k, w) for k, some in zip(part[key], part[windows]) for w in some]
            vectors: dict = {}
            for i in range(0, len(flat), batch):
                for (k, _), v in zip(flat[i : i + batch], encode([w for _, w in flat[i : i + batch]])):
                    vectors.setdefault(k, []).append(v)
            means = {k: np.mean(np.asarray(v, float), axis=0) for k, v in vectors.items()}
            yield pd.DataFrame({key: list(means), "vector": [(m / (np.linalg.norm(m) or 1.0)).tolist() for m in means.values()]})

    return df.select(key, windows).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, vector array<double>")
