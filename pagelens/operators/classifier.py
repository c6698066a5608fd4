"""The structural page classifier: features, one model a label, thresholds, decoding, metrics and explanation.

Vocabulary, scaling and models are fitted on training pages only, thresholds on validation pages. All
feature stages run in the JVM; the tree of a page is built once in Arrow batches.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators import decide, models, pages, sampling, vectorize

GRID = [i / 100 for i in range(2, 99)]


@dataclass
class Config:
    """What is read and how; ``score`` is none or row_z, ``objective`` macro (a threshold a label) or micro (one for all)."""

    groups: tuple[str, ...] = pages.GROUPS[:10]
    stats: bool = True
    min_df: int = 2
    max_df: float = 0.98
    max_features: int = 50_000
    binary: bool = False
    c: float = 4.0
    stat_weight: float = 0.5
    embed_svd: int = 128
    embed_scale: float = 16.0
    score: str = "none"
    objective: str = "macro"
    min_label: int = 10


_CORE, _ALL = ("tag", "attr", "href", "meta", "plat"), pages.GROUPS[:10]
#: Named sets of groups for an ablation; each adds or leaves out one family.
LADDER = {
    "stats": (), "tag": ("tag",), "tag+attr": ("tag", "attr"), "core-href": ("tag", "attr", "meta", "plat"), "core": _CORE, "core-href+css": ("tag", "attr", "meta", "plat", "css"),
    **{f"core+{g}": (*_CORE, g) for g in ("css", "cssraw")}, **{f"core+css+{g}": (*_CORE, "css", g) for g in ("shape", "res", "marker")},
    "all": _ALL, "words": ("words",), "all+words": (*_ALL, "words"), "all+url": (*_ALL, "url"),
}


@dataclass
class StructuralClassifier:
    config: Config = field(default_factory=Config)
    labels: list[str] = field(default_factory=list)
    features: PipelineModel | None = None
    vocabulary: list[str] = field(default_factory=list)
    scaling: list[tuple[float, float]] = field(default_factory=list)
    heads: dict[str, LogisticRegressionModel | None] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)
    #: Of the vectors: their length (0 without any), the basis they are projected on (or none), means and deviations.
    dim: int = 0
    basis: list[list[float]] | None = None
    center: list[tuple[float, float]] = field(default_factory=list)

    def _raw(self, html: DataFrame, vectors: DataFrame | None) -> DataFrame:
        made = pages.page_features(html, self.config.groups, self.config.stats)
        repeated = F.flatten(F.transform("tokens", lambda t: F.array_repeat(F.concat(t["grp"], F.lit("|"), t["token"]), t["tf"])))
        out = made.select("page_id", repeated.alias("tokens"), *([F.element_at("stats", i + 1).alias(k) for i, k in enumerate(pages.DENSE_NAMES)] if self.config.stats else []))
        if vectors is not None:
            out = out.join(vectors.select("page_id", F.col("vector").cast("array<double>").alias("vector")), "page_id")
        return out

    def _block(self, vector):
        """The vector's columns before scaling: its projection, where there is a basis."""
        return vector if self.basis is None else models.projected(vector, np.array(self.basis))

    def _vectors(self, raw: DataFrame) -> DataFrame:
        blocks = ["tfidf"]
        if self.config.stats:
            # rounded, as the rounding noise of a constant column must not count as its deviation
            z = [F.round(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (vectorize.signed_log(F.col(c)) - m) / s)) * self.config.stat_weight, 9) for c, (m, s) in zip(pages.DENSE_NAMES, self.scaling)]
            raw = raw.withColumn("numbers", array_to_vector(F.array(*z)))
            blocks.append("numbers")
        if "vector" in raw.columns:
            z = [F.round(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.element_at("block", i + 1) - m) / s)) * self.config.embed_scale, 9) for i, (m, s) in enumerate(self.center)]
            raw = raw.withColumn("block", self._block(F.col("vector"))).withColumn("embedding", array_to_vector(F.array(*z)))
            blocks.append("embedding")
        raw = self.features.transform(raw)
        return Normalizer(inputCol="all", outputCol="features").transform(VectorAssembler(inputCols=blocks, outputCol="all").transform(raw)).select("page_id", "features")

    def fit(self, html: DataFrame, truth: DataFrame, vectors: DataFrame | None = None, valid_percent: int = 15, refit: bool = False) -> StructuralClassifier:
        """``html(page_id, html)`` (and ``url``), ``truth(page_id, labels)`` and, if there are any, ``vectors(page_id, vector)``.

        With ``refit`` the heads are fitted again on training and validation pages; thresholds stay as tuned before.
        """
        counts = truth.select("page_id", F.explode(F.array_distinct("labels")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
        self.labels = sorted(r["label"] for r in counts.where(F.col("n") >= self.config.min_label).collect())
        split = sampling.stratified_split(truth.select("page_id", "labels"), F.array_join(F.sort_array("labels"), ","), "page_id", valid_percent)
        raw = self._raw(html, vectors).join(split.select("page_id", "labels", "split"), "page_id").persist()
        train = raw.where("split = 'train'")
        n = train.count()
        frequency = train.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
        vocab = vectorize.vocabulary(frequency, n, self.config.min_df, self.config.max_df, self.config.max_features).orderBy("col").collect()
        self.vocabulary = [r["token"] for r in vocab] or ["none|"]
        counter = CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol="tokens", outputCol="tf")
        counter.setBinary(self.config.binary)
        idf = ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in vocab] or [1.0]), inputCol="tf", outputCol="weighted")
        self.features = PipelineModel([counter, idf, Normalizer(inputCol="weighted", outputCol="tfidf")])
        if self.config.stats:
            x = {c: vectorize.signed_log(F.col(c)) for c in pages.DENSE_NAMES}
            row = train.agg(*[f(x[c]).alias(f"{c}_{k}") for c in x for f, k in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
            self.scaling = [(row[f"{c}_m"] or 0.0, s if (s := row[f"{c}_s"] or 0.0) >= 1e-6 else 1.0) for c in x]
        if vectors is not None:
            self._fit_block(train)
        ready = self._vectors(raw).join(raw.select("page_id", "labels", "split"), "page_id").persist()
        self._fit_heads(ready.where("split = 'train'"))
        valid = ready.where("split = 'valid'")
        scored = self._scored(valid).join(decide.binarised(valid, "page_id", F.col("labels"), self.labels), ["page_id", "label"])
        if self.config.objective == "micro":
            shared = decide.shared_threshold(scored, GRID)
            self.thresholds = dict.fromkeys(self.labels, shared)
        else:
            self.thresholds = dict.fromkeys(self.labels, 0.5) | {r["label"]: r["thr"] for r in decide.best_thresholds(decide.sweep(scored, GRID)).collect()}
        if refit:
            self._fit_heads(ready)
        ready.unpersist()
        raw.unpersist()
        return self

    def _fit_heads(self, ready: DataFrame) -> None:
        for label in self.labels:
            rows = ready.select("features", F.array_contains("labels", label).cast("double").alias("y"))
            self.heads[label] = models.classifier("logreg", self.config.c).fit(models.balanced(rows, "y")) if rows.where("y = 1").limit(1).count() else None

    def _fit_block(self, train: DataFrame) -> None:
        """Length, basis, means and deviations of the vectors of training pages."""
        self.dim = train.agg(F.max(F.size("vector"))).first()[0] or 0
        if 0 < self.config.embed_svd < self.dim:
            self.basis = models.right_singular(train, "vector", self.config.embed_svd).tolist()
        long = train.select(F.posexplode(self._block(F.col("vector"))).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
        self.center = [(r["m"], r["s"] if r["s"] >= 1e-6 else 1.0) for r in long.orderBy("pos").collect()]

    def score_page(self, html: str, url: str | None = None, vector: list[float] | None = None) -> DataFrame:
        """``label, score`` of one page, by the same expressions as for many; an error if the vector is missing or of another length."""
        if self.dim and vector is None:
            raise ValueError("the model reads vectors, and the page has none")
        if self.dim and len(vector) != self.dim:
            raise ValueError(f"the model reads vectors of {self.dim} components, not {len(vector)}")
        spark = SparkSession.active()
        one = spark.createDataFrame([(0, html, url)], "page_id long, html string, url string")
        own = spark.createDataFrame([(0, [float(x) for x in vector])], "page_id long, vector array<double>") if self.dim else None
        return self.scores(one, own).drop("page_id")

    def _scored(self, ready: DataFrame) -> DataFrame:
        # all heads in one pass; a branch for each label would parse the pages again
        wide, made = ready.select("page_id", "features"), []
        for i, label in enumerate(self.labels):
            head, score = self.heads[label], F.lit(0.0)
            if head is not None:
                head = head.copy().setProbabilityCol(f"p{i}").setRawPredictionCol("").setPredictionCol("")
                wide, score = head.transform(wide), F.element_at(vector_to_array(f"p{i}"), 2)
            made.append(F.struct(F.lit(label).alias("label"), score.alias("score")))
        out = wide.select("page_id", F.inline(F.array(*made)))
        return decide.row_z(out, "page_id") if self.config.score == "row_z" else out

    def scores(self, html: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        """``page_id, label, score``; pages without a tree have none."""
        return self._scored(self._vectors(self._raw(html, vectors)))

    def predict(self, html: DataFrame, vectors: DataFrame | None = None, force_one: bool = True) -> DataFrame:
        """``page_id, label, score, pred``."""
        thr = html.sparkSession.createDataFrame(list(self.thresholds.items()), "label string, thr double")
        return decide.decoded(self.scores(html, vectors), thr, "page_id", force_one).drop("thr")

    def evaluate(self, html: DataFrame, truth: DataFrame, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Overall metrics and metrics by label."""
        pred = self.predict(html, vectors).join(decide.binarised(truth, "page_id", F.col("labels"), self.labels), ["page_id", "label"]).persist()
        return decide.overall_metrics(pred, "page_id"), decide.label_metrics(pred)

    def explain(self, spark: SparkSession, k: int = 15) -> DataFrame:
        """``label, rank, feature, weight``: what speaks most for each label."""
        names, out = [*self.vocabulary, *[f"@{c}" for c in pages.DENSE_NAMES if self.config.stats]], []
        for label, head in self.heads.items():
            if head is not None:
                weights = head.coefficients.toArray()
                best = sorted(range(len(weights)), key=lambda i: (-weights[i], i))[:k]
                out += [(label, r, names[i] if i < len(names) else f"~embed{i - len(names)}", float(weights[i])) for r, i in enumerate(best)]
        return spark.createDataFrame(out, "label string, rank int, feature string, weight double")

    def save(self, path: str) -> None:
        """The feature stages, each head, and the rest as JSON."""
        spark = SparkSession.active()
        self.features.write().overwrite().save(f"{path}/features")
        for i, label in enumerate(self.labels):
            if self.heads[label] is not None:
                self.heads[label].write().overwrite().save(f"{path}/head{i}")
        rest = {"config": asdict(self.config), "labels": self.labels, "scaling": self.scaling, "thresholds": self.thresholds, "dim": self.dim, "basis": self.basis, "center": self.center, "empty": [x for x in self.labels if self.heads[x] is None]}
        spark.createDataFrame([(json.dumps(rest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/rest")

    @classmethod
    def load(cls, path: str) -> StructuralClassifier:
        spark = SparkSession.active()
        rest = json.loads(spark.read.text(f"{path}/rest").first()["value"])
        config = Config(**rest["config"] | {"groups": tuple(rest["config"]["groups"])})
        out = cls(config, rest["labels"], PipelineModel.load(f"{path}/features"), thresholds=rest["thresholds"], scaling=[tuple(x) for x in rest["scaling"]], dim=rest["dim"], basis=rest["basis"], center=[tuple(x) for x in rest["center"]])
        out.vocabulary = out.features.stages[0].vocabulary
        out.heads = {x: None if x in rest["empty"] else LogisticRegressionModel.load(f"{path}/head{i}") for i, x in enumerate(out.labels)}
        return out


def ablation(html: DataFrame, truth: DataFrame, test: DataFrame, ladder: dict[str, tuple[str, ...]] = LADDER, **config) -> DataFrame:
    """``name, micro_f1, macro_f1, exact`` of each set of groups, fitted on ``html`` and scored on ``test``, best first."""
    found = []
    for name, groups in ladder.items():
        overall, _ = StructuralClassifier(Config(groups=groups, **config)).fit(html, truth).evaluate(test, truth)
        row = overall.first()
        found.append((name, round(row["micro_f1"], 4), round(row["macro_f1"], 4), round(row["exact"], 4)))
    return html.sparkSession.createDataFrame(sorted(found, key=lambda r: -r[2]), "name string, micro_f1 double, macro_f1 double, exact double")


def sweep(html: DataFrame, truth: DataFrame, test: DataFrame, options: dict[str, list]) -> DataFrame:
    """``config, micro_f1, macro_f1, exact`` of every combination of options, fitted on ``html`` and scored on ``test``, best first."""
    found = []
    for values in itertools.product(*options.values()):
        chosen = dict(zip(options, values))
        row = StructuralClassifier(Config(**chosen)).fit(html, truth).evaluate(test, truth)[0].first()
        found.append((json.dumps(chosen, sort_keys=True), round(row["micro_f1"], 4), round(row["macro_f1"], 4), round(row["exact"], 4)))
    return html.sparkSession.createDataFrame(sorted(found, key=lambda r: (-r[2], r[0])), "config string, micro_f1 double, macro_f1 double, exact double")


def config_score(domain: float, there: float, back: float) -> float:
    """One number for a configuration: the macro F1 across domains and half of each across languages."""
    return round(domain + 0.5 * there + 0.5 * back, 4)
