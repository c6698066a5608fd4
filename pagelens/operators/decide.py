"""Thresholds, decoding and quality of multilabel scores in long form ``(id, label, score, y)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binarised(df: DataFrame, key: str, labels: Column, classes: list[str]) -> DataFrame:
    """One row for each row and class, ``y`` 1 where the row has the label; unknown labels are ignored."""
    return df.select(key, labels.alias("own"), F.explode(F.array(*[F.lit(c) for c in classes])).alias("label")).select(key, "label", F.array_contains("own", F.col("label")).cast("int").alias("y"))


def encoded(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values numbered from 0."""
    values = df.select(column).distinct()
    return values.withColumn("code", F.row_number().over(Window.orderBy(column)) - 1)


def row_z(scores: DataFrame, key: str) -> DataFrame:
    """Scores of each row as z-scores of that row (deviation below 1e-9 counts as 1)."""
    w = Window.partitionBy(key)
    sigma = F.stddev_pop("score").over(w)
    return scores.withColumn("score", (F.col("score") - F.avg("score").over(w)) / F.when(sigma < 1e-9, 1.0).otherwise(sigma))


def sweep(scores: DataFrame, grid: list[float]) -> DataFrame:
    """``label, thr, tp, fp, fn, f1`` of every threshold."""
    thr = scores.select("label", "score", "y", F.explode(F.array(*[F.lit(g) for g in grid])).alias("thr"))
    hit = F.col("score") >= F.col("thr")
    out = thr.groupBy("label", "thr").agg(*[F.count_if(c).alias(n) for c, n in ((hit & (F.col("y") == 1), "tp"), (hit & (F.col("y") == 0), "fp"), (~hit & (F.col("y") == 1), "fn"))])
    return out.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def best_thresholds(swept: DataFrame) -> DataFrame:
    """The first threshold with the highest F1 of each label; 0.5 where no F1 is above 0."""
    best = swept.groupBy("label").agg(F.min_by(F.struct("thr", "f1"), F.struct(-F.col("f1"), F.col("thr"))).alias("b"))
    return best.select("label", F.when(F.col("b.f1") > 0, F.col("b.thr")).otherwise(0.5).alias("thr"))


def shared_threshold(scores: DataFrame, grid: list[float]) -> float:
    """One threshold for all labels, with the highest micro F1."""
    total = sweep(scores, grid).groupBy("thr").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    row = total.orderBy(F.desc(f1(F.col("tp"), F.col("fp"), F.col("fn"))), "thr").first()
    return row["thr"] if row else 0.5


def decoded(scores: DataFrame, thresholds: DataFrame, key: str, force_one: bool = True) -> DataFrame:
    """``scores`` with ``pred``; a row without a label above its threshold gets its best one."""
    w = Window.partitionBy(key)
    out = scores.join(thresholds, "label").withColumn("over", F.col("score") >= F.col("thr"))
    best = F.row_number().over(w.orderBy(F.desc("score"), "label")) == 1
    any_over = F.max(F.col("over").cast("int")).over(w) == 1
    pred = F.col("over") | (~any_over & best) if force_one else F.col("over")
    return out.withColumn("pred", pred.cast("int")).drop("over")


def top_k(scores: DataFrame, key: str, k: int, least: float | None = None) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("score"), "label")
    out = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out if least is None else out.where((F.col("score") >= least) | (F.col("rank") == 1))


def best_labels(scores: DataFrame, thresholds: DataFrame, key: str, k: int = 3, least: float = 0.0) -> DataFrame:
    """The first ``k`` labels of each row whose score reaches both its label's threshold and ``least``; at least the best one. Scores have 4 decimals."""
    w = Window.partitionBy(key)
    out = scores.join(thresholds, "label").withColumn("good", (F.col("score") >= F.col("thr")) & (F.col("score") >= least))
    out = out.withColumn("rank", F.row_number().over(w.orderBy(F.desc("good"), F.desc("score"), "label")))
    first = F.row_number().over(w.orderBy(F.desc("score"), "label")) == 1
    found = F.max(F.col("good").cast("int")).over(w) == 1
    out = out.withColumn("taken", F.when(found, F.col("good") & (F.col("rank") <= k)).otherwise(first))
    return out.where("taken").select(key, "label", F.round("score", 4).alias("score"), F.when(F.col("good"), F.col("rank")).otherwise(1).alias("rank"))


def label_metrics(pred: DataFrame) -> DataFrame:
    """``label, tp, fp, fn, n, precision, recall, f1``."""
    y, p = F.col("y") == 1, F.col("pred") == 1
    out = pred.groupBy("label").agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y).alias("n"))
    part = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    return out.select("*", part("tp", "fp").alias("precision"), part("tp", "fn").alias("recall"), f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def overall_metrics(pred: DataFrame, key: str) -> DataFrame:
    """One row: micro, macro, weighted and sample F1, exact match, Hamming loss, share of empty predictions."""
    by_label = label_metrics(pred).agg(f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("weighted_f1"))
    y, p = F.col("y") == 1, F.col("pred") == 1
    rows = pred.groupBy(key).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count("*").alias("k"))
    by_row = rows.agg(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("samples_f1"), F.avg((F.col("fp") + F.col("fn") == 0).cast("double")).alias("exact"), (F.sum(F.col("fp") + F.col("fn")) / F.sum("k")).alias("hamming"), F.avg((F.col("tp") + F.col("fp") == 0).cast("double")).alias("empty"))
    return by_label.crossJoin(by_row)


def auc(scores: DataFrame) -> DataFrame:
    """ROC-AUC of each label by rank sums, ties sharing their average rank; labels with one class have none.

    Scores are first counted by value, so ranks run over distinct scores.
    """
    by_value = scores.groupBy("label", "score").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    below = Window.partitionBy("label").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_value.withColumn("rank", F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2.0)
    out = ranked.groupBy("label").agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return out.where("p > 0 and q > 0").select("label", ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def confusion(df: DataFrame, true: str, predicted: str, labels: list[str]) -> DataFrame:
    """Counts with true labels as rows and ``labels`` as columns, 0 where there are none."""
    return df.groupBy(true).pivot(predicted, labels).count().na.fill(0)


def missed(pred: DataFrame, key: str) -> DataFrame:
    """``true, predicted, n``: for each true label that was not predicted, the labels that were."""
    lost = pred.where("y = 1 and pred = 0").select(key, F.col("label").alias("true"))
    made = pred.where("pred = 1").select(key, F.col("label").alias("predicted"))
    return lost.join(made, key).groupBy("true", "predicted").agg(F.count("*").alias("n"))
