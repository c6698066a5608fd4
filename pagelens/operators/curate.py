"""Merging, deduplicating, joining and filtering annotated pages. First-wins needs an explicit order, so
every function takes it as columns; none relies on the order of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.sources import codec

#: Rows up to which a dimension of narrow rows is broadcast; larger ones are left to the optimizer's own statistics.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast where a bounded count shows that it is small, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows, columns by name, absent ones null, with ``file_rank`` in the given order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("file_rank", F.lit(i)) for i, p in enumerate(parts)])


def first_wins(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """One row for each key, the first in ``order``. Aggregates before it shuffles, so hot keys stay cheap."""
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    ranks = [F.col(o) if isinstance(o, str) else o for o in order]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    picked = df.groupBy(*[k.alias(f"key_{i}") for i, k in enumerate(named)]).agg(F.min_by(row, F.struct(*ranks)).alias("row"))
    return picked.select("row.*")


def dedup_composite(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row for each combination of keys, null as the empty string."""
    return first_wins(df, [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], order)


def first_positions(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the place where each came first."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))


def annotation_join(annotations: DataFrame, pages: DataFrame, content: str, order: list[str]) -> DataFrame:
    """Filtered annotations with the content of their url: stripped keys, first row of each side, no empty content."""
    left = first_wins(annotations.withColumn("key", urls.strip_slashes(F.col("url"))), ["key"], order)
    right = first_wins(pages.withColumn("key", urls.strip_slashes(F.col("url"))), ["key"], order).select("key", content)
    return left.join(right, "key").where(F.col(content).isNotNull()).drop("url").withColumnRenamed("key", "url")


def good_annotations(df: DataFrame) -> DataFrame:
    """Strictly no review needed, strictly in the target language, and at least one category."""
    return df.where((F.col("needs_human_review") == F.lit(False)) & (F.col("in_target_language") == F.lit(True)) & (F.size("categories") > 0))


def reasons(df: DataFrame, text: str, least: int) -> DataFrame:
    """``df`` with ``reason``: why a row is skipped, or ok."""
    return df.withColumn("reason", F.when(F.col(text).isNull(), "missing").when(F.trim(F.col(text)) == "", "empty").when(F.length(text) < least, "short").otherwise("ok"))


def label_counts(df: DataFrame, labels: str) -> DataFrame:
    """In how many rows each label occurs."""
    return df.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def prune_rare(df: DataFrame, labels: str, least: int) -> DataFrame:
    """Strip labels of fewer than ``least`` rows; rows left without a label go.

    The labels that stay come to the driver, as the label set of a classifier; up to ``BROADCAST_ROWS`` of them
    are written into the plan, more are joined by label.
    """
    kept = label_counts(df, labels).where(F.col("n") >= least).select("label")
    known = [r["label"] for r in kept.limit(BROADCAST_ROWS + 1).collect()]
    if len(known) <= BROADCAST_ROWS:
        out = df.withColumn(labels, F.array_intersect(labels, F.lit(known) if known else F.array().cast("array<string>")))
        return out.where(F.size(labels) > 0)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row_")
    each = df.select(F.monotonically_increasing_id().alias("i_"), row).select("i_", "row_", F.posexplode(F.array_distinct(F.col("row_").getField(labels))).alias("pos_", "label")).join(kept, "label")
    back = each.groupBy("i_").agg(F.first("row_").alias("row_"), F.transform(F.array_sort(F.collect_list(F.struct("pos_", "label"))), lambda x: x["label"]).alias("left_"))
    return back.select(*[F.col("left_").alias(c) if c == labels else F.col("row_").getField(c).alias(c) for c in df.columns])


def merged(parts: list[DataFrame], content: str = "html") -> tuple[DataFrame, DataFrame]:
    """Files in order made one, the first row of each url kept, its page compressed: ``(url, categories, compressed_html)``.

    The second result counts the rows by what became of them: processed, duplicate or error (no url).
    """
    every = union_all(parts).withColumn("order_", F.struct("file_rank", "line_no"))
    good = every.where(F.trim("url") != "")
    first = first_wins(good, ["url"], ["order_"])
    out = first.select("url", "categories", codec.compressed(F.col(content)).alias("compressed_html"))
    per_url = good.groupBy("url").agg(F.count("*").alias("n"))
    seen = per_url.agg(F.count("*").alias("processed"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate"))
    bad = every.agg(F.count_if(F.coalesce(F.trim("url") == "", F.lit(True))).alias("error"))
    counts = seen.crossJoin(bad).select(F.explode(F.create_map(*[x for k in ("processed", "duplicate", "error") for x in (F.lit(k), F.col(k))])).alias("status", "n"))
    return out, counts


def checked_labels(df: DataFrame, labels: str, known: list[str], strict: bool = False) -> DataFrame:
    """``df`` with only known labels; with ``strict`` unknown ones raise."""
    if strict:
        odd = [r[0] for r in df.select(F.explode(F.array_except(labels, F.lit(known)))).distinct().limit(20).collect()]
        if odd:
            raise ValueError(f"unknown labels: {sorted(odd)}")
    return df.withColumn(labels, F.filter(labels, lambda x: x.isin(*known)))


def classified(df: DataFrame, labels: str) -> DataFrame:
    """Rows with at least one label."""
    return df.where(F.size(labels) > 0)


def head(df: DataFrame, order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows in an explicit order; a top-k, not a sort of all."""
    return df.orderBy(*order).limit(most)


def difference(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Distinct values of the left that the right lacks."""
    return anti(left.select(on).distinct(), right, on)


def by_support(metrics: DataFrame, n: str = "n") -> DataFrame:
    """A small report, the labels with most rows first."""
    return metrics.orderBy(F.desc(n), "label")


def anti(df: DataFrame, seen: DataFrame, on: str) -> DataFrame:
    return df.join(small(seen.select(on).distinct()), on, "left_anti")


def semi(df: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    return df.join(small(wanted.select(on).distinct()), on, "left_semi")


def aligned(df: DataFrame, vectors: DataFrame, on: str, vector: str, dim: int, most_missing: float = 0.02) -> DataFrame:
    """``df`` with the vector of its key, zeros where it is missing; an error if too many are."""
    out = df.join(vectors.select(on, F.col(vector).alias("vec")), on, "left")
    share = out.agg(F.avg(F.col("vec").isNull().cast("double"))).first()[0] or 0.0
    if share > most_missing:
        raise ValueError(f"{share:.1%} of the rows have no vector")
    return out.withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0).cast("float"), dim)))


def status_counts(df: DataFrame, status: Column) -> DataFrame:
    return df.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def stratified_head(df: DataFrame, by: str, order: list[Column | str], most: int) -> DataFrame:
    """At most ``most`` rows of each stratum in the given order."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
