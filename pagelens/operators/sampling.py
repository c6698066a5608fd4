"""Reproducible shuffles, samples and splits, ordered by the MD5 of a seed and the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(key: str, seed: int = 0) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(shuffle_key(key, seed), key)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return shuffled(df, key, seed).limit(n)


def stratified_sample(df: DataFrame, by: str, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` random rows of each stratum, with their rank."""
    w = Window.partitionBy(by).orderBy(shuffle_key(key, seed), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


#: Parts that a stratum is ranked in: hash prefixes of three hexadecimal digits.
PREFIX = 3


def ranked(df: DataFrame, by: list[str], key: str, seed: int = 0, rank: str = "rank", total: str = "total") -> DataFrame:
    """``df`` with the rank of each row in its stratum by hash order, from 1, and the rows of the stratum.

    Rows are ranked within (stratum, hash prefix) and moved up by the rows of lesser prefixes, which are
    counted first; so no stratum is sorted in one task, whatever its size. Ties of the key fall in any order.
    """
    h = shuffle_key(key, seed)
    rows = df.withColumn("h_", h).withColumn("p_", F.substring("h_", 1, PREFIX))
    strata = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0null")).alias(f"k{i}_") for i, c in enumerate(by)]
    rows = rows.select("*", *strata) if strata else rows
    keys = [f"k{i}_" for i in range(len(by))]
    counts = rows.groupBy(*keys, "p_").agg(F.count("*").alias("c_"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    counts = counts.withColumn("b_", F.sum("c_").over(whole.orderBy("p_")) - F.col("c_")).withColumn(total, F.sum("c_").over(whole)).drop("c_")
    inside = Window.partitionBy(*keys, "p_").orderBy("h_", key)
    out = rows.withColumn("r_", F.row_number().over(inside)).join(counts, [*keys, "p_"])
    return out.withColumn(rank, F.col("r_") + F.col("b_")).drop("h_", "p_", "r_", "b_", *keys)


def stratified_split(df: DataFrame, by: Column, key: str, percent: int = 15, seed: int = 42) -> DataFrame:
    """``split``: valid for the first ``ceil(percent %)`` of each stratum in hash order, train for the rest."""
    placed = ranked(df.withColumn("stratum", by), ["stratum"], key, seed, "r__", "n__")
    return placed.withColumn("split", F.when(F.col("r__") <= F.ceil(F.col("n__") * percent / 100), "valid").otherwise("train")).drop("r__", "n__")


def multilabel_split(df: DataFrame, labels: str, key: str, percent: int = 15, seed: int = 42) -> DataFrame:
    """``split`` by iterative stratification in order of rarity: each row counts in the stratum of its rarest label.

    A stratum with fewer than two rows has nothing to divide; its rows are split by hash alone, as are rows
    without labels. The labels' counts, one row for each label, decide which is rarest.
    """
    counts = df.select(F.explode(F.array_distinct(labels)).alias("label_")).groupBy("label_").agg(F.count("*").alias("c_"))
    rarest = df.select(key, F.explode(F.array_distinct(labels)).alias("label_")).join(counts, "label_").groupBy(key).agg(F.min_by("label_", F.struct("c_", "label_")).alias("stratum"))
    placed = ranked(df.join(rarest, key, "left"), ["stratum"], key, seed, "r__", "n__")
    alone = F.conv(F.substring(shuffle_key(key, seed), 1, 8), 16, 10).cast("long") % 100 < percent
    valid = F.when((F.col("n__") < 2) | F.col("stratum").isNull(), alone).otherwise(F.col("r__") <= F.ceil(F.col("n__") * percent / 100))
    return placed.withColumn("split", F.when(valid, "valid").otherwise("train")).drop("r__", "n__")


def group_split(df: DataFrame, group: str, percents: tuple[int, int] = (70, 15), seed: int = 0) -> DataFrame:
    """``split`` train, valid or test by whole groups; the shares are of groups, not of rows."""
    groups = ranked(df.select(group).distinct(), [], group, seed, "r__", "n__")
    a, b = percents
    r = F.col("r__") - 1
    groups = groups.withColumn("split", F.when(r * 100 < F.col("n__") * a, "train").when(r * 100 < F.col("n__") * (a + b), "valid").otherwise("test"))
    return df.join(groups.select(group, "split"), group)


def cross_split(df: DataFrame, side: str, source: str, target: str, key: str, least: int = 200, percent: int = 15, seed: int = 0) -> DataFrame:
    """Train and valid from one side (valid: the larger of ``least`` and ``percent``), test from another; other rows go."""
    own = df.where(F.col(side) == source)
    n = own.agg(F.greatest(F.lit(least), F.floor(F.count("*") * percent / 100)).alias("cut"))
    order = own.select(key, shuffle_key(key, seed).alias("h")).orderBy("h", key)
    cut = n.first()["cut"]
    valid = order.limit(int(cut)).select(key).withColumn("picked", F.lit(True))
    own = own.join(valid, key, "left").withColumn("split", F.when(F.col("picked"), "valid").otherwise("train")).drop("picked")
    return own.unionByName(df.where(F.col(side) == target).withColumn("split", F.lit("test")))


def half(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """``half``: false for the first half of the rows in hash order, rounded down, true for the rest."""
    return ranked(df, [], key, seed, "r__", "n__").withColumn("half", F.col("r__") > F.floor(F.col("n__") / 2)).drop("r__", "n__")


def folds(df: DataFrame, key: str, k: int = 3, seed: int = 0) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.conv(F.substring(shuffle_key(key, seed), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))
