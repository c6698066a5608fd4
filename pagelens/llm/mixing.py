"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code-point order (null last) weigh ``weights`` in turn and share ``share`` times all words.
A target above ``most`` times its source's size is cut there and the excess reshared by weight. Each
source is taken as many whole times as its target allows (complete epochs); the rest is filled by
documents in order of exponential keys ``-ln(u) / quality``, up to the prefix whose sum is nearest.

Sums run over (source, key bucket), so that no source is sorted in one task: only the bucket in which
a source's budget ends is ordered row by row. There are as many buckets as keep that at about
``BUCKET_ROWS`` rows. ``u`` is a hash of the id, so reruns agree.

Defined cases: null texts have size 0 and are taken in full for nothing; a null id has the key of the empty
text; rows with the same id, size and key fall alike, so rows that repeat are taken or left together; an
empty table gives an empty mix; if all sizes are 0 so are all targets; other columns, of any name, are
carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.llm import common

#: Rows that the bucket of a source's end has, if its rows are all rows.
BUCKET_ROWS = 50_000
#: Sources up to which their decisions are broadcast (about 100 bytes each); beyond it they are joined by key and salt.
BROADCAST_SOURCES = 50_000
SALTS = 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """A weight between 0.1 and 1 that falls with the share of symbols."""
    n = F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(4.0) * F.regexp_count(text, F.lit("[#*$%&|<>]")) / n), F.lit(1.0))


def n_buckets(docs: DataFrame) -> int:
    return 1 << max(10, (docs.count() // BUCKET_ROWS).bit_length())


def keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str, quality: Column | None) -> DataFrame:
    """``docs`` with ``m_`` columns: source key, size, exponential key and its bucket."""
    buckets = n_buckets(docs)
    q = text_quality(F.col(text_col)) if quality is None else quality
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    return (
        docs.withColumn("m_source", F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")))
        .withColumn("m_size", n_words(F.col(text_col)))
        .withColumn("m_key", -F.log(u) / q)
        .withColumn("m_bucket", F.least(F.floor((1 - F.exp(-F.col("m_key"))) * buckets), F.lit(buckets - 1)).cast("int"))
    )


def targets(sums: DataFrame, share: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """``(m_source, source_size)`` to its target, by water-filling in order of cap to weight.

    The table has a row for each source; its windows run over sources, not over documents.
    """
    by_name = Window.orderBy((F.col("m_source") == "").cast("int"), "m_source")
    by_cap = Window.orderBy("ratio", (F.col("m_source") == "").cast("int"), "m_source")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sums.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    t = t.withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "m_source", "level"))).over(everything)["level"])
    return t.select("m_source", "source_size", F.when((F.col("level").isNull()) | (F.col("weight") * F.col("level") >= F.col("cap")), F.col("cap")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def decisions(rows: DataFrame, id_col: str, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: float = 2) -> DataFrame:
    """For each source: size, target, whole epochs, and the last (key, id, size) that its fraction takes."""
    sums = rows.groupBy("m_source", "m_bucket").agg(F.sum("m_size").alias("size"))
    sums = common.checkpointed(sums)
    goal = targets(sums.groupBy("m_source").agg(F.sum("size").alias("source_size")), share, weights, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = common.checkpointed(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    order = Window.partitionBy("m_source").orderBy("m_bucket")
    prefix = sums.withColumn("before", F.sum("size").over(order) - F.col("size")).join(goal, "m_source")
    ends = prefix.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest"))).groupBy("m_source").agg(F.max(F.struct("m_bucket", "before", "rest")).alias("e")).select("m_source", "e.*")
    last = Window.partitionBy("m_source").orderBy("m_key", id_col, "m_size").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("m_source", "m_bucket", "m_key", id_col, "m_size").join(ends, ["m_source", "m_bucket"])
    inside = inside.withColumn("sum", F.sum("m_size").over(last) + F.col("before")).where(2 * F.col("sum") - F.col("m_size") <= 2 * F.col("rest"))
    bound = inside.groupBy("m_source").agg(F.max(F.struct("m_key", F.col(id_col).alias("id"), "m_size")).alias("bound"))
    return goal.join(ends.select("m_source", F.col("m_bucket").alias("end_bucket")), "m_source", "left").join(bound, "m_source", "left").drop("rest")


def apply(rows: DataFrame, made: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with source size, target and ``copies``, how many times the mix takes the document."""
    made = common.checkpointed(made)
    if made.count() <= BROADCAST_SOURCES:
        both = rows.join(F.broadcast(made), "m_source")
    else:
        salted = made.withColumn("m_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = rows.withColumn("m_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(salted, ["m_source", "m_salt"]).drop("m_salt")
    me = F.struct("m_key", F.col(id_col).alias("id"), "m_size")
    picked = F.coalesce(F.when(F.col("m_bucket") < F.col("end_bucket"), True).when(F.col("m_bucket") == F.col("end_bucket"), me <= F.col("bound")), F.lit(False))
    return both.withColumn("copies", F.col("epochs") + picked.cast("long")).drop("epochs", "end_bucket", "bound")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: float = 2, quality: Column | None = None) -> DataFrame:
    """The mix's decisions: id, ``size``, ``source``, ``source_size``, ``target``, ``copies`` and ``taken`` words.

    The texts are read once; sizes and keys are kept in the shared folder.
    """
    narrow = keyed(docs.select(id_col, source_col, text_col), id_col, source_col, text_col, quality).drop(text_col)
    rows = common.checkpointed(narrow)
    return apply(rows, decisions(rows, id_col, share, weights, most), id_col).select(id_col, source_col, F.col("m_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("m_size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: float = 2, quality: Column | None = None) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken. The texts are not shuffled."""
    rest, unpack = common.packed(docs, id_col, source_col, text_col)
    rows = keyed(rest, id_col, source_col, text_col, quality)
    narrow = common.checkpointed(rows.select(id_col, "m_source", "m_size", "m_key", "m_bucket"))
    taken = apply(rows, decisions(narrow, id_col, share, weights, most), id_col)
    return taken.withColumn("m_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(unpack)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln(((('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT) + 0.5) / 4503599627370496.0::DOUBLE)
      / CASE WHEN text IS NULL THEN 1.0::DOUBLE ELSE greatest(0.1::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) / greatest(length(text), 1)) END AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT first(level ORDER BY ratio, source NULLS LAST) AS level FROM l WHERE ratio > level),
t AS (SELECT source, source_size, CASE WHEN f.level IS NULL OR weight * f.level >= cap THEN cap ELSE weight * f.level END AS target FROM l LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
c AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
    2 * sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS middle
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN middle <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
