"""Token statistics and vector blocks in long form ``(id, token, value)``; strings stay beside their numbers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of words that are counted together.
CHUNK_BYTES = 4 << 20


def token_counts(df: DataFrame, key: str, tokens: Column, cap: int = 32767) -> DataFrame:
    """How often each token occurs in each row."""
    return df.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.least(F.count("*"), F.lit(cap)).alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("token").agg(F.count("*").alias("df"))


def banded(frequency: DataFrame, n: int, least: int = 1, most: float = 1.0) -> DataFrame:
    """The tokens in the band, with ``idf``."""
    high = max(least, int(n * most)) if most < 1 else n
    return frequency.where(F.col("df").between(least, high)).withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1)


def vocabulary(frequency: DataFrame, n: int, least: int = 1, most: float = 1.0, size: int | None = None) -> DataFrame:
    """``token, df, idf`` of the tokens in the band, the most frequent ``size`` of them with their column ``col``.

    The band's upper end is a share of ``n`` below 1. Columns are numbered by falling df, then token.
    """
    kept = banded(frequency, n, least, most)
    if size is not None:  # the top rows only are numbered in one task
        kept = kept.orderBy(F.desc("df"), "token").limit(size)
        return kept.withColumn("col", F.row_number().over(Window.orderBy(F.desc("df"), "token")) - 1)
    # without a size: numbered within each df and moved up by the tokens of greater ones
    per = kept.groupBy("df").agg(F.count("*").alias("c_"))
    per = per.select("df", (F.sum("c_").over(Window.orderBy(F.desc("df"))) - F.col("c_")).alias("b_"))
    inside = Window.partitionBy("df").orderBy("token")
    return kept.join(per, "df").withColumn("col", F.row_number().over(inside) + F.col("b_") - 1).drop("b_").select("token", "df", "idf", "col")


def tfidf(counts: DataFrame, vocab: DataFrame, key: str, binary: bool = False, sublinear: bool = True, l2: bool = True) -> DataFrame:
    """``key, token, value``; tokens outside the vocabulary have no value, rows have unit length."""
    tf = F.lit(1.0) if binary else (1 + F.log(F.greatest(F.col("tf"), F.lit(1)))) if sublinear else F.col("tf").cast("double")
    out = counts.join(vocab.select("token", "idf"), "token").select(key, "token", (tf * F.col("idf")).alias("value"))
    return unit_rows(out, key) if l2 else out


def unit_rows(values: DataFrame, key: str) -> DataFrame:
    """Values divided by the length of their row, in one exchange by row."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(key)))
    return values.withColumn("value", F.when(norm > 0, F.col("value") / norm).otherwise(0.0))


def word_tfidf(df: DataFrame, key: str, words: Column, least: int = 3, most: float = 0.9, size: int | None = 100_000) -> DataFrame:
    """``key, token, value`` of single words and word pairs: banded vocabulary, sublinear, unit rows."""
    return fitted(df, key, words, _words_and_pairs, least, most, size)


def char_tfidf(df: DataFrame, key: str, text: Column, low: int = 3, high: int = 5, least: int = 3, size: int | None = 150_000) -> DataFrame:
    """``key, token, value`` of character n-grams of padded words; without a size of all that ``least`` rows have."""
    return fitted(df, key, split_words(text), _Grams(low, high), least, 1.0, size)


def fitted(df: DataFrame, key: str, words: Column, tokens: Callable[[list[str]], Iterable[str]], least: int, most: float, size: int | None, cap: int = 32767, top: int | None = None) -> DataFrame:
    """``key, token, value``: sublinear tf-idf in rows of unit length of the ``tokens`` that Python makes of a row's words, which hold no blanks.

    Words are dealt by key into chunks, once; a chunk sends how many of its rows have each token and gets back
    the idf of those in the vocabulary, so the counts of single rows are never shuffled. A vocabulary of
    ``size`` tokens goes to all tasks. With ``top`` rows keep only values that may round to their first ``top`` at six digits.
    """
    spark = df.sparkSession
    n, total = df.agg(F.count("*"), F.sum(F.octet_length(F.array_join(words, " ")))).first()
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // CHUNK_BYTES))
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.array_join(words, " "), F.lit("")).alias("words"), F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int").alias("chunk"))
    kind, kinds = df.schema[key].dataType, pa.schema([("token", pa.string()), ("value", pa.float64())])

    def counted(table: pa.Table) -> Iterator[tuple[int, Counter]]:
        """The first of a key's rows and the counts of all of them."""
        table = table.append_column("at", pa.array(np.arange(table.num_rows))).sort_by("key")
        keys, at, last = table["key"].to_pylist(), table["at"].to_pylist(), None
        for i, some in enumerate(table["words"].to_pylist()):
            found = Counter(tokens(some.split(" ") if some else []))
            if last is not None and keys[i] == keys[i - 1]:
                last[1].update(found)
                continue
            if last is not None:
                yield last
            last = (at[i], found)
        if last is not None:
            yield last

    def sent(table: pa.Table) -> pa.Table:
        frequency: Counter = Counter()
        for _, found in counted(table):
            frequency.update(found.keys())
        chunk = table["chunk"][0].as_py()
        return pa.table({"chunk": pa.array([chunk] * len(frequency), pa.int32()), "token": pa.array(list(frequency), pa.string()), "n": pa.array(list(frequency.values()), pa.int64())})

    def valued(table: pa.Table, idf: dict[str, float]) -> pa.Table:
        at, sizes, parts = [], [], []
        for i, found in counted(table):
            kept = [t for t in found if t in idf]
            if not kept:
                continue
            tf = np.minimum(np.fromiter((found[t] for t in kept), np.float64, len(kept)), cap)
            value = (1 + np.log(tf)) * np.fromiter((idf[t] for t in kept), np.float64, len(kept))
            value /= np.sqrt((value * value).sum()) or 1.0
            if top is not None and len(value) > top:
                few = np.flatnonzero(value >= np.partition(value, -top)[-top] - 2e-6)
                kept, value = [kept[j] for j in few], value[few]
            at.append(i)
            sizes.append(len(kept))
            parts.append(pa.record_batch([pa.array(kept, pa.string()), pa.array(value)], schema=kinds))
        out = pa.Table.from_batches(parts, kinds)
        return out.add_column(0, key, table["key"].take(pa.array(np.repeat(np.array(at, np.int64), sizes))))

    schema = T.StructType([T.StructField(key, kind), T.StructField("token", T.StringType()), T.StructField("value", T.DoubleType())])
    counts = rows.groupBy("chunk").applyInArrow(sent, "chunk int, token string, n long")
    if size is not None:
        vocab = vocabulary(counts.groupBy("token").agg(F.sum("n").alias("df")), n, least, most, size)
        idf = {r["token"]: r["idf"] for r in vocab.select("token", "idf").collect()}
        return rows.groupBy("chunk").applyInArrow(lambda table: valued(table, idf), schema)
    all_of = counts.select(F.col("chunk").alias("to"), "token", F.sum("n").over(Window.partitionBy("token")).alias("df"))
    replies = banded(all_of, n, least, most).select("to", "token", "idf")

    def answered(table: pa.Table, replies: pa.Table) -> pa.Table:
        return valued(table, dict(zip(replies["token"].to_pylist(), replies["idf"].to_pylist())))

    return rows.groupBy("chunk").cogroup(replies.groupBy("to")).applyInArrow(answered, schema)


def _words_and_pairs(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


class _Grams:
    """Character n-grams of words padded by a blank on either side; those of short words are remembered."""

    def __init__(self, low: int, high: int):
        self.low, self.high, self.known = low, high, {}

    def __call__(self, words: list[str]) -> Iterable[str]:
        return chain.from_iterable(map(self.of, words))

    def of(self, word: str) -> list[str]:
        found = self.known.get(word)
        if found is None:
            w = f" {word} "
            found = [w[i : i + n] for n in range(self.low, self.high + 1) for i in range(len(w) - n + 1)]
            if len(word) < 20 and len(self.known) < 50_000:
                self.known[word] = found
        return found


def vocabulary_tfidf(df: DataFrame, key: str, words: Column, known: list[str]) -> DataFrame:
    """``key, token, value`` over a given vocabulary: raw counts, smooth idf, unit rows. Repeated words of it count once."""
    counts = token_counts(df, key, F.filter(words, lambda w: w.isin(*dict.fromkeys(known))))
    n = df.count()
    return tfidf(counts, document_frequency(counts).withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1), key, sublinear=False)


def split_words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of words padded by a blank on either side."""
    padded = F.transform(split_words(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = [F.flatten(F.transform(padded, _cut(n))) for n in range(low, high + 1)]
    return F.concat(*grams)


def _cut(n: int):
    return lambda w: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def word_ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` words joined by blanks. The words are bound once; inside the inner lambda they would be computed again for each run."""
    none = F.array().cast("array<string>")
    cut = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(none)
    return F.element_at(F.transform(F.array(words), cut), 1)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def standardised(df: DataFrame, columns: list[str], weight: float = 1.0, clip: float = 8.0, log: bool = True) -> DataFrame:
    """Columns as clipped z-scores of their signed logs, population deviation, times ``weight``."""
    x = {c: signed_log(F.col(c).cast("double")) if log else F.col(c).cast("double") for c in columns}
    stats = df.agg(*[f(x[c]).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    wide = df.crossJoin(F.broadcast(stats))
    for c in columns:
        sigma = F.when(F.col(f"{c}_s") < 1e-6, 1.0).otherwise(F.col(f"{c}_s"))
        wide = wide.withColumn(c, F.greatest(F.lit(-clip), F.least(F.lit(clip), (x[c] - F.col(f"{c}_m")) / sigma)) * weight)
    return wide.select(df.columns)


def minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1; constant ones to 0."""
    stats = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))])
    wide = df.crossJoin(F.broadcast(stats))
    for c in columns:
        wide = wide.withColumn(c, F.when(F.col(f"{c}_hi") > F.col(f"{c}_lo"), (F.col(c) - F.col(f"{c}_lo")) / (F.col(f"{c}_hi") - F.col(f"{c}_lo"))).otherwise(0.0))
    return wide.select(df.columns)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def mean_vectors(df: DataFrame, by: str, vector: str) -> DataFrame:
    """``by, pos, mean``: component-wise means in long form."""
    return df.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def entropy(counts: DataFrame, by: str, n: str) -> DataFrame:
    """Shannon entropy in bits of the counts of each group."""
    total = counts.groupBy(by).agg(F.sum(n).alias("total"))
    p = F.col(n) / F.col("total")
    return counts.join(total, by).groupBy(by).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def token_id(token: Column) -> Column:
    """A 60-bit id that other engines can reproduce."""
    return F.conv(F.substring(F.md5(token), 1, 15), 16, 10).cast("long")
