"""Quality rules: fixed rules on counts, then a calibrated logistic regression on hashed n-grams.

The model reads the relative frequency of hashed words, word pairs and byte 3- and 5-grams of the
whole text. It is fitted on the driver on a bounded sample of labelled rows (``max_train_rows`` rows
of at most ``max_train_chars`` characters, the least hashes of the id), its logits are calibrated by
Platt scaling on a held-out fifth, and each document is scored in Arrow batches. Without labelled
rows of both classes there is no verdict and the fixed rules decide alone.

Null texts have no words and are rejected by the rule on length. Repeated ids are scored row by row.
Other columns of the input are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.llm import common

BUCKETS = 1 << 12
FAMILIES = 4
MIN_WORDS = 20
MAX_REPEATED = 30
REPEAT_WINDOW = 8
KEEP_AT = 0.5
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_GRAM = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


@dataclass
class Model:
    """Weights by family and bucket, an intercept, and the line that calibrates the logit."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0


def ngrams(data: np.ndarray, at: np.ndarray, words: common.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By family: the row of each n-gram and its bucket."""
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    yield words.row, (words.hash >> shift).astype(np.int64)
    start, pair = words.windows(2)
    yield words.row[start], (pair >> shift).astype(np.int64)
    wide = data.astype(np.uint64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for k in (3, 5):
        n = len(data) - k + 1
        if n <= 0:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h += (wide[j : j + n] + np.uint64(1)) * _GRAM[j]
        h *= _GRAM[0]
        whole = row[:n] == row[k - 1 :]
        yield row[:n][whole], (h[whole] >> shift).astype(np.int64)


def logits(model: Model, data: np.ndarray, at: np.ndarray, words: common.Words) -> np.ndarray:
    n, out = len(at) - 1, np.full(len(at) - 1, model.bias)
    for weight, (row, bucket) in zip(model.weights, ngrams(data, at, words), strict=True):
        count = np.bincount(row, minlength=n)
        out += np.bincount(row, weight[bucket], minlength=n) / np.maximum(count, 1)
    return out


def frequencies(texts: list[str]) -> np.ndarray:
    """A dense row of relative n-gram frequencies for each text, scaled so that a unit weight matters."""
    out = np.zeros((len(texts), FAMILIES, BUCKETS), np.float32)
    for i, text in enumerate(texts):
        data, at = common.utf8(pa.array([text], pa.string()))
        for f, (row, bucket) in enumerate(ngrams(data, at, common.Words(data, at))):
            out[i, f] = np.bincount(bucket, minlength=BUCKETS) / max(1, len(row))
    return out.reshape(len(texts), -1)


def _descend(x: np.ndarray, y: np.ndarray, balance: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by accelerated gradient steps, in single precision as ``x`` is large."""
    y, balance = y.astype(np.float32), balance.astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    pw, pb = w.copy(), b
    v = np.full(x.shape[1], 1 / np.sqrt(x.shape[1]), np.float32)
    for _ in range(20):  # power iteration for the step length
        v = x.T @ (balance * (x @ v))
        v /= np.linalg.norm(v) + np.float32(1e-12)
    rate = np.float32(1.0 / (0.25 * float((balance * (x @ v) ** 2).sum()) + 0.25 * float(balance.sum()) + l2))
    l2 = np.float32(l2)
    for i in range(steps):
        m = np.float32(i / (i + 3))
        yw, yb = w + m * (w - pw), b + m * (b - pb)
        pw, pb = w, b
        g = balance * (1 / (1 + np.exp(-np.clip(x @ yw + yb, -50, 50))) - y)
        w, b = yw - rate * (x.T @ g + l2 * yw), yb - rate * g.sum()
    return w.astype(np.float64), float(b)


def fit(texts: list[str], good: np.ndarray, l2: float = 1e-4, steps: int = 300, scale: float = 40.0) -> Model | None:
    """A calibrated model, or None unless both classes have at least five rows."""
    good = np.asarray(good, float)
    if min(good.sum(), len(good) - good.sum()) < 5:
        return None
    held = np.arange(len(good)) % 5 == 0
    if min(good[held].sum(), (1 - good[held]).sum()) < 1:
        held[:] = False
    order = np.argsort(held, kind="stable")  # the held-out rows last, so that both parts are views
    x, good, n = frequencies([texts[i] for i in order]), good[order], int((~held).sum())
    x *= np.float32(scale)
    xs, y = x[:n], good[:n]
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, b = _descend(xs, y, balance, l2, steps)
    model = Model((w * scale).reshape(FAMILIES, BUCKETS), b)
    if held.any():
        z, t = (x[n:] @ w.astype(np.float32)).astype(np.float64) + b, good[n:]
        # Platt's targets keep the slope finite where the held-out rows are separated
        t = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
        slope, shift = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -50, 50)))
            g = np.array([((p - t) * z).sum(), (p - t).sum()]) + 1e-6 * np.array([slope, shift])
            s = p * (1 - p) + 1e-6
            h = np.array([[(s * z * z).sum(), (s * z).sum()], [(s * z).sum(), s.sum()]]) + 1e-6 * np.eye(2)
            slope, shift = np.array([slope, shift]) - np.linalg.solve(h, g)
        if slope > 0:
            model.slope, model.shift = float(slope), float(shift)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train_rows: int = 2000, max_train_chars: int = 20_000) -> Model | None:
    """Fit on at most ``max_train_rows`` labelled rows; rows with a null or an over-long text are not drawn.

    The sample is drawn from the ids of ``labels`` alone, twice the rows that are needed; only those
    rows of ``docs`` leave the executors.
    """
    spark = docs.sparkSession
    drawn = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).dropna().where("y in (0, 1)").groupBy("i").agg(F.min("y").alias("y"))
    drawn = drawn.orderBy(F.xxhash64("i"), "i").limit(2 * max_train_rows).collect()
    if not drawn:
        return None
    few = spark.createDataFrame(drawn, drawn_schema(labels, id_col))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull() & (F.length("t") <= max_train_chars)).join(F.broadcast(few), "i").orderBy(F.xxhash64("i"), "i", "t").limit(max_train_rows).collect()
    return fit([r["t"] for r in rows], np.array([r["y"] for r in rows]))


def drawn_schema(labels: DataFrame, id_col: str) -> str:
    return f"i {labels.schema[id_col].dataType.simpleString()}, y int"


def measure(data: np.ndarray, at: np.ndarray, words: common.Words) -> dict[str, np.ndarray]:
    """The counts that the fixed rules read, by row."""
    n = len(at) - 1
    n_words = np.diff(words.first)
    head = (data & 0xC0) != 0x80
    start, h = words.windows(REPEAT_WINDOW)
    key = common.mix(h + words.row[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    repeated = common.covered(start[count[back] > 1], REPEAT_WINDOW, len(words.start)) if len(start) else np.zeros(len(words.start), bool)
    cut = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], cut + 1]))
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data))[: len(begin)]
    end = end - ((end > begin) & (data[np.maximum(end, 1) - 1] == 10))
    with_word = np.concatenate([[0], np.cumsum(words.inside)])
    full = with_word[end] > with_word[begin]
    begin, end = begin[full], end[full]
    row = np.searchsorted(at, begin, "right") - 1
    line = common.span_hash(common.prefix(common.byte_codes(data)), begin, end)
    _, first = np.unique(common.mix(line + row.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), return_index=True)
    lines = np.bincount(row, minlength=n)
    return {
        "n_words": n_words,
        "word_chars": common.per_row(head & words.inside, at),
        "n_symbols": common.per_row(_SYMBOL[data], at),
        "n_dup_lines": lines - np.bincount(row[first], minlength=n),
        "n_repeat_words": np.bincount(words.row[repeated], minlength=n),
    }


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """``docs`` with the rules' counts, ``base_failed``, the calibrated ``quality`` and ``kept``; input columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in T.StructType.fromDDL(SCHEMA)]
    rest, unpack = common.carried(docs, text_col, tuple(names))

    def run(batches):
        model = shared.value
        for b in common.blocks(batches, "text_"):
            data, at = common.utf8(b.column("text_"))
            words = common.Words(data, at)
            m = measure(data, at, words)
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])
            p = np.ones(b.num_rows) if model is None else 1 / (1 + np.exp(-np.clip(model.slope * logits(model, data, at, words) + model.shift, -50, 50)))
            new = [pa.array(m[k].astype(np.int64)) for k in names[:5]]
            new += [pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_at))]
            yield pa.RecordBatch.from_arrays([b.column("rest_"), b.column("text_"), *new], ["rest_", "text_", *[f"{n}_" for n in names]])

    added = T.StructType([T.StructField(f"{f.name}_", f.dataType) for f in T.StructType.fromDDL(SCHEMA)])
    made = rest.mapInArrow(run, T.StructType([*rest.schema.fields, *added.fields]))
    return made.select(*unpack, *[F.col(f"{n}_").alias(n) for n in names])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, common.read(spark, sf_dir, "labels")))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that neither the rules nor the model reject."""
    model = train(docs, common.read(spark, sf_dir, "labels"))
    rest, unpack = common.packed(docs, "text")
    return score(rest, model).where("kept").select(unpack)
