"""What the operators of this subpackage share: reading, Arrow blocks, rolling hashes and links."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java and RE2 character class of the contracts' words; its complement is what bytes.split() splits on.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy pass holds, so that a Python worker stays small.
BLOCK_BYTES = 1 << 21
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240607)
_BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def named(column: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, *keep: str) -> tuple[DataFrame, list]:
    """``df`` with all but the kept columns in one struct, and the expressions that restore it.

    Columns that an operator adds can then not clash with the input's own.
    """
    others = [c for c in df.columns if c not in keep]
    rest = F.struct(*[named(c) for c in others]) if others else F.lit(True)
    return df.select(*keep, rest.alias("rest_")), [named(c) if c in keep else F.col("rest_").getField(c).alias(c) for c in df.columns]


def small_batches(spark: SparkSession) -> None:
    """Texts cross to Python at most ``ARROW_ROWS`` rows or about ``ARROW_BYTES`` at a time, so that neither side holds tens of MB of them.

    Settings of the session; those that are already smaller stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def carried(df: DataFrame, text: str, replaced: tuple[str, ...]) -> tuple[DataFrame, list]:
    """``(rest_, text_)`` of ``df``, and the expressions that restore its columns from them.

    Columns named like one of ``replaced``, in any case, as Spark reads names, are left out: what an operator adds takes their place.
    """
    small_batches(df.sparkSession)
    rest, unpack = packed(df, text)
    gone = {name.lower() for name in replaced}
    unpack = [(named("text_").alias(name) if name == text else c) for c, name in zip(unpack, df.columns) if name.lower() not in gone]
    return rest.select("rest_", named(text).alias("text_")), unpack


def schema_with(fields: list[T.StructField], added: str) -> T.StructType:
    """The fields, whatever their names, and those of a DDL string."""
    return T.StructType([*fields, *T.StructType.fromDDL(added).fields])


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor costs no lineage.

    The folder is the session's ``spark.checkpoint.dir``; a temporary one is set only where there is
    none and the master is local, as in tests on one machine.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pagelens-checkpoint-"))
    return df.checkpoint(eager=True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and where each row starts (one more than rows)."""
    column = column.fill_null("") if column.null_count else column
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text each, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            stop = min(stop, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def _powers(n: int, base: np.uint64, name: str) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n > 4 * BLOCK_BYTES:
            return have
        _POWERS[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def prefix(codes: np.ndarray) -> np.ndarray:
    """Running polynomial sums modulo 2**64, one more than codes, for :func:`span_hash`."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _powers(len(codes), _BASE, "up"), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the spans ``codes[start:stop]`` from their running sums; equal spans hash alike."""
    down = _powers(len(sums), _BASE_INV, "down")
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODE[data]


class Words:
    """The words of a block of texts: where they start and stop in ``data``, their row and hash."""

    def __init__(self, data: np.ndarray, at: np.ndarray, sums: np.ndarray | None = None):
        inside = np.empty(len(data) + 1, bool)
        inside[:-1] = ~_SPACE[data]
        inside[-1] = False
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = at[:-1][at[:-1] < len(data)]
        begins[edge] = inside[edge]
        ends = inside[:-1] & ~inside[1:]
        last = at[1:][at[1:] > 0] - 1
        ends[last] = inside[last]
        self.start = np.flatnonzero(begins[:-1])
        self.stop = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        self.inside = inside[:-1]
        self.hash = span_hash(prefix(byte_codes(data)) if sums is None else sums, self.start, self.stop)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start (index of a word) and hash of each run of ``k`` words within one row."""
        n = len(self.start)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[: n - k + 1] == self.row[k - 1 :])
        return at, span_hash(prefix(self.hash), at, at + k)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in one of the runs of ``width`` that begin at ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return np.cumsum(change[:-1]) > 0


def per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring offsets."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of each node of the undirected ``links(a, b)``; the component is its least node.

    Alternates large-star and small-star steps, each a shuffle by node with map-side minima, so no
    component is gathered in one task: after the first step a node keeps only links to smaller nodes.
    Each round is checkpointed. Links with a null end are ignored, loops and repeats are harmless.
    """
    edges = checkpointed(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    total = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = checkpointed(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == total:
            break
        total = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
