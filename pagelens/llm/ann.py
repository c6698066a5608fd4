"""Approximate nearest neighbours by cosine with a permutation index.

A vector is represented by its ``length`` nearest pivots in order. It is posted, with that order, in the
inverted files of its first ``files`` pivots; a query visits the files of its own first ``visits`` pivots.
In a file the rows are ranked by the footrule distance of both orders, and those within a limit are
reranked by exact cosines in double precision. A row that a query may meet in several files counts in the
one whose pivot is nearest to the query, so nothing is found twice.

Pivots (about four times the root of the number of rows, at most ``MOST_PIVOTS``), the number of visits and
the limit are fitted on a bounded sample (``sample`` rows with the least id hashes): both together lose
about ``miss`` of the sample's true neighbours. Every row is indexed. Files and their visitors are split so
that at most ``GROUP`` of either meet in a task; rows and queries meet by a join on the pivot, and only
the sizes of the files come to the driver. No list of candidates is cut: a file with fewer than ``k`` rows
within the limit offers its ``k`` nearest by footrule, and a query that finds fewer than ``k`` rows visits
every file.

Vectors that are null, empty, zero, hold null or non-finite components or have another length than most
take no part. They are scaled by a power of two before squaring, so tiny and huge components neither
vanish nor overflow. Ties go to the smaller id; rows with equal ids and vectors are each a candidate, none
for its own id. A query id that several rows ask with is answered for all of them together. Extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm import common

SAMPLE_BYTES = 32 << 20
MOST_PIVOTS = 2048
BLOCK_ROWS = 4096
#: Rows of a file, and visitors of it, that meet in one task.
GROUP = 4096
#: Pairs of a row and a query that are ranked at once.
PAIRS = 1 << 19


@dataclass
class Index:
    """Unit pivots, how many represent a vector, hold a row and are visited, and the least footrule similarity to rerank."""

    pivots: np.ndarray
    length: int
    files: int
    visits: int = 1
    least: float = 0.0

    def order(self, unit: np.ndarray, most: int) -> np.ndarray:
        """Nearest pivots of each row, in order."""
        return np.argsort(-(unit @ self.pivots.T), axis=1, kind="stable")[:, :most].astype(np.uint16)

    def places(self, order: np.ndarray) -> np.ndarray:
        """For each row the place of every pivot; ``length`` for those that do not represent it."""
        out = np.full((len(order), len(self.pivots)), self.length, np.int16)
        out[np.arange(len(order))[:, None], order[:, : self.length]] = np.arange(self.length)
        return out

    def similarity(self, places: np.ndarray, order: np.ndarray) -> np.ndarray:
        """``length * (length + 1)`` less the footrule distance of rows and queries, absent pivots counting as place ``length``."""
        out = np.zeros((len(places), len(order)), np.int32)
        for i in range(self.length):
            out += 2 * (self.length - np.maximum(places[:, order[:, i]], i))
        return out


def usable(vector: Column) -> Column:
    """Non-null, non-empty, all components present and finite, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to 0.5..1: no cosine changes."""
    _, exponent = np.frexp(np.abs(x).max(1, initial=0.0))
    return np.ldexp(x, -exponent[:, None])


def norms(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * x[:, j]
    return np.sqrt(total)


def cosines(rows: np.ndarray, queries: np.ndarray, row_norms: np.ndarray, query_norms: np.ndarray) -> np.ndarray:
    """Of each row with its query: dot products summed component by component, so that equal vectors always score alike."""
    total = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        total += rows[:, j] * queries[:, j]
    return total / (row_norms * query_norms)


def fit(x: np.ndarray, pivots: int = 128, length: int = 32, files: int = 4, k: int = 5, miss: float = 0.05, queries: int = 256) -> Index:
    """Pivots are the first distinct rows of the sample; visits and limit are set by the neighbours that others of its rows have.

    Rows that are pivots themselves would find their neighbours too easily, so they are only asked where the
    sample has few others.
    """
    x = scaled(x)
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    unit = x / norms(x)[:, None]
    n = min(pivots, len(x))
    index = Index(unit[:n], min(length, n), min(files, n))
    asked = np.arange(n if len(x) - n >= 64 else 0, len(x))
    every, reach, kept = index.order(unit[asked], n), [], []
    places = index.places(every)
    for q in range(min(queries, len(asked))):
        near = unit[asked] @ unit[asked[q]]
        near[q] = -np.inf
        top = np.argpartition(-near, min(k, len(asked)) - 1)[:k]
        top = top[top != q]
        at = np.empty(n, np.int64)
        at[every[q]] = np.arange(n)
        reach.append(at[every[top, : index.files]].min(1))
        kept.append(index.similarity(places[top], every[q : q + 1])[:, 0])
    if len(x) > 1:
        index.visits = int(np.ceil(np.quantile(np.concatenate(reach), 1 - miss / 2))) + 1
        index.least = float(np.floor(np.quantile(np.concatenate(kept), miss / 2)))
    return index


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def _unpacked(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def search_file(index: Index, pivot: int, ids: np.ndarray, x: np.ndarray, order: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, q_order: np.ndarray, k: int):
    """The file's ``k`` best rows for each query: query id, row id, score."""
    size, q_size = norms(x), norms(queries)
    unit, places, posted = x / size[:, None], index.places(order), order[:, : index.files].astype(np.int64)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, PAIRS // len(x))
    for start in range(0, len(queries), step):
        some = slice(start, start + step)
        q, q_ids, near = queries[some], query_ids[some], q_order[some]
        at = np.full((len(q), len(index.pivots)), len(index.pivots), np.int16)
        at[np.arange(len(q))[:, None], near] = np.arange(near.shape[1])
        # of the files in which both meet, this is the query's first
        here = np.full((len(x), len(q)), True)
        for j in range(posted.shape[1]):
            here &= at[:, posted[:, j]].T >= at[:, pivot]
        here &= ids[:, None] != q_ids[None]
        like = np.where(here, index.similarity(places, near), -1)
        limit = np.minimum(index.least, np.partition(like, -k, axis=0)[-k]) if len(x) > k else np.zeros(len(q))
        rough = np.where(here & (like >= limit), unit @ (q / q_size[some, None]).T, -np.inf)
        if len(x) > k:  # what could still tie for the last place stays
            rough[rough < np.partition(rough, -k, axis=0)[-k] - 1e-9] = -np.inf
        c, r = np.nonzero(np.isfinite(rough.T))
        score = cosines(x[r], q[c], size[r], q_size[some][c])
        best = np.lexsort((ids[r], -score, c))
        c, r, score = c[best], r[best], score[best]
        best = np.arange(len(c)) - np.searchsorted(c, c) < k
        out.append((q_ids[c[best]], ids[r[best]], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def search(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, sample: int = 4096, miss: float = 0.05) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each row that meets ``queries``."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes or not sizes[0]["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes[0]["dim"], sizes[0]["n"]
    rows = rows.where(F.size("v") == dim)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(min(sample, SAMPLE_BYTES // (8 * dim) + 1)).select("v").collect()
    pivots = min(MOST_PIVOTS, 1 << int(np.ceil(np.log2(max(64, 4 * np.sqrt(n))))))
    index = fit(np.array([r["v"] for r in drawn], float), pivots, k=k, miss=miss)
    shared = spark.sparkContext.broadcast(index)

    def batches_of(batches):
        for b in batches:
            for start in range(0, b.num_rows, BLOCK_ROWS):
                some = b.slice(start, BLOCK_ROWS)
                x = _matrix(some.column(1), dim)
                yield some.column(0).to_numpy(), x, x / norms(x)[:, None], some.column(2).to_numpy(zero_copy_only=False)

    def count(batches):
        index, total = shared.value, None
        for _, _, unit, asks in batches_of(batches):
            order = index.order(unit, max(index.files, index.visits))
            new = np.stack([np.bincount(order[:, : index.files].ravel(), minlength=len(index.pivots)), np.bincount(order[asks, : index.visits].ravel(), minlength=len(index.pivots))])
            total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1], dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], ["pivot", "n", "q"])

    held = rows.mapInArrow(count, "pivot int, n long, q long").groupBy("pivot").agg(F.sum("n").alias("n"), F.sum("q").alias("q")).collect()
    splits = np.ones((2, len(index.pivots)), np.int64)
    for r in held:
        splits[:, r["pivot"]] = -(-r["n"] // GROUP) or 1, -(-r["q"] // GROUP) or 1

    def sent(df: DataFrame, side: int, visits: int, splits: np.ndarray) -> DataFrame:
        """Rows (side 0) to their files, queries (side 1) to the files that they visit: dealt on their own side, repeated for each part of the other."""

        def run(batches):
            index = shared.value
            for ids, x, unit, _ in batches_of(batches):
                order = index.order(unit, index.length if side == 0 else max(visits, index.length))
                to = order[:, : index.files if side == 0 else visits].astype(np.int64)
                row, pivot = np.repeat(np.arange(len(ids)), to.shape[1]), to.ravel()
                own = (common.mix(ids.astype(np.uint64))[row] % splits[side, pivot].astype(np.uint64)).astype(np.int64)
                again = splits[1 - side, pivot]
                row, pivot, own = np.repeat(row, again), np.repeat(pivot, again), np.repeat(own, again)
                other = np.arange(len(row)) - np.repeat(np.cumsum(again) - again, again)
                parts = (own, other) if side == 0 else (other, own)
                for a in range(0, len(row), BLOCK_ROWS):
                    some = slice(a, a + BLOCK_ROWS)
                    r = row[some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pivot[some], pa.int32()), pa.array(parts[0][some], pa.int32()), pa.array(parts[1][some], pa.int32()), pa.array(ids[r], pa.int64()), pa.array([x[i].tobytes() for i in r], pa.binary()), pa.array([order[i].tobytes() for i in r], pa.binary())],
                        ["pivot", "part", "visit", "id", "v", "places"],
                    )

        return df.mapInArrow(run, "pivot int, part int, visit int, id long, v binary, places binary")

    def meet(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if rows.num_rows and asked.num_rows:
            sides = [(t["id"].to_numpy(), _unpacked(t["v"], np.float64), _unpacked(t["places"], np.uint16)) for t in (rows, asked)]
            found = search_file(shared.value, key[0].as_py(), *sides[0], *sides[1], k)
        return pa.table({name: pa.array(x) for name, x in zip(("query_id", "vec_id", "score"), found)})

    def met(asked: DataFrame, visits: int, splits: np.ndarray) -> DataFrame:
        keys = ["pivot", "part", "visit"]
        return sent(rows, 0, visits, splits).groupBy(*keys).cogroup(sent(asked, 1, visits, splits).groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")

    asked = rows.where("asks")
    found = common.checkpointed(met(asked, index.visits, splits))
    if index.visits < len(index.pivots):
        enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        short = common.checkpointed(asked.join(enough, asked["id"] == enough["query_id"], "left_anti"))
        left = short.count()
        if left:
            found = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti")
            found = found.unionByName(met(short, len(index.pivots), np.stack([splits[0], np.full(len(index.pivots), -(-left // GROUP))])))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_permutation_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
