"""Byte-level BPE: encode texts to token ids by ranked merges, decode ids to bytes.

:func:`encode` runs in Arrow batches: the pattern splits the whole text, each distinct word's byte
array is folded by ranked merges once (and remembered), a document's ids are its words' ids in order,
and decoding concatenates the ids' binary pieces. :func:`fold_words` is the same fold as Spark
higher-order functions over a literal rank map; the README says why it is not the main path.

Defined cases: null texts count as empty: no ids, empty bytes; rows that repeat, whatever their ids, are
encoded row by row; an empty table gives an empty result; other columns, of any name, are carried along.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import common

#: Words that a worker remembers at once, in two generations.
MEMORY = 400_000
#: From this many bytes on, merges are kept in a heap.
LONG_WORD = 100
_HIGH = (1 << 31) - 1


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank of each byte string of a rank file (base64, space, rank)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def fold(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one word: again and again the leftmost pair of least rank is merged."""
    whole = ranks.get(word)
    if whole is not None:
        return (whole,)
    if len(word) >= LONG_WORD:
        return _fold_long(word, ranks)
    # where the parts begin, and the rank of each pair of neighbours
    get, cuts = ranks.get, list(range(len(word) + 1))
    pairs = [get(word[i : i + 2], _HIGH) for i in range(len(word) - 1)]
    while pairs:
        least = min(pairs)
        if least == _HIGH:
            break
        i = pairs.index(least)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(word[cuts[i] : cuts[i + 2]], _HIGH)
        if i:
            pairs[i - 1] = get(word[cuts[i - 1] : cuts[i + 1]], _HIGH)
    return tuple([ranks[word[a:b]] for a, b in zip(cuts, cuts[1:])])


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """As :func:`fold`, in n log n: a heap of pairs over a linked list of parts."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def rank(i: int) -> int:
        return ranks.get(word[i : end[after[i]]], _HIGH) if after[i] < n else _HIGH

    now = [rank(i) for i in range(n)]
    heap = [(r, i) for i, r in enumerate(now) if r < _HIGH]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or now[i] != r:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0:
                now[k] = rank(k)
                if now[k] < _HIGH:
                    heapq.heappush(heap, (now[k], k))
    return tuple([ranks[word[i : end[i]]] for i in range(n) if alive[i]])


def encode(docs: DataFrame, text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, decoded: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids array<int>`` and, if asked, ``decoded binary``, what the ids decode to; input columns of these names are replaced.

    Without ``keep_text`` the text column is left out, so that texts don't travel back from Python.
    """
    names = ["ids", *["decoded"] * decoded]
    shared = docs.sparkSession.sparkContext.broadcast((load_ranks(ranks_path or default_ranks()), pattern or default_pattern()))
    rest, unpack = common.carried(docs, text_col, (*names, *[text_col] * (not keep_text)))
    kept = ["rest_", *["text_"] * keep_text]

    def run(batches):
        ranks, split = shared.value
        pieces = dict((v, k) for k, v in ranks.items())
        find = regex.compile(split).findall
        # two generations: what is still in use when the young one is full lives on
        young: dict[str, tuple[int, ...]] = {}
        old: dict[str, tuple[int, ...]] = {}
        for b in common.blocks(batches, "text_"):
            each = []
            for text in b.column("text_").to_pylist():
                words = find(text) if text else []
                if new := set(words).difference(young):
                    if len(young) + len(new) > MEMORY // 2:
                        old, young = young, {}
                        new = set(words)
                    for w in new:
                        young[w] = old.get(w) or fold(w.encode(), ranks)
                each.append(list(chain.from_iterable(map(young.__getitem__, words))))
            at = np.zeros(len(each) + 1, np.int32)
            np.cumsum([len(x) for x in each], out=at[1:])
            flat = np.fromiter(chain.from_iterable(each), np.int32, at[-1])
            out = [pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
            if decoded:
                out.append(pa.array([b"".join(map(pieces.__getitem__, x)) for x in each], pa.binary()))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], *out], [*kept, *[f"{n}_" for n in names]])

    made = rest.mapInArrow(run, common.schema_with([rest.schema[n] for n in kept], "ids_ array<int>" + ", decoded_ binary" * decoded))
    return made.select(*unpack, *[F.col(f"{n}_").alias(n) for n in names])


def decode(rows: DataFrame, ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """``rows`` with ``decoded binary``: the concatenated pieces of the ids; null for null ids. An input column of that name is replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(load_ranks(ranks_path or default_ranks()))
    rest, unpack = common.carried(rows, ids_col, ("decoded",))

    def run(batches):
        pieces = {v: k for k, v in shared.value.items()}
        for b in batches:
            out = pa.array([None if x is None else b"".join(map(pieces.__getitem__, x)) for x in b.column("text_").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, out], [*b.schema.names, "decoded_"])

    return rest.mapInArrow(run, common.schema_with(rest.schema.fields, "decoded_ binary")).select(*unpack, F.col("decoded_").alias("decoded"))


def rank_map(ranks: dict[bytes, int], slots: int = 8192) -> Column:
    """The ranks as one literal: an array of small maps, as a map is searched from its start."""
    parts: list[dict[str, int]] = [{} for _ in range(slots)]
    for piece, rank in ranks.items():
        parts[zlib.crc32(piece) % slots][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(parts)), "array<map<string,int>>", {"maxStringLen": "100000000"})


def fold_words(words: DataFrame, word_col: str = "word", ranks_path: str | None = None, slots: int = 8192) -> DataFrame:
    """``words`` with ``ids array<int>``, by higher-order functions: a fold over byte arrays, one merge a step.

    A word that is a piece is done at once. The ranks of neighbouring parts are kept beside the parts: a
    merge looks up two new ones. Steps after the last merge leave the state as it is.
    """
    literal = rank_map(load_ranks(ranks_path or default_ranks()), slots)

    def rank(piece: Column) -> Column:
        return F.try_element_at(F.element_at(literal, (F.crc32(piece) % slots + 1).cast("int")), F.hex(piece))

    def pair(a: Column, b: Column) -> Column:
        return F.coalesce(rank(F.concat(a, b)), F.lit(_HIGH))

    def let(value: Column, body) -> Column:
        """``body`` of a value that is computed once."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def merged(acc: Column, least: Column) -> Column:
        parts, ranks = acc["parts"], acc["ranks"]

        def at(i: Column) -> Column:
            def with_piece(piece: Column) -> Column:
                none = F.array().cast("array<int>")
                left = F.when(i > 1, F.array(pair(F.element_at(parts, F.greatest(i - 1, F.lit(1))), piece))).otherwise(none)
                right = F.when(i + 2 <= F.size(parts), F.array(pair(piece, F.element_at(parts, F.least(i + 2, F.size(parts)))))).otherwise(none)
                before = F.slice(ranks, F.lit(1), F.greatest(i - 2, F.lit(0)))
                return F.struct(F.concat(F.slice(parts, F.lit(1), i - 1), F.array(piece), F.slice(parts, i + 2, F.size(parts))).alias("parts"), F.concat(before, left, right, F.slice(ranks, i + 2, F.size(parts))).alias("ranks"))

            return let(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1)), with_piece)

        return let(F.array_position(ranks, least).cast("int"), at)

    def step(acc: Column, _: Column) -> Column:
        return let(F.array_min(acc["ranks"]), lambda least: F.when(least < _HIGH, merged(acc, least)).otherwise(acc))

    raw = F.col(word_col).cast("binary")
    size = F.octet_length(raw)
    byte = lambda i: F.substring(raw, i, F.lit(1))
    start = F.struct(
        F.transform(F.sequence(F.lit(1), size), byte).alias("parts"),
        F.when(size > 1, F.transform(F.sequence(F.lit(1), size - 1), lambda i: pair(byte(i), byte(i + 1)))).otherwise(F.array().cast("array<int>")).alias("ranks"),
    )
    folded = F.aggregate(F.sequence(F.lit(1), size), start, step, lambda acc: F.transform(acc["parts"], rank))
    whole = rank(raw)
    return words.withColumn("ids", F.when(size == 0, F.array().cast("array<int>")).when(whole.isNotNull(), F.array(whole)).otherwise(folded))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, decoded=True, keep_text=False).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the token ids of each row that is left; null and repeated ids are kept as they are."""
    return encode(docs.select("doc_id", "text"), keep_text=False).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
