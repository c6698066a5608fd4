"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct 5-word shingles. Sets are ordered by estimated frequency (a sketch
of bounded size, counted over all shingles of all documents), rarest first. Two sets with a Jaccard
similarity of at least t share ``l`` tokens in their prefixes of ``n - ceil(t * n) + l`` tokens, for
every ``l``; each document lengthens its prefix, and so asks for more shared tokens, as long as that
lowers the estimated cost of its candidates.

1. One pass over the texts leaves ``(id, n, signature)`` and the sketch. Equal sets are one class from
   here on, so copies are neither posted nor compared. Texts too large for a sketch of all shingles get one
   of the frequent shingles alone, found by a second pass that counts each shingle by itself (:func:`frequent`).
2. Prefix tokens are posted in packed buckets. A token of few classes yields candidate pairs, counted
   over all tokens; a token of more than ``FEW`` classes yields a star, not its pairs.
3. Candidates that hang together are a family and meet, as texts, in one place, where they are linked
   exactly (:func:`exact`). Families above ``BLOCK_TOKENS`` are first compared with one leader after the
   other (:func:`peeled`); what is left of them meets in one place or in pairs of blocks.
4. Links make components.

Defined cases: null texts and texts without words have an empty set and no links; fewer than five words
are one shingle; rows with one id are one document with each of its texts; each text without an id is a
document of its own, whose id stays null and is less than all others (the least 2**48 numbers stand for
them); extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import common

WIDTH, SIMILAR = 5, 80
#: Bits of a shingle that tell its slot in the sketch, at least and at most, so that the sketch is 8 MB or less.
LEAST_BITS, MOST_BITS, SLOT_BLOCKS = 16, 23, 64
#: Bits up to which a sketch counts all shingles; texts that ask for more (above 50 MB) have each shingle counted by itself.
SKETCH_BITS = 20
#: Counts of a block of the sketch that are added up in one task.
FAN = 64
#: Blocks in which shingles are counted by 32 bits, and how many of them a task sorts at once.
COUNT_BLOCKS, COUNTED = 1 << 10, 1 << 21
#: Twice the logarithm of the count from which a shingle is frequent (8 rows), and the share of all slots that frequent ones may take.
LEAST_LEVEL, FULL = 6, 0.5
LEVELS = 4
#: Classes of a token up to which its pairs are candidates.
FEW = 24
#: Tokens of a family, or of a part of it, that meet in one task.
BLOCK_TOKENS = 8_000_000
#: Leaders that a larger family has at most.
ROUNDS = 8
#: Sets of a family above which a token they share is heavy.
HEAVY = 64
CHUNK_BYTES = 8 << 20
SALTS = 32
BLOCK = 1 << 20
NO_ID, NAMELESS = -(1 << 63), 1 << 48
_ROWS = 1 << 12
_LOW = np.uint64((1 << 52) - 1)
#: Bits of a sieve of ids, at least and at most (8 MB), bits for each id that is wanted, and bits of a row of it.
SIEVE_LEAST, SIEVE_MOST, SIEVE_EACH, SIEVE_ROW = 16, 26, 32, 12
#: Classes that a token of no noted frequency is expected to share by chance.
CHANCE = 0.1
#: Times the cost of scanning a posting that verifying a candidate takes.
VERIFY = 8.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of at most 4096 texts, 52 bits each, by text and value; and where each text's start."""
    data, at = common.utf8(column)
    words = common.Words(_LOWER[data], at)
    start, h = words.windows(width)
    row, n = words.row[start], np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        sums = common.prefix(words.hash)
        row = np.concatenate([row, short])
        h = np.concatenate([h, common.span_hash(sums, words.first[short], words.first[short + 1])])
    both = np.unique((row.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)))
    return both & _LOW, np.searchsorted(both >> np.uint64(52), np.arange(len(column) + 1).astype(np.uint64))


def _sliced(batches, text: str):
    for b in common.blocks(batches, text, BLOCK):
        for i in range(0, b.num_rows, _ROWS):
            yield b.slice(i, _ROWS)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)


def _signatures(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two numbers; equal sets have equal ones."""
    out = []
    for salt in (np.uint64(0x632BE59BD9B4E019), np.uint64(0xD1B54A32D192ED03)):
        sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(common.mix(tokens ^ salt), out=sums[1:])
        out.append(common.mix(sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out[0], out[1]


def slot_bits(total: int) -> int:
    """Bits of the slots for texts of ``total`` bytes: a slot for 4 to 8 shingles, as far as the limit allows."""
    return min(MOST_BITS, max(LEAST_BITS, (total // 24).bit_length() - 1))


def crowded(total: int) -> bool:
    """Whether texts of ``total`` bytes have too many shingles for a sketch of all of them.

    Slots could tell frequent ones up to ``MOST_BITS``; the limit is lower, so that what counting costs grows with the texts and has no step at 400 MB.
    """
    return (total // 24).bit_length() - 1 > min(SKETCH_BITS, MOST_BITS)


def surveyed(rows: DataFrame, width: int, bits: int | None) -> DataFrame:
    """``(id, row, n, s1, s2)`` of every row and, as rows with ``part``, each task's counts of its shingles; without ``bits`` none."""
    names = ["id", "row", "n", "s1", "s2", "part"]
    schema = "id long, row long, n long, s1 long, s2 long, part binary"

    def run(batches):
        counts = np.zeros(1 << bits if bits else 0, np.uint16)  # of one task; what is counted more often is as heavy
        for b in _sliced(batches, "text"):
            tokens, at = shingles(b.column("text"), width)
            if bits:
                slot, number = np.unique((tokens >> np.uint64(52 - bits)).astype(np.int32), return_counts=True)
                counts[slot] = np.minimum(counts[slot] + number, 65535)
            s1, s2 = _signatures(tokens, at)
            yield pa.RecordBatch.from_arrays([pa.array(_ids(b.column("id"))), b.column("row"), pa.array(np.diff(at)), pa.array(s1), pa.array(s2), pa.nulls(b.num_rows, pa.binary())], names)
        if counts.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, SLOT_BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLOT_BLOCKS), pa.int64()), *[pa.nulls(SLOT_BLOCKS, pa.int64())] * 4, pa.array(parts, pa.binary())], names)

    return rows.mapInArrow(run, schema)


def sketch(survey: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A rank of each slot, 0 for usual counts and up to 15, 8 MB at most; and the company that a token of each rank is expected to have."""
    size = (1 << bits) // SLOT_BLOCKS
    usual = max(1.0, (survey.agg(F.sum("n")).first()[0] or 0) / (1 << bits))

    def add(last: bool):
        def run(table: pa.Table) -> pa.Table:
            total = np.zeros(size, np.uint64)
            for part in table["part"].to_pylist():
                raw = zlib.decompress(part)
                total += np.frombuffer(raw, np.uint16 if len(raw) == 2 * size else np.uint64)
            if last:
                total = np.clip(np.ceil(2 * np.log2(np.maximum(total, 1) / (1.25 * usual))), 0, 15).astype(np.uint8)
            return pa.table({"block": table["block"].slice(0, 1), "part": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

        return run

    parts = survey.where("part is not null").select(F.col("id").alias("block"), "part")
    tasks = parts.where("block = 0").count()
    while tasks > FAN:  # about so many of a block's counts meet at once
        tasks = -(-tasks // FAN)
        parts = parts.groupBy("block", F.pmod(F.crc32("part"), F.lit(tasks))).applyInArrow(add(False), "block long, part binary")
    parts = parts.groupBy("block").applyInArrow(add(True), "block long, part binary")
    rank = np.zeros(1 << bits, np.uint8)
    for r in parts.toLocalIterator():
        rank[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(zlib.decompress(r["part"]), np.uint8)
    return rank, np.where(np.arange(16) > 0, usual * (1.25 * 2 ** (np.arange(16) / 2) - 1), CHANCE)


def counted(rows: DataFrame, width: int) -> DataFrame:
    """``(block, high, low)``: 32 bits of every shingle, two bytes each; a chunk is sorted, so that the upper halves are only counted."""
    each = (1 << 16) // COUNT_BLOCKS

    def packed(values: list[np.ndarray]):
        value = np.sort(np.concatenate(values))
        high = np.bincount(value >> np.uint32(16), minlength=1 << 16).astype(np.uint32)
        low, at = value.astype(np.uint16), np.searchsorted(value >> np.uint32(16), np.arange(COUNT_BLOCKS + 1) * each)
        some = np.flatnonzero(np.diff(at))
        for k in range(0, len(some), 64):
            now = some[k : k + 64]
            yield pa.RecordBatch.from_arrays([pa.array(now, pa.int32()), pa.array([high[x * each : (x + 1) * each].tobytes() for x in now], pa.binary()), pa.array([low[at[x] : at[x + 1]].tobytes() for x in now], pa.binary())], ["block", "high", "low"])

    def run(batches):
        values, n = [], 0
        for b in _sliced(batches, "text"):
            tokens, _ = shingles(b.column("text"), width)
            values.append((tokens >> np.uint64(20)).astype(np.uint32))
            n += len(tokens)
            if n >= COUNTED:
                yield from packed(values)
                values, n = [], 0
        if n:
            yield from packed(values)

    return rows.mapInArrow(run, "block int, high binary, low binary")


def frequent(counts: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`sketch` of the frequent shingles alone: a slot has the rank of the most frequent one in it, however many rare ones it has.

    Counts that would take more than ``FULL`` of the slots are the usual ones.
    """
    size, each = (1 << bits) // COUNT_BLOCKS, (1 << 16) // COUNT_BLOCKS

    def run(table: pa.Table) -> pa.Table:
        high = [np.repeat(np.arange(each, dtype=np.uint32), np.frombuffer(x, np.uint32)) for x in table["high"].to_pylist()]
        value = (np.concatenate(high) << np.uint32(16)) | np.frombuffer(b"".join(table["low"].to_pylist()), np.uint16)
        value.sort()
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        level = np.floor(2 * np.log2(np.diff(np.append(first, len(value))))).astype(np.uint8)
        level_of = np.zeros(size, np.uint8)
        some = level >= LEAST_LEVEL
        np.maximum.at(level_of, (value[first[some]].astype(np.int64) * size) // (each << 16), level[some])
        return pa.table({"block": table["block"].slice(0, 1), "part": pa.array([zlib.compress(level_of.tobytes(), 1)], pa.binary())})

    level = np.zeros(1 << bits, np.uint8)
    for r in counts.groupBy("block").applyInArrow(run, "block int, part binary").toLocalIterator():
        level[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(zlib.decompress(r["part"]), np.uint8)
    taken = np.cumsum(np.bincount(level, minlength=128)[::-1])[::-1]
    least = LEAST_LEVEL + int(np.argmax(taken[LEAST_LEVEL:] <= FULL * len(level)))
    rank = np.clip(level.astype(np.int16) - (least - 1), 0, 15).astype(np.uint8)
    return rank, np.where(np.arange(16) > 0, 2 ** ((least - 1 + np.arange(16)) / 2) - 1, CHANCE)


def _prefixes(tokens: np.ndarray, at: np.ndarray, rank: np.ndarray, extra: np.ndarray, similar: int):
    """Of each set: its prefix (values that order by rank), each token's level, and the level chosen.

    ``extra`` is the company that a token of each rank is expected to have.
    """
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    slot = (tokens >> np.uint64(52 - (len(rank).bit_length() - 1))).astype(np.int64)
    value = (rank[slot].astype(np.uint64) << np.uint64(48)) | (tokens & np.uint64((1 << 48) - 1))
    both = np.sort((row.astype(np.uint64) << np.uint64(52)) | value)
    value = both & _LOW
    share = -(-similar * n // 100)
    first = n - share + 1
    most = np.minimum(LEVELS, share)
    sums = np.concatenate([[0.0], np.cumsum(extra[(value >> np.uint64(48)).astype(np.int64)])])
    costs = np.full((LEVELS, len(n)), np.inf)
    for level in range(1, LEVELS + 1):
        some = (most >= level) & (n > 0)
        company = sums[np.minimum(at[:-1] + first + level - 1, at[1:])] - sums[at[:-1]]
        costs[level - 1, some] = (company + VERIFY * company / level + 0.01 * level)[some]
    chosen = costs.argmin(0) + 1
    length = np.where(n > 0, np.minimum(first + chosen - 1, n), 0)
    place = np.arange(len(value)) - at[row]
    inside = place < length[row]
    level = np.maximum(place - first[row] + 2, 1)
    return row[inside], value[inside], level[inside], chosen, n


def postings(rows: DataFrame, rank: np.ndarray, extra: np.ndarray, buckets: int, width: int, similar: int) -> DataFrame:
    """``(bucket, nodes, sizes, levels, numbers, tokens)``: packed prefix tokens; a task posts equal sets once."""
    shared = rows.sparkSession.sparkContext.broadcast((rank, extra))

    def run(batches):
        rank, extra = shared.value
        posted: set[int] = set()
        for b in _sliced(batches, "text"):
            tokens, at = shingles(b.column("text"), width)
            s1, _ = _signatures(tokens, at)
            row, value, level, chosen, n = _prefixes(tokens, at, rank, extra, similar)
            fresh = np.zeros(len(n), bool)
            for i in np.flatnonzero(n):
                if int(s1[i]) not in posted:
                    fresh[i] = True
                    posted.add(int(s1[i]))
            if len(posted) > 200_000:
                posted.clear()
            keep = fresh[row]
            row, value, level = row[keep], value[keep], level[keep]
            mixed = common.mix(value)
            bucket = (mixed % np.uint64(buckets)).astype(np.int64)
            token = (((mixed >> np.uint64(34)) << np.uint64(2)) | (level - 1).astype(np.uint64)).astype(np.uint32)
            order = np.lexsort((row, bucket))
            bucket, row, token = bucket[order], row[order], token[order]
            out = []
            for x in np.unique(bucket):
                lo, hi = np.searchsorted(bucket, [x, x + 1])
                who, number = np.unique(row[lo:hi], return_counts=True)
                out.append((int(x), s1[who].tobytes(), n[who].astype(np.uint32).tobytes(), chosen[who].astype(np.uint8).tobytes(), number.astype(np.uint32).tobytes(), token[lo:hi].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *[pa.array([r[i] for r in out], pa.binary()) for i in range(1, 6)]], ["bucket", "nodes", "sizes", "levels", "numbers", "tokens"])

    return rows.mapInArrow(run, "bucket int, nodes binary, sizes binary, levels binary, numbers binary, tokens binary")


def candidates(posted: DataFrame, similar: int) -> DataFrame:
    """``(a, b, star)``: pairs that share as many tokens as they must, and the stars of tokens with too many classes to pair."""

    def run(table: pa.Table) -> pa.Table:
        part = lambda k, t: np.frombuffer(b"".join(table[k].to_pylist()), t)
        number = part("numbers", np.uint32)
        node, size, chosen = (np.repeat(part(k, t), number) for k, t in (("nodes", np.int64), ("sizes", np.uint32), ("levels", np.uint8)))
        token = part("tokens", np.uint32)
        level, token = (token & 3).astype(np.int64) + 1, token >> 2
        order = np.lexsort((node, token))
        node, size, chosen, level, token = node[order], size[order].astype(np.int64), chosen[order].astype(np.int64), level[order], token[order]
        keep = np.ones(len(node), bool)
        keep[1:] = (node[1:] != node[:-1]) | (token[1:] != token[:-1])
        node, size, chosen, level, token = node[keep], size[keep], chosen[keep], level[keep], token[keep]
        start = np.flatnonzero(np.diff(token.astype(np.int64), prepend=-1))
        many = np.diff(np.append(start, len(token)))
        a, b, need = [], [], []
        for g in np.flatnonzero(many > FEW):
            x, z = node[start[g] : start[g] + many[g]], size[start[g] : start[g] + many[g]]
            by_size = np.argsort(z, kind="stable")
            x, z = x[by_size], z[by_size]
            near = 100 * z[:-1] >= similar * z[1:]  # of two like sets all sizes between are near too
            a.append(np.minimum(x[:-1], x[1:])[near])
            b.append(np.maximum(x[:-1], x[1:])[near])
            need.append(np.zeros(int(near.sum()), np.int64))
        few = (many <= FEW)[np.repeat(np.arange(len(start)), many)]
        for gap in range(1, FEW):
            i = np.flatnonzero(few[:-gap] & (token[gap:] == token[:-gap])) if len(token) > gap else np.zeros(0, np.int64)
            if not len(i):
                break
            j = i + gap
            both = np.minimum(chosen[i], chosen[j])
            ok = (100 * np.minimum(size[i], size[j]) >= similar * np.maximum(size[i], size[j])) & (np.maximum(level[i], level[j]) <= both)
            a.append(node[i[ok]])
            b.append(node[j[ok]])
            need.append(both[ok])
        if not a:
            a = b = need = [np.zeros(0, np.int64)]
        a, b, need = (np.concatenate(x) for x in (a, b, need))
        order = np.lexsort((need, b, a))
        a, b, need = a[order], b[order], need[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (need[1:] != need[:-1])
        first = np.flatnonzero(new)
        return pa.table({"a": a[first], "b": b[first], "shared": np.diff(np.append(first, len(a))).astype(np.int64), "need": need[first]})

    found = posted.groupBy("bucket").applyInArrow(run, "a long, b long, shared long, need long")
    return found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).where("shared >= need").select("a", "b", (F.col("need") == 0).alias("star"))


def exact(sets: list[np.ndarray], similar: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each set the least index that it reaches through links of at least ``similar`` percent.

    ``side`` tells two blocks apart, of which only pairs across are compared. Shared light tokens (in at
    most ``HEAVY`` sets) are counted; heavy ones are only bounded by how many each set has, as a family
    of near copies shares most of its tokens. Of pairs that may reach the threshold, those already
    connected are skipped, and each component's set with most heavy tokens is tried first.
    """
    n, size = len(sets), np.array([len(x) for x in sets])
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(tokens)
    tokens = tokens[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = tokens[1:] != tokens[:-1]
    del tokens
    start = np.flatnonzero(fresh)
    many = np.diff(np.append(start, len(order)))
    group = np.empty(len(order), np.int32)
    group[order] = np.cumsum(fresh, dtype=np.int32) - 1
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    by_token = owner[order]
    del order, fresh
    heavy = np.bincount(owner[many[group] > HEAVY], minlength=n)
    root = np.arange(n)
    most = np.arange(n)  # of each component, the set with most heavy tokens

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    def join(x: int, y: int) -> int:
        i, j = find(x), find(y)
        if i != j:
            i, j = min(i, j), max(i, j)
            root[j] = i
            if heavy[most[j]] > heavy[most[i]]:
                most[i] = most[j]
        return i

    def similar_to(x: int, y: int) -> bool:
        shared = size[x] + size[y] - len(np.union1d(sets[x], sets[y]))
        return 100 * shared >= similar * (size[x] + size[y] - shared)

    for x in range(n):
        g = group[at[x] : at[x + 1]]
        g = g[(many[g] > 1) & (many[g] <= HEAVY)]
        light = np.zeros(x, np.int64)
        if len(g):
            k = many[g]
            spot = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(start[g], k)
            other = by_token[spot]
            light += np.bincount(other[other < x], minlength=x)
        shared = light + np.minimum(heavy[:x], heavy[x])
        maybe = (100 * shared >= similar * (size[x] + size[:x] - shared)) & (shared > 0)
        if side is not None:
            maybe &= side[:x] != side[x]
        maybe = np.flatnonzero(maybe)
        if not heavy[x]:  # then the counts are exact
            for y in maybe:
                join(x, int(y))
            continue
        mine, tried = {find(x)}, set()
        for y in maybe[np.argsort(-shared[maybe], kind="stable")]:
            r = find(int(y))
            if r in mine:
                continue
            if r not in tried:
                tried.add(r)
                first = int(most[r])
                if first < x and (side is None or side[first] != side[x]) and similar_to(x, first):
                    mine.add(join(x, first))
                    continue
            if similar_to(x, int(y)):
                mine.add(join(x, int(y)))
    return np.array([find(x) for x in range(n)], np.int64)


def marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: false only where ``wanted`` has not the row's ``id``, so that other texts need not be shuffled to find it.

    A table of at most ``SIEVE_MOST`` bits, one bit set for each wanted id, is broadcast; of so many ids that it fills up, more rows may be.
    """
    bits = min(SIEVE_MOST, max(SIEVE_LEAST, (wanted.count() * SIEVE_EACH).bit_length()))
    lines = 1 << (bits - SIEVE_ROW)
    line = F.pmod(F.xxhash64("id"), F.lit(lines)).cast("int")
    bit = F.shiftrightunsigned(F.xxhash64("id"), 64 - SIEVE_ROW).cast("int")

    def run(table: pa.Table) -> pa.Table:
        flags = np.zeros(1 << SIEVE_ROW, np.uint8)
        flags[table["bit"].to_numpy()] = 1
        return pa.table({"line": table["line"].slice(0, 1), "flags": pa.array([np.packbits(flags, bitorder="little").view(np.int64)], pa.list_(pa.int64()))})

    sieve = wanted.select(line.alias("line"), bit.alias("bit")).distinct().groupBy("line").applyInArrow(run, "line int, flags array<long>")
    one = F.expr("coalesce(getbit(flags[shiftrightunsigned(bit, 6)], bit % 64) = 1, false)")
    return rows.withColumns({"line": line, "bit": bit}).join(F.broadcast(sieve), "line", "left").withColumn("maybe", one).drop("line", "bit", "flags")


def with_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with the ``text`` of each ``rep``; of the other texts hardly any is shuffled."""
    some = marked(rows.select("id", "text"), wanted.select(F.col("rep").alias("id"))).where("maybe").drop("maybe")
    return some.join(wanted, some["id"] == wanted["rep"]).drop("id")


def linked(texts: DataFrame, width: int, similar: int) -> DataFrame:
    """``(shard, i, j, family, whole, node, s1, block, text)`` to ``(node, to, whole)`` of every set with links to lesser ones."""

    def run(table: pa.Table) -> pa.Table:
        across = table["i"][0].as_py() != table["j"][0].as_py()
        table = table.sort_by([("family", "ascending"), ("node", "ascending"), ("block", "ascending")]).combine_chunks()
        sets: list[np.ndarray] = []
        keep: list[np.ndarray] = []
        for b in _sliced(iter(table.select(["s1", "text"]).to_batches()), "text"):
            tokens, at = shingles(b.column("text"), width)
            keep.append(_signatures(tokens, at)[0] == b.column("s1").to_numpy())  # an id may come with other texts
            sets += [tokens[x:y] for x, y in zip(at[:-1], at[1:])]
        kept = np.concatenate(keep)
        family, node, block, whole = (table[k].to_numpy() for k in ("family", "node", "block", "whole"))
        left, right, final = [], [], []
        for some in np.split(np.arange(len(family)), np.flatnonzero(np.diff(family)) + 1):
            some = some[kept[some]]
            to = some[exact([sets[i] for i in some], similar, block[some] if across else None)] if len(some) else some
            left.append(node[some[to != some]])
            right.append(node[to[to != some]])
            final.append(whole[some[to != some]])
        return pa.table({"node": np.concatenate(left), "to": np.concatenate(right), "whole": np.concatenate(final)})

    return texts.groupBy("shard", "i", "j").applyInArrow(run, "node long, to long, whole boolean")


def dealt(members: DataFrame) -> DataFrame:
    """``members`` with the part of its family that each is in; parts have about ``BLOCK_TOKENS`` tokens."""
    parts = members.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("parts"))
    return members.join(parts, "family").withColumn("part", F.pmod(F.xxhash64("s1"), F.col("parts")).cast("int"))


def _sets(table: pa.Table, width: int):
    """``(s1, tokens, at, extra columns)`` of slices of a table; rows whose text is not the set's, as an id may come with others, are left out."""
    for b in _sliced(iter(table.combine_chunks().to_batches()), "text"):
        tokens, at = shingles(b.column("text"), width)
        s1 = b.column("s1").to_numpy()
        yield s1, tokens, at, _signatures(tokens, at)[0] == s1, b


def central(rows: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``(family, l_s1, l_rep, l_n)``: of each family a member whose shingles many others of its part have."""
    placed = dealt(members)
    texts = with_texts(rows, placed).select("family", "part", "s1", "text")

    def run(table: pa.Table) -> pa.Table:
        # counts by 20 bits of the shingle are enough to tell the middle of a family
        slots = np.zeros(1 << 20, np.int64)
        for _, tokens, _, _, _ in _sets(table, width):
            slots += np.bincount((tokens >> np.uint64(32)).astype(np.int64), minlength=1 << 20)
        best = (-1.0, 0)
        for s1, tokens, at, right, _ in _sets(table, width):
            mean = common.per_row(slots[(tokens >> np.uint64(32)).astype(np.int64)], at) / np.maximum(np.diff(at), 1)
            for i in np.flatnonzero(right):
                best = max(best, (float(mean[i]), int(s1[i])))
        return pa.table({"family": table["family"].slice(0, 1), "s1": pa.array([best[1]]), "mean": pa.array([best[0]])})

    found = texts.groupBy("family", "part").applyInArrow(run, "family long, s1 long, mean double")
    best = found.groupBy("family").agg(F.max(F.struct("mean", "s1")).alias("b")).select("family", F.col("b.s1").alias("s1"))
    return best.join(members, ["family", "s1"]).select("family", F.col("s1").alias("l_s1"), F.col("rep").alias("l_rep"), F.col("n").alias("l_n"))


def compared(rows: DataFrame, active: DataFrame, leaders: DataFrame, width: int, least: int) -> DataFrame:
    """``(family, l_s1, l_rep, s1, rep, n, shared, total)`` of the members whose set shares ``least`` percent with their family's leader.

    A leader's text goes to each part of its family, a member's to one.
    """
    near = active.join(leaders, "family").where(f"s1 <> l_s1 and 100 * least(n, l_n) >= {least} * greatest(n, l_n)")
    near = common.checkpointed(dealt(near))
    side = near.select("family", "part", "rep", "s1", F.lit(False).alias("leads"))
    whole = near.select("family", "parts", "l_rep", "l_s1").distinct()
    lead = whole.select("family", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("l_rep").alias("rep"), F.col("l_s1").alias("s1"), F.lit(True).alias("leads"))
    texts = with_texts(rows, side.unionByName(lead))

    def run(table: pa.Table) -> pa.Table:
        leader: np.ndarray | None = None
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
        for s1, tokens, at, right, b in _sets(table.sort_by([("leads", "descending")]), width):
            leads = b.column("leads").to_numpy(zero_copy_only=False)
            if leader is None and (right & leads).any():
                i = int(np.flatnonzero(right & leads)[0])
                leader = tokens[at[i] : at[i + 1]]
            if leader is None:
                continue
            shared = common.per_row(np.isin(tokens, leader).astype(np.int64), at)
            total = np.diff(at) + len(leader) - shared
            keep = np.flatnonzero(right & ~leads & (100 * shared >= least * total))
            out.append((s1[keep], shared[keep], total[keep]))
        return pa.table({k: np.concatenate(x) for k, x in zip(("s1", "shared", "total"), zip(*out))})

    made = texts.groupBy("family", "part").applyInArrow(run, "s1 long, shared long, total long").distinct()
    return made.join(near.drop("part", "parts"), "s1")


def across(close: DataFrame, gone: DataFrame, limit: float) -> DataFrame:
    """Where members that came close to a leader meet those that left with it, as far as distances allow: blocks of the latter, one after the other."""
    nearest = close.groupBy("l_s1").agg(F.min("distance").alias("nearest"))
    behind = gone.join(nearest, "l_s1").where(F.col("distance") >= F.col("nearest") - limit - 1e-9)
    behind = behind.join(behind.groupBy("l_s1").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("n_blocks")), "l_s1")
    family, columns = F.xxhash64(F.lit(2), "l_s1").alias("family"), ["s1", "rep"]
    far = behind.select(family, *columns, (F.pmod(F.xxhash64("rep"), F.col("n_blocks")) + 1).cast("int").alias("block"), F.lit(0).alias("other"))
    met = close.join(behind.select("l_s1", "n_blocks").distinct(), "l_s1")
    return far.unionByName(met.select(family, *columns, F.lit(0).alias("block"), F.explode(F.sequence(F.lit(1), F.col("n_blocks"))).alias("other")))


def peeled(rows: DataFrame, members: DataFrame, width: int, similar: int) -> tuple[DataFrame, DataFrame]:
    """Of families that are too large for one task ``(family, s1, rep, n)``: links ``(a, b)``, and what is left to compare, as :func:`meetings` gives it.

    In each round every family has a leader from its middle, and its members are compared with that alone.
    Those that are similar to it are linked and leave the family. Sets whose distance from the leader is more
    than twice the limit can't be similar to any of them, as the Jaccard distance is a metric. Of the few
    between, later leaders are compared first with those that left, then those that still are in another
    component. So a third of all rows that are near copies costs a few comparisons each. A family's rounds
    end when it is small enough; all do when a round links less than a twentieth of what is left.
    """
    limit, reach = (100 - similar) / 100, max(1, 2 * similar - 100)
    active = common.checkpointed(members)
    links = left = misses = gone = led = None
    add = lambda a, b: b if a is None else a.unionByName(b)
    for _ in range(ROUNDS):
        leaders = common.checkpointed(central(rows, active, width))
        found = common.checkpointed(compared(rows, active, leaders, width, reach).withColumn("distance", 1 - F.col("shared") / F.col("total")))
        alike = F.expr(f"100 * shared >= {similar} * total")
        links = add(links, found.where(alike).select(F.col("rep").alias("a"), F.col("l_rep").alias("b")))
        gone = add(gone, found.where(alike).select("l_s1", "s1", "rep", "n", "distance"))
        misses = add(misses, found.where(~alike).select("l_s1", "l_rep", "s1", "rep", "n", "distance"))
        led = add(led, leaders.select(F.col("l_s1").alias("s1")))
        out = found.where(alike).select("s1").unionByName(leaders.select(F.col("l_s1").alias("s1"))).distinct()
        before = active.count()
        active = common.checkpointed(active.join(out, "s1", "left_anti"))
        now = active.count()
        small = active.groupBy("family").agg(F.sum("n").alias("tokens")).where(F.col("tokens") <= BLOCK_TOKENS).select("family")
        left = add(left, active.join(small, "family", "left_semi"))
        active = common.checkpointed(active.join(small, "family", "left_anti"))
        if active.isEmpty() or 20 * (before - now) < before:
            break
    first = across(misses.join(led, "s1", "left_semi"), gone, limit).withColumn("whole", F.lit(False))
    links = common.checkpointed(links.unionByName(linked(held(rows, first, 1), width, similar).select(F.col("node").alias("a"), F.col("to").alias("b"))))
    parts = common.checkpointed(common.components(links))
    own, theirs = parts.select(F.col("node").alias("rep"), F.col("component").alias("c1")), parts.select(F.col("node").alias("l_rep"), F.col("component").alias("c2"))
    apart = misses.join(led, "s1", "left_anti").join(own, "rep", "left").join(theirs, "l_rep", "left").where("c1 is null or c2 is null or c1 <> c2").select("l_s1", "s1", "rep", "n", "distance")
    rest = dealt(left.unionByName(active))
    rest = rest.select(F.xxhash64(F.lit(1), "family").alias("family"), "s1", "rep", F.col("part").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return links, rest.unionByName(across(apart, gone, limit))


def held(rows: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """The texts of the classes that meet, by the task in which they do."""
    return with_texts(rows, wanted).select(
        F.when(F.col("whole"), F.pmod("family", F.lit(buckets))).otherwise(F.col("family")).alias("shard"),
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "family", "whole", F.col("rep").alias("node"), "s1", "block", "text",
    )


def meetings(rows: DataFrame, pairs: DataFrame, kinds: DataFrame, width: int, similar: int) -> tuple[DataFrame, DataFrame | None]:
    """``family, whole, s1, rep, block, other``: where each class that has candidates meets them, and if all that it can reach is there;
    and the links ``(a, b)`` that were found on the way.

    Candidates that hang together are a family. Families of at most ``BLOCK_TOKENS`` meet whole. From larger
    ones what is like a leader is peeled off; blocks of what is left meet in pairs.
    """
    members = common.components(pairs).select(F.col("component").alias("family"), F.col("node").alias("s1")).join(kinds.select("s1", "rep", "n"), "s1")
    members = common.checkpointed(members.join(members.groupBy("family").agg(F.sum("n").alias("tokens")), "family"))
    zero = F.lit(0)
    out = members.where(F.col("tokens") <= BLOCK_TOKENS).select(F.xxhash64(zero, "family").alias("family"), F.lit(True).alias("whole"), "s1", "rep", zero.alias("block"), zero.alias("other"))
    large = members.where(F.col("tokens") > BLOCK_TOKENS).drop("tokens")
    if large.isEmpty():
        return out, None
    links, left = peeled(rows, large, width, similar)
    return out.unionByName(left.withColumn("whole", F.lit(False))), links


def reached(rows: DataFrame, width: int, similar: int) -> DataFrame:
    """``(id, row, text)`` to ``id, row, n, component, copies``; ``row`` is carried along.

    Ids are not null; rows with one id are one node with each of its texts. A component is its least id, and
    rows without words are their own.
    """
    spark = rows.sparkSession
    common.small_batches(spark)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = slot_bits(total)
    many = crowded(total)
    survey = common.checkpointed(surveyed(rows, width, None if many else bits))
    rank, extra = frequent(counted(rows, width), bits) if many else sketch(survey, bits)
    every = survey.where("part is null").drop("part")
    buckets = max(3 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // CHUNK_BYTES))
    kinds = every.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"))
    kinds = common.checkpointed(kinds)
    pairs = common.checkpointed(candidates(postings(rows, rank, extra, buckets, width, similar), similar))
    wanted, peels = meetings(rows, pairs, kinds, width, similar)
    wanted = common.checkpointed(wanted)
    links = common.checkpointed(linked(held(rows, wanted, buckets), width, similar))
    # nodes are sorted within a family, so the least index is the least id
    parts = links.where("whole").select("node", F.col("to").alias("component"))
    parts = parts.unionByName(parts.select(F.col("component").alias("node"), "component").distinct())
    if peels is not None:
        parts = parts.unionByName(common.components(links.where("not whole").select(F.col("node").alias("a"), F.col("to").alias("b")).unionByName(peels)))
    # a row that is repeated is linked as often, and an id with several texts may be in several components
    parts = common.checkpointed(parts.distinct())
    if not parts.groupBy("node").count().where("count > 1").isEmpty():
        parts = common.components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))
    known = kinds.join(parts.withColumnRenamed("node", "rep"), "rep", "left").where("component is not null or copies > 1")
    known = known.select("s1", "s2", F.coalesce("component", "rep").alias("component"), "copies")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = every.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["s1", "s2", "salt"], "left")
    has_words = F.col("n") > 0
    return out.select("id", "row", "n", F.when(has_words, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component"), F.when(has_words, F.coalesce("copies", F.lit(1))).otherwise(1).cast("long").alias("copies"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similar: int = SIMILAR) -> DataFrame:
    """``id, n_shingles, component_id, n_equal`` of every row: the least id reachable and how many rows have the same set."""
    # each text without an id is a node of its own, below all ids
    text = common.named(text_col)
    nameless = F.lit(NO_ID) + F.xxhash64(text).bitwiseAND(F.lit(NAMELESS - 1))
    rows = docs.select(F.coalesce(common.named(id_col).cast("long"), nameless).alias("id"), F.lit(0).cast("long").alias("row"), text.alias("text"))
    known = lambda c: F.when(F.col(c) >= F.lit(NO_ID + NAMELESS), F.col(c))
    return reached(rows, width, similar).select(known("id").alias(id_col), F.col("n").alias("n_shingles"), known("component").alias("component_id"), F.col("copies").alias("n_equal"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.read(spark, sf_dir, "documents").select("doc_id", "text"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, of the rows with the least id the one whose hash is least.

    Here rows that share an id but not the text are documents of their own. A null id is less than all others.
    Of rows that repeat id and text one stays. Rows without words are linked with nothing and all stay.
    """
    real = F.coalesce(common.named("doc_id").cast("long"), F.lit(NO_ID))
    text = common.named("text")
    ids = [F.xxhash64(real, text).alias("id"), real.alias("row")]
    found = common.checkpointed(reached(docs.select(*ids, text.alias("text")), WIDTH, SIMILAR).where("n > 0"))
    first = found.groupBy("component").agg(F.min(F.struct("row", "id")).alias("first"))
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["component", "salt"])
    gone = spread.where(F.struct("row", "id") != F.col("first")).select("id", "row").distinct()
    again = common.checkpointed(found.groupBy("id", "row").agg(F.count("*").alias("n")).where("n > 1").select("id", "row"))
    rest = F.struct(*[common.named(c) for c in docs.columns]).alias("rest_")
    # rows that surely stay as they are need no shuffle of their texts
    gone = common.checkpointed(gone)
    seen = marked(docs.select(*ids, rest), gone.unionByName(again).select("id"))
    stay = seen.where("not maybe").select("rest_.*")
    left = seen.where("maybe").join(gone, ["id", "row"], "left_anti")
    if again.isEmpty():
        return stay.unionByName(left.select("rest_.*"))
    once = left.join(again, ["id", "row"], "left_anti").unionByName(left.join(again, ["id", "row"], "left_semi").dropDuplicates(["id", "row"]))
    return stay.unionByName(once.select("rest_.*"))
