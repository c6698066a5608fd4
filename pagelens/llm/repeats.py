"""Where a corpus repeats itself: the routing that both substring deduplicators share.

A document is a sequence of units (words or bytes). Windows of ``window`` units that occur elsewhere
are to be found. The routing never decides a match; it brings together what may match:

0. Of equal texts only the first document's takes part: a later copy repeats all of it, whatever else there is,
   so the steps below cost what distinct texts cost. Copies are found by a digest; texts do not move for it.
1. Texts are dealt into chunks once. From each window its least ``gram``-unit hash is an anchor
   (winnowing): equal windows have equal anchors. A chunk reduces its anchors to one message a key (which
   document of the chunk has it first, where, how often), so a key that every document has costs one
   message a chunk. Counted by hash bucket, the keys that repeat come back to the chunks that have them,
   with their owner: the first document, and the stretch of it, that holds the key.
2. A window whose anchor repeats is a candidate. Runs of candidates with one owner are sent, as
   text, to the owner's shard. A key that ``HOT`` or more places have is no longer sent to its owner but
   dealt by itself, and where ``SPREAD`` or more have it, each window by its own content, so a passage that
   a third of all documents share, each in a text of its own, is spread over all shards. Thus a group holds
   what fewer than ``HOT`` places share with one stretch of ``STRETCH`` units, fewer than ``SPREAD`` with one
   key, or what each chunk sends once of one window.
3. Before it sends, a chunk compares its runs by their bytes: of equal runs the first is sent, with all
   its places in its document; those of other documents are settled there, as equal runs are covered
   whatever the matcher says of the first. This is a pre-aggregation at every size; what a chunk sends once
   is what the matcher reads.
4. A shard hands its pieces, in order of document and place, to the ``match`` it was given (suffix
   automata or suffix arrays), which alone decides what was there before.
5. The spans go back to their chunks.

Every exchange is keyed by a hash of the document, the owner or the key, and moves packed arrays; the
number of chunks follows the bytes of the input. Texts are shuffled once and read three times from that
exchange. Nothing is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm import common

CHUNK_BYTES = 8 << 20
#: Places from which on a key is dealt by itself; counts of a chunk are saturated at 255.
HOT = 255
#: Places from which on each window of a key is dealt by its content.
SPREAD = 1 << 11
#: Units of an owner's text that share a group.
STRETCH = 1 << 14
BLOCK = 1 << 20
NO_ID = -(1 << 63)
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Spec:
    """Units, the length of windows and grams, and whether a repeat within one document counts."""

    words: bool
    window: int
    gram: int
    same_doc: bool


#: (documents, starts, contents, groups, spec) of a shard, sorted; to the spans (piece, from, to) that were there before.
Match = Callable[[np.ndarray, np.ndarray, list[bytes], np.ndarray, Spec], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _slide(h: np.ndarray, w: int, least: bool) -> np.ndarray:
    pick, size = (np.minimum if least else np.maximum), 1
    while size * 2 <= w and len(h):
        h = pick(h[:-size], h[size:]) if len(h) > size else h[:0]
        size *= 2
    if size < w:
        h = pick(h[: len(h) - (w - size)], h[w - size :]) if len(h) > w - size else h[:0]
    return h


class Sequence:
    """Units, grams and anchors of a block of texts."""

    def __init__(self, column: pa.Array, spec: Spec):
        self.data, self.at = common.utf8(column)
        self.sums = common.prefix(common.byte_codes(self.data))
        if spec.words:
            self.words = common.Words(self.data, self.at, self.sums)
            self.first, self.row_of_unit = self.words.first, self.words.row
            self.start, self.hash = self.words.windows(spec.gram)
        else:
            self.first, self.row_of_unit = self.at, np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
            n = len(self.data) - spec.gram + 1
            self.start = np.flatnonzero(self.row_of_unit[:n] == self.row_of_unit[spec.gram - 1 :]) if n > 0 else np.zeros(0, np.int64)
            self.hash = common.span_hash(self.sums, self.start, self.start + spec.gram)
        self.row = self.row_of_unit[self.start]
        w = spec.window - spec.gram + 1
        n = len(self.start) - w + 1
        if n > 0:
            self.whole = self.row[:n] == self.row[w - 1 :]
            self.least = np.where(self.whole, _slide(self.hash, w, True), np.uint64(0))
            padded = np.concatenate([np.zeros(w - 1, np.uint64), self.least, np.zeros(w - 1, np.uint64)])
            self.anchors = np.flatnonzero((_slide(padded, w, False) == self.hash) & (self.hash > 0))
        else:
            self.whole, self.least, self.anchors = np.zeros(0, bool), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def content(self, begin: int, end: int) -> bytes:
        """The text of the units begin to end, which lie in one document."""
        a, b = (self.words.start[begin], self.words.stop[end - 1]) if hasattr(self, "words") else (begin, end)
        return self.data[a:b].tobytes()


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(fresh)
    return begin, np.append(begin[1:], len(fresh))


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _merged(ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each id, those that meet made one."""
    order = np.lexsort((begin, ids))
    ids, begin, end = ids[order], begin[order].astype(np.int64), end[order].astype(np.int64)
    if not len(ids):
        return ids, begin, end
    number = np.cumsum(_fresh(ids)).astype(np.int64) << 40
    far = np.maximum.accumulate(number + end)
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (number + begin)[1:] > far[:-1]
    a, b = _starts(fresh)
    return ids[a], begin[a], far[b - 1] - number[a]


def chunked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``(id, row, text, chunk)`` and the number of chunks, which follows the bytes of all texts.

    ``row`` is a hash of id and text: rows that repeat both have the same answer.
    """
    common.small_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(parts, -(-total // CHUNK_BYTES))
    key, text = F.col(id_col).cast("long"), F.col(text_col)
    row = F.xxhash64(key, text)
    return docs.select(key.alias("id"), row.alias("row"), text.alias("text"), F.pmod(row, F.lit(n)).cast("int").alias("chunk")), n


def copies(docs: DataFrame) -> DataFrame:
    """``(to, copy)``: chunk and hash of the rows whose whole text a smaller id has."""
    rows = docs.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "row", "chunk", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("last > first").select("digest", "first")
    return rows.join(first, "digest").where("id > first").select(F.col("chunk").alias("to"), F.col("row").alias("copy"))


def _with_copies(sent: DataFrame, gone: DataFrame) -> DataFrame:
    """What is sent to chunks, and their copies in a column of their own."""
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in sent.schema if f.name != "chunk"]
    return sent.withColumn("copy", F.lit(None).cast("long")).unionByName(gone.select(F.col("to").alias("chunk"), *none, "copy"))


def _parted(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """What was sent, and the copies, sorted."""
    copy = table["copy"].drop_null()
    return table.filter(pa.compute.is_null(table["copy"])), np.unique(copy.to_numpy())


def _first_of_copies(docs: pa.Table, copy: np.ndarray) -> pa.Table:
    return docs.filter(pa.array(~np.isin(docs["row"].to_numpy(), copy))) if len(copy) and docs.num_rows else docs


def _blocks(table: pa.Table):
    return common.blocks(iter(table.combine_chunks().to_batches()), "text", BLOCK)


def repeated_anchors(docs: DataFrame, gone: DataFrame, n: int, spec: Spec) -> DataFrame:
    """``(chunk, bucket, keys, owners, stretches, hot)``: packed, for each chunk its keys that repeat anywhere."""
    message = "chunk int, bucket int, keys binary, docs binary, stretches binary, counts binary"

    def emit(table: pa.Table, gone: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py() if table.num_rows else 0
        table = _first_of_copies(table, gone["copy"].to_numpy())
        known = np.unique(_ids(table["id"].combine_chunks()))
        parts = []
        for b in _blocks(table):
            s = Sequence(b.column("text"), spec)
            row = s.row[s.anchors]
            parts.append((s.hash[s.anchors], np.searchsorted(known, _ids(b.column("id")))[row], s.start[s.anchors] - s.first[row]))
        key, doc, place = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.lexsort((place, doc, key))
        key, doc, place = key[order], doc[order], place[order]
        # rows with one id are one document: equal places of equal text count once
        counted = _fresh(key, doc, place) if spec.same_doc else _fresh(key, doc)
        begin, _ = _starts(_fresh(key))
        count = np.minimum(np.add.reduceat(counted.astype(np.int64), begin), 255) if len(begin) else begin
        key, doc, stretch = key[begin], doc[begin].astype(np.uint16), (place[begin] // STRETCH).astype(np.uint8)
        bucket = (key % np.uint64(n)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, short = bucket[order], (key[order] >> np.uint64(32)).astype(np.uint32)
        packed = (short, doc[order], stretch[order], count[order].astype(np.uint8))
        a, z = _starts(_fresh(bucket)) if len(bucket) else (bucket, bucket)
        cut = [pa.array([x[i:j].tobytes() for i, j in zip(a, z)], pa.binary()) for x in packed]
        return pa.table([pa.array([chunk] * len(a), pa.int32()), pa.array(bucket[a], pa.int32()), *cut], ["chunk", "bucket", "keys", "docs", "stretches", "counts"])

    def count(table: pa.Table) -> pa.Table:
        sizes = [len(x) // 4 for x in table["keys"].to_pylist()]
        chunk = np.repeat(table["chunk"].to_numpy(), sizes).astype(np.uint32)
        key, doc, stretch, n_places = (_joined(table[k], t) for k, t in (("keys", np.uint32), ("docs", np.uint16), ("stretches", np.uint8), ("counts", np.uint8)))
        order = np.lexsort((chunk, key))
        key, chunk, doc, stretch, n_places = (x[order] for x in (key, chunk, doc, stretch, n_places))
        fresh = _fresh(key)
        begin, _ = _starts(fresh)
        total = np.add.reduceat(n_places.astype(np.int64), begin) if len(begin) else begin
        group = np.cumsum(fresh) - 1
        keep = (total > 1)[group]
        owner = ((chunk[begin].astype(np.uint64) << np.uint64(16)) | doc[begin].astype(np.uint64))[group][keep]
        stretch, hot = stretch[begin][group][keep], ((total >= HOT).astype(np.uint8) + (total >= SPREAD))[group][keep].astype(np.uint8)
        chunk, key = chunk[keep], key[keep]
        order = np.argsort(chunk, kind="stable")
        chunk = chunk[order]
        a, z = _starts(_fresh(chunk)) if len(chunk) else (chunk, chunk)
        cut = [pa.array([x[i:j].tobytes() for i, j in zip(a, z)], pa.binary()) for x in (key[order], owner[order], stretch[order], hot[order])]
        bucket = table["bucket"][0].as_py()
        return pa.table([pa.array(chunk[a].astype(np.int32)), pa.array([bucket] * len(a), pa.int32()), *cut], ["chunk", "bucket", "keys", "owners", "stretches", "hot"])

    sent = docs.groupBy("chunk").cogroup(gone.groupBy("to")).applyInArrow(emit, message)
    return sent.groupBy("bucket").applyInArrow(count, "chunk int, bucket int, keys binary, owners binary, stretches binary, hot binary")


def _tags(key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return common.mix((key.astype(np.uint64) << np.uint64(24)) ^ bucket.astype(np.uint64) * _ODD)


def pieces(docs: DataFrame, replies: DataFrame, gone: DataFrame, n: int, spec: Spec) -> DataFrame:
    """``(shard, group_, id, row, chunk, starts, stops, content)``: candidate runs and their places in a row; without content, what is known to repeat."""
    names = ["shard", "group_", "id", "row", "chunk", "starts", "stops", "content"]
    schema = "shard int, group_ long, id long, row long, chunk int, starts binary, stops binary, content binary"
    shards = 2 * n

    def cut(docs: pa.Table, replies: pa.Table) -> pa.Table:
        out: list[tuple] = []
        replies, copy = _parted(replies)
        docs = _first_of_copies(docs, copy)
        if docs.num_rows and replies.num_rows:
            sizes = [len(x) // 4 for x in replies["keys"].to_pylist()]
            bucket = np.repeat(replies["bucket"].to_numpy(), sizes)
            key, owner, stretch, hot = (_joined(replies[k], t) for k, t in (("keys", np.uint32), ("owners", np.uint64), ("stretches", np.uint8), ("hot", np.uint8)))
            tag = _tags(key, bucket)
            group = common.mix(np.where(hot > 0, tag, owner * _ODD + stretch))
            order = np.argsort(tag)
            tag, group, hot = tag[order], group[order], hot[order]
            chunk = int(docs["chunk"][0].as_py())
            runs: list[tuple] = []
            for b in _blocks(docs):
                s, ids, own = Sequence(b.column("text"), spec), _ids(b.column("id")), b.column("row").to_numpy()
                if not len(s.anchors):
                    continue
                h = s.hash[s.anchors]
                mine = _tags((h >> np.uint64(32)).astype(np.uint32), (h % np.uint64(n)))
                at = np.minimum(np.searchsorted(tag, mine), len(tag) - 1)
                known = tag[at] == mine
                # the anchor of a window: the first whose hash is the window's least
                counts = np.zeros((2, len(s.start) + 1), np.int32)
                counts[0, s.anchors + 1], counts[1, s.anchors + 1] = 1, known
                counts = np.cumsum(counts, axis=1, dtype=np.int32)
                w = spec.window - spec.gram + 1
                spots = np.flatnonzero(s.whole & (counts[1, w:] > counts[1, : len(s.start) + 1 - w]))
                i = counts[0, spots].astype(np.int64)
                wrong = np.flatnonzero(h[i] != s.least[spots])
                while len(wrong):
                    i[wrong] += 1
                    wrong = wrong[h[i[wrong]] != s.least[spots[wrong]]]
                spots, i = spots[known[i]], i[known[i]]
                if not len(spots):
                    continue
                to, row, unit = group[at[i]], s.row[spots], s.start[spots]
                new = np.ones(len(unit), bool)
                new[1:] = (unit[1:] != unit[:-1] + 1) | (to[1:] != to[:-1]) | (row[1:] != row[:-1])
                a, z = _starts(new)
                end = unit[z - 1] + spec.window
                origin = s.first[row[a]]
                each = (ids[row[a]], own[row[a]], unit[a] - origin, end - origin, to[a], hot[at[i[a]]], unit[a], end)
                for who, r, p, q, g, heat, x, y in zip(*(c.tolist() for c in each)):
                    runs.append((who, r, p, q, g, heat, s.content(x, y)))
            runs.sort(key=lambda r: r[:4])
            settled: list[tuple] = []

            def sent(seen: dict[bytes, list], i: int, r: int, p: int, q: int, g: int, content: bytes) -> bool:
                """Note one more place of a run. False if its windows start earlier in another row, or, where that counts, in the same."""
                first = seen.get(content)
                if first is None:
                    seen[content] = [g % shards, g - (1 << 63), i, r, chunk, [p], [q]]
                elif first[3] == r and p == first[5][-1]:
                    pass  # a row that is repeated has the same answer
                elif first[2] == i and not spec.same_doc:  # another place in the document: the same answer in this row
                    if first[3] == r:
                        first[5].append(p)
                        first[6].append(q)
                    else:
                        out.append((first[0], first[1], i, r, chunk, np.int32(p).tobytes(), np.int32(q).tobytes(), content))
                else:
                    settled.append((r, p, q))
                    return False
                return True

            whole: dict[bytes, list] = {}
            wide: dict[bytes, list] = {}
            parts: dict[bytes, list] = {}
            for i, r, p, q, g, heat, content in runs:
                if heat < 2:
                    sent(whole, i, r, p, q, g, content)
                elif sent(wide, i, r, p, q, 0, content):  # each window is dealt by its content
                    units = content.split() if spec.words else content
                    for k in range(q - p - spec.window + 1):
                        part = b" ".join(units[k : k + spec.window]) if spec.words else units[k : k + spec.window]
                        sent(parts, i, r, p + k, p + k + spec.window, xxhash.xxh64_intdigest(part), part)
            for seen in (whole, parts):
                out += [(*x[:5], np.array(x[5], np.int32).tobytes(), np.array(x[6], np.int32).tobytes(), content) for content, x in seen.items()]
            if settled:
                where = int(common.mix(np.array([chunk], np.uint64))[0]) % shards
                r, p, q = _merged(*(np.array(x, np.int64) for x in zip(*settled)))
                for a, z in zip(*_starts(_fresh(r))):
                    out.append((where, 0, 0, int(r[a]), chunk, p[a:z].astype(np.int32).tobytes(), q[a:z].astype(np.int32).tobytes(), None))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return docs.groupBy("chunk").cogroup(_with_copies(replies, gone).groupBy("chunk")).applyInArrow(cut, schema)


def matched(found: DataFrame, match: Match, spec: Spec) -> DataFrame:
    """``(chunk, rows, starts, stops)``: packed, the spans of units that were there before."""

    def run(table: pa.Table) -> pa.Table:
        table = table.append_column("first", pa.array(np.array([np.frombuffer(x[:4], np.int32)[0] for x in table["starts"].to_pylist()], np.int32)))
        known = table.filter(pa.compute.is_null(table["content"]))
        table = table.filter(pa.compute.is_valid(table["content"])).sort_by([("id", "ascending"), ("row", "ascending"), ("first", "ascending")])
        which, begin, end = match(table["id"].to_numpy(), table["first"].to_numpy(), table["content"].to_pylist(), table["group_"].to_numpy(), spec) if table.num_rows else (np.zeros(0, np.int64),) * 3
        # a span holds at each place of its piece
        places = [np.frombuffer(x, np.int32) for x in table["starts"].to_pylist()]
        n = np.array([len(places[w]) for w in which], np.int64)
        starts = np.concatenate([places[w] for w in which]) if len(which) else np.zeros(0, np.int32)
        which, begin, end = np.repeat(which, n), np.repeat(begin, n) + starts, np.repeat(end, n) + starts
        sizes = [len(x) // 4 for x in known["starts"].to_pylist()]
        rows = np.concatenate([table["row"].to_numpy()[which], np.repeat(known["row"].to_numpy(), sizes)])
        begin, end = np.concatenate([begin, _joined(known["starts"], np.int32)]), np.concatenate([end, _joined(known["stops"], np.int32)])
        chunk = np.concatenate([table["chunk"].to_numpy()[which], np.repeat(known["chunk"].to_numpy(), sizes)])
        order = np.argsort(chunk, kind="stable")
        rows, begin, end, chunk = (x[order] for x in (rows.astype(np.int64), begin.astype(np.int32), end.astype(np.int32), chunk))
        a, z = _starts(_fresh(chunk)) if len(chunk) else (chunk, chunk)
        return pa.table({"chunk": pa.array(chunk[a], pa.int32()), **{k: pa.array([x[i:j].tobytes() for i, j in zip(a, z)], pa.binary()) for k, x in (("rows", rows), ("starts", begin), ("stops", end))}})

    return found.groupBy("shard").applyInArrow(run, "chunk int, rows binary, starts binary, stops binary")


def cleaned(docs: DataFrame, spans: DataFrame, gone: DataFrame, spec: Spec) -> DataFrame:
    """``(id, n_units, n_removed, n_spans, kept binary)`` of every document."""

    def cut(docs: pa.Table, spans: pa.Table) -> pa.Table:
        spans, copy = _parted(spans)
        own, begin, end = _merged(*(_joined(spans[k], t) for k, t in (("rows", np.int64), ("starts", np.int32), ("stops", np.int32))))
        done = []
        for b in _blocks(docs):
            data, at = common.utf8(b.column("text"))
            words = common.Words(data, at) if spec.words else None
            first = words.first if words else at
            doc = b.column("row").to_numpy()
            lo, hi = np.searchsorted(own, doc), np.searchsorted(own, doc, "right")
            change = np.zeros(first[-1] + 1, np.int64)
            rows = np.repeat(np.arange(len(doc)), hi - lo)
            which = np.arange(len(rows)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[rows]
            np.add.at(change, first[rows] + begin[which], 1)
            np.add.at(change, first[rows] + end[which], -1)
            units = np.diff(first)
            again = np.flatnonzero(np.isin(doc, copy) & (units >= spec.window))
            np.add.at(change, first[again], 1)
            np.add.at(change, first[again + 1], -1)
            gone = np.cumsum(change[:-1]) > 0
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            at_first = first[:-1][first[:-1] < len(gone)]
            edge[at_first] = gone[at_first]
            if words:
                keep = ~gone
                kept = []
                for r in range(len(doc)):
                    a, z = first[r], first[r + 1]
                    if gone[a:z].any():
                        kept.append(b" ".join([data[x:y].tobytes() for x, y in zip(words.start[a:z][keep[a:z]], words.stop[a:z][keep[a:z]])]))
                    else:
                        kept.append(b" ".join(data[at[r] : at[r + 1]].tobytes().split()))
                kept = pa.array(kept, pa.binary())
            else:
                left = common.per_row(~gone, first)
                kept = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(left)]).astype(np.int32)), pa.py_buffer(data[~gone].tobytes())])
            done.append(pa.RecordBatch.from_arrays([b.column("id"), pa.array(units), pa.array(common.per_row(gone, first)), pa.array(common.per_row(edge, first)), kept], ["id", "n_units", "n_removed", "n_spans", "kept"]))
        kind = pa.schema([("id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
        return pa.Table.from_batches(done, kind)

    return docs.groupBy("chunk").cogroup(_with_copies(spans, gone).groupBy("chunk")).applyInArrow(cut, "id long, n_units long, n_removed long, n_spans long, kept binary")


def remove(docs: DataFrame, match: Match, spec: Spec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All steps; null texts are empty, null ids are one document that comes before all others.

    Rows that repeat id and text have the same answer; rows that share only the id are one document, whose
    texts follow each other in the order of a hash.
    """
    rows, n = chunked(docs, id_col, text_col)
    gone = copies(rows)
    found = pieces(rows, repeated_anchors(rows, gone, n, spec), gone, n, spec)
    return cleaned(rows, matched(found, match, spec), gone, spec).withColumnRenamed("id", id_col)
