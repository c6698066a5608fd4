"""Substring deduplication by suffix automata of reference shards.

A shard of reference text is the distinct content of one owner (see :mod:`pagelens.llm.repeats`): its
automaton holds what came first. Pieces of documents stream through it for matching statistics, the
length of the longest suffix read so far that the reference has; each window of at least the length
threshold is removed, and what is new joins the reference. Broadcasting the automata of all shards
would need memory that grows with the corpus, so pieces travel to their shard instead.

Defined cases: null texts have no words; a window that repeats within one document counts, its first
place stays; rows with one id count as one document; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import common, repeats

WORDS = repeats.Spec(words=True, window=20, gram=10, same_doc=True)


class Automaton:
    """A suffix automaton over hashable symbols that also knows where each state was first read."""

    def __init__(self):
        self.step: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.last, self.size = 0, 0

    def add(self, symbol) -> None:
        step, link, length, first = self.step, self.link, self.length, self.first
        new = len(length)
        step.append({})
        length.append(length[self.last] + 1)
        first.append(self.size)
        link.append(0)
        p = self.last
        while p >= 0 and symbol not in step[p]:
            step[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = step[p][symbol]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(length)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and step[p].get(symbol) == q:
                    step[p][symbol] = copy
                    p = link[p]
                link[q] = link[new] = copy
        self.last, self.size = new, self.size + 1

    def part(self) -> None:
        """End the text: what is added next does not continue what was added before."""
        self.add(object())

    def read(self, symbols: list, window: int) -> list[int]:
        """For each symbol, where the window that ends there was first read to its end; -1 if it never was."""
        step, link, length, first = self.step, self.link, self.length, self.first
        state, n, out = 0, 0, []
        for x in symbols:
            to = step[state].get(x)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = step[state].get(x)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            if n >= window:
                n = window  # the state of the window itself, not of what stands before it
                while length[link[state]] >= window:
                    state = link[state]
                out.append(first[state])
            else:
                out.append(-1)
        return out


def spans_before(pieces: list[tuple[int, list]], window: int) -> list[tuple[int, int, int]]:
    """For pieces in order: the spans (piece, from, to) that are covered by windows that were there before."""
    reference, out = Automaton(), []
    for number, words in pieces:
        seen = reference.read(words, window) if reference.size else [-1] * len(words)
        old = [x >= 0 for x in seen]
        i = window - 1
        while i < len(words):
            if old[i]:
                i += 1
                continue
            j = i
            while j < len(words) and not old[j]:
                j += 1
            fresh = words[i - window + 1 : j]
            if reference.size:
                reference.part()
            base = reference.size
            for x in fresh:
                reference.add(x)
            for k, x in enumerate(reference.read(fresh, window)):  # repeats inside what is new
                if k >= window - 1 and x < base + k:
                    old[i - window + 1 + k] = True
            i = j
        start = end = -1
        for k, flag in enumerate(old):
            if flag and k >= window - 1:
                if end < k - window + 1:
                    if end > 0:
                        out.append((number, start, end))
                    start = k - window + 1
                end = k + 1
        if end > 0:
            out.append((number, start, end))
    return out


def match(ids: np.ndarray, starts: np.ndarray, contents: list[bytes], groups: np.ndarray, spec: repeats.Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One reference for each owner; pieces come in order of document and place."""
    found: list[tuple[int, int, int]] = []
    order = np.argsort(groups, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
        found += spans_before([(int(i), contents[i].split()) for i in some], spec.window)
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """``id, n_units`` (words), ``n_removed, n_spans, kept``: the words left, joined by one space, as UTF-8."""
    return repeats.remove(docs, match, repeats.Spec(True, window, max(1, window // 2), True), id_col, text_col)


def op5_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicate(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(w[i:i + 19], ' ')) ORDER BY doc_id, i) AS r FROM k),
g AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS p FROM r WHERE r > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
t AS (SELECT x.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (g.p IS NULL) AS kept FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""
