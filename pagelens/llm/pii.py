"""Personal data: fixed patterns, and a linear-chain CRF over word shapes that adds what they miss.

Words that hold neither a digit nor ``@`` can only be labelled O, so a text's chain falls apart, exactly,
into runs of the other words; a run is never cut, however long. Runs of like length of all texts of a batch
are decoded together by Viterbi in numpy, in memory that grows with the longest run alone.
The CRF is fitted on the driver on a small labelled table (:func:`labelled_examples` unless given).

Spans are [start, end) in code points. Base spans stay; a CRF span is added only where no base span
overlaps it: numbers that a pattern joined with their neighbours and then dropped, local numbers without a
plus, addresses without a dotted domain.

Defined cases: null texts count as empty and have no spans; rows that repeat are answered row by row; an
empty table gives an empty result; of spans that start together the kind that is listed first comes first;
other columns, of any name, are carried along.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import common

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
#: Added to O's score of every word: higher finds less.
CAUTION = 1.0
#: Words, padding included, that one pass of Viterbi holds.
CELLS = 1 << 15
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_EMAIL_HEAD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARKED = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_DIGIT = re.compile("[0-9]")
_DIGITS = re.compile("[0-9]+")
_LETTER = re.compile(r"[^\W\d_]")
_CARD_ONLY = re.compile("[0-9-]+")
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_TRIM = "\"'[]{}<>.,;:!?|*$%#&"
_SHAPE = [(re.compile(p), c) for p, c in (("[0-9]+", "0"), ("[A-Z]+", "A"), ("[a-z]+", "a"))]
_REST = re.compile(r"([^0-9Aa])\1+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of local part, @ and dotted domain, found from each @ outwards in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _EMAIL_HEAD:
            start -= 1
        tail = _EMAIL_TAIL.match(text, at) if start < at else None
        if tail:
            out.append((start, tail.end()))
            free = tail.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            # a part that a match ends in has no lower limit, so long numbers are told apart by their digits
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def marked_words(text: str) -> list[tuple[int, int]]:
    """The words with a digit or @, trimmed of punctuation around them."""
    out = []
    for m in _MARKED.finditer(text):
        a, b = m.span()
        while a < b and text[a] in _TRIM:
            a += 1
        while b > a and text[b - 1] in _TRIM:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def shape(word: str) -> str:
    """Digits, capitals and other letters as one 0, A and a for each run; runs of other characters as one."""
    for pattern, c in _SHAPE:
        word = pattern.sub(c, word)
    return _REST.sub(r"\1", word)


def features(text: str, a: int, b: int) -> list[str]:
    """What the CRF reads of a word: its whole shape and digits, and the letters near it."""
    word = text[a:b]
    digits = "".join(_DIGITS.findall(word))
    before = re.findall(r"[A-Za-z]+", text[max(0, a - 24) : a])[-1:]
    after = re.findall(r"[A-Za-z]+", text[b : b + 24])[:1]
    out = ["bias", f"shape={shape(word)[:16]}", f"digits={min(len(digits), 20)}", f"dots={min(word.count('.'), 4)}", f"length={min(len(word), 24) // 3}"]
    out += [f"before={x.lower()[:8]}" for x in before] + [f"after={x.lower()[:8]}" for x in after]
    letters = _LETTER.search(word) is not None
    out += ["at"] * ("@" in word) + ["plus"] * word.startswith("+") + ["letters"] * letters + ["gap=="] * (text[max(0, a - 3) : a].strip()[-1:] == "=")
    if 13 <= len(digits) <= 19 and _CARD_ONLY.fullmatch(word):
        out.append(f"luhn={luhn(digits)}")
    if word.count(".") == 3 and _QUAD.fullmatch(word):
        out.append(f"quad={all(int(x) <= 255 for x in word.split('.'))}")
    return out


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Marked words that follow each other with only white space or punctuation between them."""
    out: list[list[tuple[int, int]]] = []
    for a, b in marked_words(text):
        if out and a - out[-1][-1][1] <= 3 and not any(c.isalnum() for c in text[out[-1][-1][1] : a]):
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    return out


def labelled_examples(seed: int = 7, rounds: int = 8) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small labelled table: sentences with the spans of personal data in them."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abdefiklmnorst") for _ in range(rng.randint(3, 8)))

    def card() -> str:
        body = digits(rng.choice([12, 14, 15]))
        body += next(c for c in "0123456789" if luhn(body + c))
        return rng.choice([body, "-".join(body[i : i + 4] for i in range(0, len(body), 4)), " ".join(body[i : i + 4] for i in range(0, len(body), 4))])

    make = {
        "email": lambda: rng.choice([f"{name()}@{name()}", f"{name()}.{digits(2)}@{name()}{digits(1)}.example.com", f"{name()}@localhost", f"{name()}_{name()}@{name()}.org"]),
        "ip": lambda: ".".join(str(rng.randint(0, rng.choice([9, 99, 255]))) for _ in range(4)),
        "card": card,
        "phone": lambda: rng.choice([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"00{digits(2)} {digits(3)} {digits(6)}"]),
    }
    def uncard() -> str:
        """Digits as many as a card's, or more, that are none."""
        body = digits(rng.randint(13, 24))
        return body if not 13 <= len(body) <= 19 or not luhn(body) else body[:-1] + str((int(body[-1]) + 1) % 10)

    plain = {
        "number": lambda: digits(rng.randint(1, 12)),
        "hex": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(16, 40))),
        "long": uncard,
        "year": lambda: str(rng.randint(1700, 2099)),
        "date": lambda: rng.choice([f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2099)}", f"{rng.randint(1900, 2099)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}"]),
        "version": lambda: f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
        "price": lambda: f"{rng.randint(1, 999)}.{digits(2)}",
        "range": lambda: f"{rng.randint(1, 99)}-{rng.randint(100, 999)}",
        "mixed": lambda: f"{name()}{digits(2)}",
        "time": lambda: f"{rng.randint(0, 23)}:{rng.randint(10, 59)}",
        "handle": lambda: f"@{name()}",
    }
    templates = [
        "write to {email} today", "my mail is {email}, please answer", "Contact: {email}", "{email} and {email}", "the server {ip} is down", "from {ip} to {ip}.", "address {ip}",
        "card {card} was charged", "pay with {card} now", "number {card}", "call {phone} after six", "phone: {phone}.", "tel {phone}, fax {phone}", "{phone}", "we met {phone} once",
        "in {year} there were {number} people", "token = \"{hex}\" and more", "id {hex}", "order {long} of {date}", "see {version} from {date}", "it costs {price} or {price}", "pages {range}",
        "{phone} {ip} again", "{phone} {card}", "{card} {card} and", "{long} {card}", "{card} {long}", "{phone} {phone}", "{ip} {ip}", "{ip} {card}", "{email} {phone}", "{year} {card}", "{card} {phone}", "the {card}*** and", "to {phone}### me", "at {ip}%%% it", "ask {email}&&& too", "the {card} of", "a {card} in the", "and {card}. The", "is {phone} with", "in {email} for", "on {ip} to",
        "{number} {number} {number}", "{number} {number} {number} {number} {number} {number}", "the {long} is", "of {long} and", "{long}$$$ the", "x {hex} {long}", "chapter {number} at {time}", "user {mixed} said {number}", "ask {handle} about {year}", "{date} {time}", "the {number} of {mixed}", "room {number}-{number}", "{long} {long}", "{hex} {number}",
    ]
    out = []
    for _ in range(rounds):
        for template in templates:
            text, spans = "", []
            for part in re.split(r"(\{\w+\})", template):
                kind = part[1:-1] if part.startswith("{") else None
                made = part if kind is None else (make.get(kind) or plain[kind])()
                if kind in make:
                    spans.append((kind, len(text), len(text) + len(made)))
                text += made
            out.append((text, spans))
    return out


@dataclass
class Crf:
    index: dict[str, int]
    emit: np.ndarray
    step: np.ndarray
    caution: float = CAUTION

    def scores(self, sequences: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores padded to the longest sequence, and the lengths."""
        lengths = np.array([len(s) for s in sequences])
        out = np.zeros((len(sequences), lengths.max(), len(LABELS)))
        for i, s in enumerate(sequences):
            for j, words in enumerate(s):
                known = [self.index[f] for f in words if f in self.index]
                out[i, j] = self.emit[known].sum(0)
        out[:, :, 0] += self.caution
        return out, lengths

    def decode(self, sequences: list[list[list[str]]]) -> list[list[int]]:
        """Viterbi paths; each sequence is entered from O and left to O. Those of like length go together."""
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        paths: list[list[int]] = [[] for _ in sequences]
        start = 0
        while start < len(order):
            some = order[start : start + max(1, CELLS // len(sequences[order[start]]))]
            start += len(some)
            for i, path in zip(some, self._decode([sequences[i] for i in some])):
                paths[i] = path
        return paths

    def _decode(self, sequences: list[list[list[str]]]) -> list[list[int]]:
        e, lengths = self.scores(sequences)
        n, most, k = e.shape
        best = e[:, 0] + self.step[0]
        back = np.zeros((n, most, k), np.int8)
        final = np.where((lengths == 1)[:, None], best, -np.inf)
        for t in range(1, most):
            through = best[:, :, None] + self.step[None]
            back[:, t] = through.argmax(1)
            best = through.max(1) + e[:, t]
            final = np.where((lengths == t + 1)[:, None], best, final)
        last = (final + self.step[:, 0]).argmax(1)
        paths = []
        for i, size in enumerate(lengths):
            path = [int(last[i])]
            for t in range(size - 1, 0, -1):
                path.append(int(back[i, t, path[-1]]))
            paths.append(path[::-1])
        return paths


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(examples: list[tuple[str, list[tuple[str, int, int]]]] | None = None, steps: int = 150, l2: float = 0.02, caution: float = CAUTION) -> Crf:
    """Maximum likelihood with an L2 penalty, by Adam on batch gradients from forward-backward sums."""
    sequences, golds = [], []
    for text, spans in labelled_examples() if examples is None else examples:
        for run in runs(text):
            gold, owner = [], None
            for a, b in run:
                mine = next((s for s in spans if a < s[2] and b > s[1]), None)
                gold.append(0 if mine is None else LABELS.index(f"{'I' if mine is owner else 'B'}-{mine[0]}"))
                owner = mine
            sequences.append([features(text, a, b) for a, b in run])
            golds.append(gold)
    index = {f: i for i, f in enumerate(sorted({f for s in sequences for w in s for f in w}))}
    k, n, most = len(LABELS), len(sequences), max(map(len, sequences))
    lengths = np.array([len(s) for s in sequences])
    where = [(index[f], i, j) for i, s in enumerate(sequences) for j, w in enumerate(s) for f in w]
    fi, si, ti = (np.array(x) for x in zip(*where))
    gold = np.zeros((n, most, k))
    gold_step = np.zeros((k, k))
    for i, g in enumerate(golds):
        for j, y in enumerate(g):
            gold[i, j, y] = 1
        for a, b in zip([0, *g], [*g, 0]):
            gold_step[a, b] += 1
    # I-x follows B-x or I-x alone
    allowed = np.array([[not b.startswith("I-") or a[2:] == b[2:] for b in LABELS] for a in LABELS])
    model = Crf(index, np.zeros((len(index), k)), np.zeros((k, k)), caution)
    theta, moments = [model.emit, model.step], [[np.zeros_like(x) for x in (model.emit, model.step)] for _ in range(2)]
    inside = np.arange(most)[None] < lengths[:, None]
    for t in range(1, steps + 1):
        e = np.zeros((n, most, k))
        np.add.at(e, (si, ti), model.emit[fi])
        step = np.where(allowed, model.step, -1e4)
        alpha, beta = np.zeros((n, most, k)), np.zeros((n, most, k))
        alpha[:, 0] = step[0] + e[:, 0]
        for j in range(1, most):
            alpha[:, j] = _logsum(alpha[:, j - 1, :, None] + step[None], 1) + e[:, j]
        beta[np.arange(n), lengths - 1] = step[:, 0]
        for j in range(most - 2, -1, -1):
            on = _logsum(step[None] + (e[:, j + 1] + beta[:, j + 1])[:, None], 2)
            beta[:, j] = np.where((j < lengths - 1)[:, None], on, beta[:, j])
        z = _logsum(alpha[np.arange(n), lengths - 1] + step[:, 0], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * inside[:, :, None]
        diff = p - gold
        g_emit = np.zeros_like(model.emit)
        np.add.at(g_emit, fi, diff[si, ti])
        both = np.exp(alpha[:, :-1, :, None] + step[None, None] + (e[:, 1:] + beta[:, 1:])[:, :, None] - z[:, None, None, None]) * inside[:, 1:, None, None]
        g_step = both.sum((0, 1)) - gold_step
        g_step[0] += p[:, 0].sum(0)
        g_step[:, 0] += p[np.arange(n), lengths - 1].sum(0)
        g_step[~allowed] = 0
        for x, g, m, v in zip(theta, (g_emit + l2 * model.emit, g_step + l2 * model.step), *moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.step = np.where(allowed, model.step, -1e4)
    return model


def crf_spans(texts: list[str], model: Crf) -> list[list[tuple[str, int, int]]]:
    """The CRF's own spans of each text, in order."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    each = [(i, run) for i, t in enumerate(texts) for run in runs(t)]
    for (i, run), path in zip(each, model.decode([[features(texts[i], a, b) for a, b in run] for i, run in each]), strict=True):
        j = 0
        while j < len(run):
            kind, stop = LABELS[path[j]][2:], j + 1
            while stop < len(run) and LABELS[path[stop]] == f"I-{kind}":
                stop += 1
            if kind:
                out[i].append((kind, run[j][0], run[stop - 1][1]))
            j = stop
    return out


def found(texts: list[str], model: Crf) -> list[list[tuple[str, int, int, bool]]]:
    """All spans of each text, by kind as listed, then start; the last field tells base spans."""
    out = []
    for text, added in zip(texts, crf_spans(texts, model), strict=True):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        reach = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0, int)
        at = [a for a, _ in taken]
        # of the base spans that start before its end, the farthest must end before it starts
        free = [(k, a, b, False) for k, a, b in added if not (n := bisect_left(at, b)) or reach[n - 1] <= a]
        out.append(sorted([(k, a, b, True) for k, a, b in base] + free, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))
    return out


@lru_cache(1)
def default_model() -> Crf:
    """The CRF of the labelled examples, fitted once a session."""
    return fit()


def detect(docs: DataFrame, text_col: str = "text", model: Crf | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``spans``: an array of kind, start, end and whether a fixed pattern found it; an input column of that name is replaced.

    Without ``keep_text`` the text column is left out, so that texts don't travel back from Python.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())
    rest, unpack = common.carried(docs, text_col, ("spans", *[text_col] * (not keep_text)))
    mark = np.zeros(256, np.int64)
    mark[[*range(48, 58), 64]] = 1
    names = ["rest_", *["text_"] * keep_text]

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for b in common.blocks(batches, "text_"):
            column = b.column("text_")
            data, at = common.utf8(column)
            rows = np.flatnonzero(common.per_row(mark[data], at))
            spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
            texts = column.take(pa.array(rows)).to_pylist()
            for i, x in zip(rows, found(texts, shared.value), strict=True):
                spans[i] = [dict(zip(("kind", "start", "end", "base"), s)) for s in x]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(spans, kind)], [*names, "spans_"])

    return rest.mapInArrow(run, common.schema_with([rest.schema[n] for n in names], f"spans_ {SPANS}")).select(*unpack, F.col("spans_").alias("spans"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = detect(common.read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)

    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long")

    base = F.filter("spans", lambda x: x["base"])
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return docs.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
