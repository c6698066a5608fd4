"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, with character references
decoded and white space turned into one space. Each block is read as hashed vectors of its tag path
(tags, classes, ids, roles of its ``DEPTH`` nearest elements), the mean of hashed word vectors and a few
counts; a bidirectional LSTM in numpy reads the whole page's sequence and classifies every block. The kept
blocks are joined by "\n".

The labeller is fitted on the driver, from a seeded generator of labelled pages (:func:`synthetic_pages`),
once a session and in a few seconds. Scripts, styles, templates, drawings, frames, text fields, comments in
the markup and the head hold no text, and do not end the block that they stand in; what other elements hold,
fallback text and formulas included, is up to the labeller. Nothing is cut: pages of any length and nesting
are read whole, in memory that grows with the page.

Defined cases: null and empty pages and pages without a main part give an empty text; a head that is not
closed ends at the first tag or text that no head can hold; rows that repeat are answered row by row; an
empty table gives an empty result; other columns, of any name, are carried along.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import common

PATH_BUCKETS, WORD_BUCKETS = 1 << 11, 1 << 11
PATH_DIM, WORD_DIM, DENSE_DIM, HIDDEN = 16, 8, 9, 24
#: Blocks that one padded pass of the labeller may hold.
PASS_BLOCKS = 1 << 15
#: Nearest elements that make a block's path.
DEPTH = 24

_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Fixed by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNREAD = frozenset("iframe noembed noframes script style svg template textarea title".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark noscript object q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements of formulas, fixed by the MathML standard; they run on in their block.
INLINE |= frozenset("math annotation menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot tr select div section article main aside nav header footer form body html blockquote td th li".split())


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int = 0


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    out = [f"<{tag}"]
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            out += [x.lower() for x in _NAME.findall(m[2] or m[3] or m[4] or "")][:12]
    return tuple(out)


def _after(page: str, tag: str, at: int) -> int:
    """Where an element whose text is not read ends."""
    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
    return end.end() if end else len(page)


def _after_head(page: str, at: int) -> int:
    """Where the head that begins at ``at`` ends: at its end tag, or before what no head can hold."""
    while True:
        m = _TAG.search(page, at)
        if page[at : m.start() if m else len(page)].strip() or not m:
            return at
        tag = (m[2] or "").lower()
        if tag and tag not in HEAD:
            return m.end() if m[1] and tag == "head" else m.start()
        at = _after(page, tag, m.end()) if tag in UNREAD and not m[1] and not m[3].endswith("/") else m.end()


def leaf_blocks(page: str) -> Iterator[Block]:
    """The text blocks of a page in order, read leniently: unclosed tags end with what holds them."""
    stack: list[tuple[str, tuple[str, ...]]] = []  # tag, own tokens
    open_ = Counter()
    parts: list[str] = []
    linked, links, at = 0, 0, 0

    def flush() -> Block | None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        block = Block(text, tuple(t for _, own in stack[-DEPTH:] for t in own), linked) if text else None
        linked = 0
        return block

    def close(i: int) -> None:
        for tag, _ in stack[i:]:
            open_[tag] -= 1
        del stack[i:]

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            parts.append(page[at:stop])
            linked += (stop - at) * (links > 0)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in UNREAD:
            if not m[1] and not m[3].endswith("/"):
                at = _after(page, tag, at)
            continue
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                parts.append(" ")
            elif tag == "a":
                links = max(0, links + (-1 if m[1] else 1))
            continue
        block = flush()
        if block:
            yield block
        links = 0
        if m[1]:
            if open_[tag] > 0:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                close(i)
            continue
        if tag == "head":
            at = _after_head(page, at)
            continue
        if tag in VOID:
            continue
        if stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        same = SAME_LEVEL.get(tag, ())
        if any(open_[x] > 0 for x in same):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in same:
                    close(i)
                    break
                if stack[i][0] in CONTAINERS:
                    break
        stack.append((tag, _tokens(tag, m[3])))
        open_[tag] += 1
    block = flush()
    if block:
        yield block


def _bucket(token: str, n: int) -> int:
    return zlib.crc32(token.encode()) % n


_STOP = np.zeros(256, np.int64)
_STOP[list(b".,;:!?")] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


@dataclass
class Inputs:
    """What the labeller reads of the blocks of some pages, end to end."""

    path: np.ndarray  # which distinct path
    paths: list[np.ndarray]  # buckets of each distinct path
    word_block: np.ndarray
    word_bucket: np.ndarray
    n_words: np.ndarray
    dense: np.ndarray
    pages: np.ndarray  # offsets of pages


def inputs(pages: list[list[Block]]) -> Inputs:
    flat = [b for p in pages for b in p]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64)
    known: dict[tuple[str, ...], int] = {}
    path = np.array([known.setdefault(b.path, len(known)) for b in flat], np.int64)
    paths = [np.array([_bucket(t, PATH_BUCKETS) for t in p], np.int64) for p in known]
    data, at = common.utf8(pa.array([b.text for b in flat], pa.string()))
    words = common.Words(data, at)
    n_words = np.diff(words.first)
    chars = np.maximum(np.diff(at), 1)
    page = np.repeat(np.arange(len(pages)), np.diff(offsets))
    index = np.arange(len(flat)) - offsets[page]
    total = np.diff(offsets)[page]
    last = data[at[1:] - 1] if len(flat) else np.zeros(0, np.uint8)
    dense = np.stack([
        np.log1p(n_words) / 4,
        np.minimum(np.array([b.linked for b in flat], float) / chars, 1.0),
        common.per_row(_STOP[data], at) / np.maximum(n_words, 1),
        common.per_row(_DIGIT[data], at) / chars,
        common.per_row(_UPPER[data], at) / np.maximum(n_words, 1) / 4,
        np.isin(last, list(b".!?")).astype(float),
        index / np.maximum(total, 1),
        chars / np.maximum(n_words, 1) / 20,
        np.log1p(total) / 5,
    ], 1) if flat else np.zeros((0, DENSE_DIM))
    return Inputs(path, paths, words.row, (words.hash % np.uint64(WORD_BUCKETS)).astype(np.int64), n_words, np.minimum(dense, 4.0), offsets)


@dataclass
class Labeller:
    """Tables of path and word vectors, and for each direction the LSTM's weights; ``out`` reads both."""

    w: dict[str, np.ndarray]

    def embed(self, x: Inputs) -> np.ndarray:
        each = np.stack([self.w["path"][p].sum(0) if len(p) else np.zeros(PATH_DIM) for p in x.paths]) if x.paths else np.zeros((0, PATH_DIM))
        words = np.zeros((len(x.path), WORD_DIM))
        for j in range(WORD_DIM):
            words[:, j] = np.bincount(x.word_block, self.w["word"][x.word_bucket, j], minlength=len(x.path))
        words /= np.maximum(x.n_words, 1)[:, None]
        return np.concatenate([each[x.path] if len(x.path) else each, words, x.dense], 1)

    def scan(self, e: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states of a padded batch (pages, blocks, inputs), in reading order of ``side``."""
        n, t, _ = e.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out = np.zeros((n, t, HIDDEN))
        into = e @ self.w[f"{side}x"] + self.w[f"{side}b"]
        for j in range(t) if side == "f" else range(t - 1, -1, -1):
            z = into[:, j] + h @ self.w[f"{side}h"]
            g = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, a = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            on = mask[:, j, None]
            new = np.where(on, f * c + i * a, c)
            tc = np.tanh(new)
            if keep is not None:
                keep.append((j, h, c, i, f, o, a, tc))
            h, c = np.where(on, o * tc, h), new
            out[:, j] = h
        return out

    def predict(self, x: Inputs) -> np.ndarray:
        """The logit of each block; pages of like length go through together."""
        e, sizes = self.embed(x), np.diff(x.pages)
        out, order, start = np.zeros(len(e)), np.argsort(-sizes, kind="stable"), 0
        order = order[sizes[order] > 0]
        while start < len(order):
            longest = sizes[order[start]]
            some = order[start : start + max(1, PASS_BLOCKS // longest)]
            start += len(some)
            batch, mask = np.zeros((len(some), longest, e.shape[1])), np.zeros((len(some), longest), bool)
            for r, p in enumerate(some):
                batch[r, : sizes[p]], mask[r, : sizes[p]] = e[x.pages[p] : x.pages[p + 1]], True
            h = np.concatenate([self.scan(batch, mask, "f"), self.scan(batch, mask, "r")], 2)
            logit = h @ self.w["out"] + batch @ self.w["skip"] + self.w["bias"][0]
            for r, p in enumerate(some):
                out[x.pages[p] : x.pages[p + 1]] = logit[r, : sizes[p]]
        return out


_SYLLABLES = "an er the on es ti re at en is or it ha le ou in de la um ber sch ung ción que os ar mo ki po za".split()


def synthetic_pages(n: int = 1200, seed: int = 11) -> Iterator[tuple[str, str]]:
    """Labelled pages: the html, where blocks of the main text begin with the mark U+E000."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))

    def words(a: int, b: int) -> str:
        out = [word() for _ in range(rng.randint(a, b))]
        kind = rng.random()
        if kind < 0.1:
            out = [w + rng.choice(["***", "%%%", "###", "&amp;"]) for w in out]
        elif kind < 0.15:
            out = [w.upper() + "!!" for w in out]
        elif kind < 0.2:
            return " | ".join(out)
        elif kind < 0.25:
            out = [w if rng.random() < 0.8 else str(rng.randint(0, 9999)) for w in out]
        elif kind < 0.3:  # a word over and over
            some = out[: rng.randint(1, 4)]
            out = [w for w in some for _ in range(max(1, len(out) // len(some)))]
        return " ".join(out).capitalize() + rng.choice([".", ".", "", "!", "?"])

    def attribute(names: list[str]) -> str:
        name = rng.choice(names)
        name = rng.choice([name, name, f"{rng.choice(['site', 'page', 'main', 'post', 'c', 'box', 'block'])}-{name}", f"{name}-{rng.choice(['wrap', 'box', 'inner', '1', 'list', 'area'])}", f"{name} {word()}"])
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def links(a: int, b: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{words(1, 3)}</a></{tag}>' for _ in range(rng.randint(a, b)))

    def boilerplate() -> str:
        kind = rng.choice(["nav", "nav", "header", "footer", "footer", "aside", "ad", "ad", "notice", "form", "comments", "comments", "related", "share"])
        p = lambda a, b: f"<{(t := rng.choice(['p', 'div', 'span', 'p']))}>{words(a, b)}</{t}>"
        if kind == "nav":
            inner = f"<ul>{links(2, 8)}</ul>" if rng.random() < 0.8 else links(2, 8, "div")
            return rng.choice([f"<nav>{inner}</nav>", f"<nav{attribute(['menu', 'navigation'])}>{inner}</nav>", f"<div{attribute(['menu', 'nav', 'navbar', 'breadcrumb', 'breadcrumbs', 'navigation', 'topbar', 'toolbar'])}>{inner}</div>", f'<div role="navigation">{inner}</div>', inner if rng.random() < 0.3 else f"<ul{attribute(['menu', 'nav'])}>{links(2, 8)}</ul>"])
        if kind == "header":
            inner = rng.choice([f"<h1>{words(1, 5)}</h1>", f"<div>{words(1, 5)}</div>", ""]) + rng.choice(["", p(1, 8)]) + rng.choice(["", f"<ul>{links(2, 5)}</ul>"])
            return rng.choice([f"<header>{inner}</header>", f"<div{attribute(['header', 'masthead', 'banner', 'logo', 'branding', 'top'])}>{inner}</div>"])
        if kind == "footer":
            inner = rng.choice(["&copy; ", "Copyright ", "", "&middot; "]) + words(1, 20) + rng.choice(["", f"<ul>{links(1, 5)}</ul>", p(2, 25)])
            return rng.choice([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{attribute(['footer', 'bottom', 'copyright', 'colophon', 'legal'])}>{inner}</div>"])
        if kind == "aside":
            inner = rng.choice(["", f"<h3>{words(1, 4)}</h3>"]) + "".join(p(2, 40) for _ in range(rng.randint(1, 4))) + rng.choice(["", f"<ul>{links(1, 5)}</ul>"])
            return rng.choice([f"<aside>{inner}</aside>", f"<aside{attribute(['sidebar', 'widget'])}>{inner}</aside>", f"<div{attribute(['sidebar', 'side', 'widget', 'rail', 'aside', 'secondary'])}>{inner}</div>"])
        if kind == "ad":
            inner = rng.choice([words(1, 30), p(1, 30), p(1, 12) + p(1, 12)])
            return f"<{(t := rng.choice(['div', 'div', 'section', 'aside', 'p']))}{attribute(['ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner', 'sponsor', 'adsense', 'promotion'])}>{inner}</{t}>"
        if kind == "notice":
            inner = rng.choice([words(2, 30), p(2, 30)]) + rng.choice(["", "<button>OK</button>", f"<button>{words(1, 2)}</button>"])
            return f"<{(t := rng.choice(['div', 'div', 'section']))}{attribute(['cookie', 'cookies', 'notice', 'consent', 'gdpr', 'alert', 'popup', 'modal', 'newsletter', 'subscribe', 'message', 'warning', 'paywall', 'disclaimer'])}>{inner}</{t}>"
        if kind == "form":
            inner = "".join(rng.choice([f"<label>{words(1, 3)}</label><input name=x>", f"<p>{words(1, 12)}</p>", f"<select><option>{words(1, 2)}</option><option>{words(1, 2)}</option></select>", f"<button>{words(1, 2)}</button>", f"<div>{words(1, 4)}</div>"]) for _ in range(rng.randint(1, 4)))
            return f"<form{rng.choice(['', attribute(['search', 'login', 'signup', 'form', 'contact'])])}>{inner}</form>"
        if kind == "comments":
            one = lambda: rng.choice([f'<div class="comment">{p(3, 40)}</div>', f"<li>{p(3, 40)}</li>", p(3, 40), f'<article class="comment"><b>{word()}</b> {p(3, 40)}</article>', f"<div><b>{word()}</b><p>{words(3, 40)}</p></div>"])
            inner = rng.choice(["", f"<h2>{words(1, 3)}</h2>", "<h3>Comments</h3>"]) + "".join(one() for _ in range(rng.randint(1, 5)))
            return f"<{(t := rng.choice(['div', 'section', 'ol', 'ul']))}{attribute(['comments', 'comment', 'replies', 'reader-comments', 'discussion', 'responses', 'disqus', 'comment-list', 'respond'])}>{inner}</{t}>"
        if kind == "related":
            return f"<{(t := rng.choice(['div', 'section', 'aside']))}{attribute(['related', 'recommended', 'popular', 'more', 'trending', 'teaser', 'recirculation'])}>{rng.choice(['', f'<h3>{words(1, 3)}</h3>'])}<ul>{links(2, 6)}</ul></{t}>"
        return f"<div{attribute(['share', 'social', 'sharing', 'tags', 'meta', 'byline', 'toolbar', 'pagination', 'author'])}>{words(1, 6)}{links(0, 4, 'span')}</div>"

    for _ in range(n):
        mark = "\ue000"
        body = rng.choice([f"<h1>{mark}{words(2, 10)}</h1>", f"<h1>{mark}{words(2, 10)}</h1>", ""])
        again = words(1, rng.choice([2, 4, 30])) if rng.random() < 0.15 else None  # a text that repeats one paragraph
        for _ in range(int(rng.choice([1, 1, 2, 3, 5, 8, 12, 20] if again is None else [8, 20, 40, 60]))):
            kind, text = rng.random(), words(1, int(rng.choice([1, 1, 3, 15, 60, 120])))
            if again is not None and rng.random() < 0.9:
                body += rng.choice([f"<p>{mark}{again}</p>"] * 6 + [f"<p><b>{mark}{again}<br>"])
                continue
            if kind < 0.12:
                body += f"<p><b>{mark}{text}<br>"
            elif kind < 0.16:
                body += f"<blockquote><p>{mark}{text}</p></blockquote>"
            elif kind < 0.2:
                body += f"<h{(k := rng.randint(2, 4))}>{mark}{words(1, 6)}</h{k}>"
            elif kind < 0.24:
                body += f"<{(t := rng.choice(['ul', 'ol']))}>" + "".join(f"<li>{mark}{words(2, 20)}</li>" for _ in range(rng.randint(2, 5))) + f"</{t}>"
            elif kind < 0.26:
                body += f"<pre>{mark}{text}</pre>"
            elif kind < 0.28:
                body += f"<table><tr><td>{mark}{words(1, 4)}</td><td>{mark}{words(1, 4)}</td></tr></table>"
            elif kind < 0.33:
                body += f'<p>{mark}{words(2, 20)} <a href="/{word()}">{words(1, 3)}</a> <em>{words(1, 8)}</em></p>'
            elif kind < 0.36:
                body += f"<div>{mark}{text}</div>"
            else:
                body += f"<p>{mark}{text}</p>"
            if again is None and rng.random() < 0.06:  # a stretch of short paragraphs, alike or not
                short = [words(1, rng.choice([1, 2, 3])) for _ in range(rng.choice([1, 1, 2, 8]))]
                body += "".join(rng.choice([f"<p>{mark}{x}</p>"] * 6 + [f"<p><b>{mark}{x}<br>"]) for x in rng.choices(short, k=rng.choice([5, 12, 30, 50])))
            if rng.random() < 0.08:
                body += boilerplate()
        if rng.random() < 0.35:  # comments, shares and adverts often end an article from within
            body += boilerplate()
        open_, close = rng.choice([("<article>", "</article>")] * 5 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div{attribute(['content', 'article', 'post', 'entry', 'story', 'text', 'body', 'main'])}>", "</div>"), (f"<div{attribute(['content', 'article', 'post', 'entry', 'story', 'text', 'body'])}>", "</div>"), (f"<section{attribute(['content', 'article', 'post', 'entry'])}>", "</section>"), (f'<article class="{rng.choice(["post", "entry", "story", word()])}">', "</article>"), ("<div>", "</div>")])
        before = "".join(boilerplate() for _ in range(rng.randint(0, 4)))
        after = "".join(boilerplate() for _ in range(rng.randint(0, 4)))
        main = open_ + body + close if rng.random() < 0.97 else ""
        page = rng.choice([f"{before}{main}{after}", f"<div{rng.choice(['', attribute(['container', 'wrapper', 'page', 'layout'])])}>{before}{main}{after}</div>"])
        yield f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{margin:0}}</style></head><body>{page}{rng.choice(['</body></html>', ''])}", mark


def fit(pages: Iterator[tuple[str, str]] | None = None, epochs: int = 9, batch: int = 24, seed: int = 5, rate: float = 0.01) -> Labeller:
    """Adam on the cross entropy of every block, with gradients through time."""
    rng = np.random.default_rng(seed)
    blocks, gold = [], []
    for page, mark in synthetic_pages() if pages is None else pages:
        found = [b for b in leaf_blocks(page)]
        gold.append(np.array([mark in b.text for b in found], float))
        for b in found:
            b.text = b.text.replace(mark, "")
        blocks.append(found)
    d = PATH_DIM + WORD_DIM + DENSE_DIM
    w = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM)), "out": rng.normal(0, 0.2, 2 * HIDDEN), "skip": np.zeros(d), "bias": np.zeros(1)}
    for s in "fr":
        w |= {f"{s}x": rng.normal(0, 0.2, (d, 4 * HIDDEN)), f"{s}h": rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), f"{s}b": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}
    model, moments, step = Labeller(w), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(blocks))
        for start in range(0, len(order), batch):
            some = order[start : start + batch]
            x = inputs([blocks[i] for i in some])
            y = np.concatenate([gold[i] for i in some])
            e, sizes = model.embed(x), np.diff(x.pages)
            if not len(e):
                continue
            # half of the blocks are read without their words, so that no word outweighs a path
            read = rng.random(len(e)) < 0.5
            e[~read, PATH_DIM : PATH_DIM + WORD_DIM] = 0
            page = np.repeat(np.arange(len(some)), sizes)
            col = np.arange(len(e)) - x.pages[page]
            padded, mask = np.zeros((len(some), sizes.max(), d)), np.zeros((len(some), sizes.max()), bool)
            padded[page, col], mask[page, col] = e, True
            kept: dict[str, list] = {"f": [], "r": []}
            h = np.concatenate([model.scan(padded, mask, s, kept[s]) for s in "fr"], 2)
            logit = h[page, col] @ w["out"] + e @ w["skip"] + w["bias"][0]
            g = (1 / (1 + np.exp(-logit)) - y) / len(y)
            grad = {k: np.zeros_like(v) for k, v in w.items()}
            grad["out"], grad["bias"][0], grad["skip"] = h[page, col].T @ g, g.sum(), e.T @ g
            dh_all, de = np.zeros_like(h), np.zeros_like(padded)
            dh_all[page, col] = g[:, None] * w["out"]
            de[page, col] = g[:, None] * w["skip"]
            for s, at in (("f", 0), ("r", HIDDEN)):
                dh, dc = np.zeros((len(some), HIDDEN)), np.zeros((len(some), HIDDEN))
                for j, h0, c0, i, f, o, a, tc in reversed(kept[s]):
                    on = mask[:, j, None]
                    dh = dh + dh_all[:, j, at : at + HIDDEN]
                    dn = dc + np.where(on, dh * o * (1 - tc * tc), 0)
                    dz = np.where(on, np.concatenate([dn * a * i * (1 - i), dn * c0 * f * (1 - f), dh * tc * o * (1 - o), dn * i * (1 - a * a)], 1), 0)
                    grad[f"{s}x"] += padded[:, j].T @ dz
                    grad[f"{s}h"] += h0.T @ dz
                    grad[f"{s}b"] += dz.sum(0)
                    de[:, j] += dz @ w[f"{s}x"].T
                    dh, dc = np.where(on, dz @ w[f"{s}h"].T, dh), np.where(on, dn * f, dc)
            flat = de[page, col]
            for p, buckets in enumerate(x.paths):
                np.add.at(grad["path"], buckets, flat[x.path == p, :PATH_DIM].sum(0))
            share = flat[:, PATH_DIM : PATH_DIM + WORD_DIM] * read[:, None] / np.maximum(x.n_words, 1)[:, None]
            np.add.at(grad["word"], x.word_bucket, share[x.word_block])
            step += 1
            pace = rate * (1 - 0.9 * (epoch / epochs))
            for k, v in w.items():
                m, s2 = moments[k]
                m += 0.1 * (grad[k] - m)
                s2 += 0.01 * (grad[k] ** 2 - s2)
                v -= pace * (m / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.99**step)) + 1e-8)
    return model


@lru_cache(1)
def default_model() -> Labeller:
    """The labeller of the generator's pages, fitted once a session."""
    return fit()


def extract(pages: DataFrame, html_col: str = "html", model: Labeller | None = None, text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each page in ``text_col``; the html column is dropped, a column of that name replaced."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())
    rest, unpack = common.carried(pages, html_col, (html_col, text_col))

    def run(batches):
        for b in common.blocks(batches, "text_"):
            found = [list(leaf_blocks(p)) if p else [] for p in b.column("text_").to_pylist()]
            x = inputs(found)
            good = shared.value.predict(x) > 0 if len(x.path) else np.zeros(0, bool)
            texts = ["\n".join(block.text for block, g in zip(p, good[x.pages[i] : x.pages[i + 1]]) if g) for i, p in enumerate(found)]
            yield pa.RecordBatch.from_arrays([b.column("rest_"), pa.array(texts, pa.string())], ["rest_", "main_"])

    return rest.mapInArrow(run, common.schema_with([rest.schema["rest_"]], "main_ string")).select(*unpack, F.col("main_").alias(text_col))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
