"""Small cases and brute force for the operators of pagelens.llm."""

import collections
import hashlib
import html
import itertools
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelens.llm import ann, automaton, bpe, common, html_main, mixing, ngram_join, pii, quality, repeats, secrets, suffix_levels

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# components


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        i, j = find(a), find(b)
        root[max(i, j)] = min(i, j)
    got = dict(rows_of(common.components(spark.createDataFrame(links + [(None, 3)], "a long, b long"))))
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}


# op1


def test_mix_matches_sql(spark, sf_dir):
    got = mixing.op1_source_mix(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = c.sql(mixing.OP1_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert (got == want[got.columns]).all().all()


def test_mix_cases(docs, empty):
    got = mixing.mix(docs).toPandas()
    assert len(got) == docs.count() and (got.taken <= 2 * got["size"]).all()
    assert abs(got.groupby("source", dropna=False).target.first().sum() - 1.5 * got["size"].sum()) < 1e-6
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    again = mixing.mix(docs.repartition(3)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    wide = docs.withColumn("size", F.lit("own")).withColumn("target", F.lit(1))
    assert mixing.mixed(wide).columns == wide.columns


# op2


def brute_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i].append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = [(i, s) for i, some in sets.items() for s in some if s]
    for k, (i, a) in enumerate(every):
        for j, b in every[:k]:
            if 100 * len(a & b) >= 80 * len(a | b) and find(i) != find(j):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, some in sets.items() for s in some}


@pytest.mark.parametrize(("few", "heavy", "block"), [(24, 64, 4_000_000), (3, 4, 1500), (2, 4, 300)])
def test_ngram_join_brute(spark, monkeypatch, few, heavy, block):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", block)
    monkeypatch.setattr(ngram_join, "FAN", 2 if few == 3 else 64)
    rng = random.Random(few)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(n)] for n in (3, 5, 12, 40, 90)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(["Zz", "q", "A"])
        rows.append((i * 3 - 60, rng.choice([" ".join(w), " ".join(w).upper(), None if i % 20 == 0 else "\n".join(w), "" if i % 17 == 0 else " ".join(w)])))
    got = {tuple(r)[:3] for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_components(rows)


def test_ngram_join_cases(docs, empty):
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.classes(docs).collect()}
    assert got[1] == got[2] and got[3] == got[1] and got[4] == 4 and got[5] == 5 and got[6] == 6 and got[None] is None
    assert ngram_join.classes(empty).count() == 0


# op3


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    ranks = bpe.load_ranks(bpe.default_ranks())
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("ab =é1\n", max_size=400))
def test_fold_is_tiktoken(text):
    import public_tokenizers
    import regex

    ranks = _ranks()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert [x for w in regex.findall(public_tokenizers.PATTERN, text) for x in bpe.fold(w.encode(), ranks)] == enc.encode_ordinary(text)


def _ranks(cache={}):
    if not cache:
        cache.update(bpe.load_ranks(bpe.default_ranks()))
    return cache


def test_bpe_round_trip(docs, empty, tokenizer):
    ranks, enc = tokenizer
    for r in bpe.encode(docs, decoded=True).collect():
        text = r["text"] or ""
        assert list(r["ids"]) == enc.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    again = bpe.decode(bpe.encode(docs.select("text")))
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in again.collect())
    assert bpe.encode(empty).count() == 0


def test_bpe_higher_order(spark, tokenizer):
    words = spark.createDataFrame([(w,) for w in ("hello", " world", "é", "", "zzzzqqq", " the", "naïve")], "word string")
    for r in bpe.fold_words(words).collect():
        assert tuple(r["ids"]) == (bpe.fold(r["word"].encode(), tokenizer[0]) if r["word"] else ())


# op4


def test_leaf_blocks():
    page = '<html><head><title>T</title></head><body><nav><a href="/">Home</a></nav><article><p>One &amp; <b>two<br>three</p><script>var a="<p>x</p>";</script><!-- <p>no</p> --><p>Four\n five</article>'
    assert [b.text for b in html_main.leaf_blocks(page)] == ["Home", "One & two three", "Four five"]


def test_html_held_out(spark):
    model = html_main.fit()
    right = total = 0
    for page, mark in html_main.synthetic_pages(150, seed=123):
        blocks = list(html_main.leaf_blocks(page))
        gold = np.array([mark in b.text for b in blocks], bool)
        for b in blocks:
            b.text = b.text.replace(mark, "")
        right += int(((model.predict(html_main.inputs([blocks])) > 0) == gold).sum()) if blocks else 0
        total += len(blocks)
    assert right / total > 0.95
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", "<p>"), (4, "u", "<article><p>Some words stand here.</p><p>And a few more of them.</p></article><footer>&copy; me</footer>")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_main.extract(pages, model=model).collect()}
    assert got[1] == got[2] == got[3] == "" and got[4] == "Some words stand here.\nAnd a few more of them."


# op5, op7


def brute_words(rows, w):
    seen, out = set(), {}
    for i, t in rows:
        ws = (t or "").encode().split()
        gone = [False] * len(ws)
        for s in range(len(ws) - w + 1):
            k = tuple(ws[s : s + w])
            if k in seen:
                gone[s : s + w] = [True] * w
            seen.add(k)
        out[i] = (len(ws), sum(gone), b" ".join(x for x, g in zip(ws, gone) if not g))
    return out


def brute_bytes(rows, w):
    first, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - w + 1):
            first.setdefault(b[s : s + w], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - w + 1):
            if first[b[s : s + w]] < i:
                gone[s : s + w] = b"\1" * w
        out[i] = (len(b), sum(gone), sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1])), bytes(x for x, g in zip(b, gone) if not g))
    return out


def test_ngram_join_repeated_row(spark):
    """A row that is repeated, or an id with several texts, inside a near-duplicate family: one row for each row."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (7, a + " more"), (7, a + " more"), (8, a + " else"), (20, b), (30, b + " more"), (30, a + " last"), (40, "none like it")]
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["n_equal"]) for r in got) == [(1, 1, 1), (7, 1, 2), (7, 1, 2), (8, 1, 1), (20, 1, 1), (30, 1, 1), (30, 1, 1), (40, 40, 1)]


@pytest.fixture
def crowded(spark, monkeypatch):
    """Texts with 160 shingles a slot and passages that 30 of them share, the last 20 near copies; and how many texts a join lets meet."""
    rng, few = np.random.default_rng(5), []
    phrases = [" ".join(f"p{i}x{k}" for k in range(6)) for i in range(130)]
    texts = [[f"w{x}" for x in rng.integers(0, 10**9, 200)] for _ in range(780)]
    for i, words in enumerate(texts):
        for k in range(5):
            words[40 * k + 20] = phrases[(i * 5 + k * 31) % 130]
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    rows += [(1000 + i, " ".join(words[:-2])) for i, words in enumerate(texts[:20])]
    for name, value in (("LEAST_BITS", 10), ("MOST_BITS", 10), ("FEW", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    held = ngram_join.held
    monkeypatch.setattr(ngram_join, "held", lambda rows, wanted, buckets: few.append(wanted.count()) or held(rows, wanted, buckets))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return rows, df, few


def test_ngram_join_crowded_sketch(crowded, monkeypatch):
    """Shared passages must not make candidates of most of the texts."""
    rows, df, few = crowded
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.classes(df).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
    assert 40 <= sum(few) < 100

    monkeypatch.setattr(ngram_join, "COUNTED", 5000)
    rank, extra = ngram_join.frequent(ngram_join.counted(df, 5), 10)
    counts = collections.Counter(int(x) for _, text in rows for x in ngram_join.shingles(pa.array([text]))[0])
    most = np.zeros(1024, np.int64)
    for token, n in counts.items():
        most[token >> 42] = max(most[token >> 42], n)
    assert ((rank > 0) == (most >= 8)).all() and (rank[most >= 8] == np.floor(2 * np.log2(most[most >= 8])) - 5).all()
    assert extra[1] == 7 and extra[0] == ngram_join.CHANCE


def test_one_of_each_crowded_sketch(spark, crowded):
    rows, df, few = crowded
    assert {r["doc_id"] for r in ngram_join.one_of_each(spark, df, "").collect()} == {i for i, _ in rows if i < 1000}
    assert 40 <= sum(few) < 100


@pytest.mark.parametrize("stage", [False, True])
def test_ngram_join_shuffles_few_texts(spark, stage):
    """Texts that have no near copy cross no shuffle; of 800, ten pairs have one."""
    rng = np.random.default_rng(8)
    texts = ["".join(map(chr, row)) for row in rng.integers(97, 123, (800, 3000))]
    texts = [" ".join(t[k : k + 50] for k in range(0, 3000, 50)) for t in texts]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t + " more") for i, t in enumerate(texts[:10])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = written()
    got = ngram_join.one_of_each(spark, df, "").collect() if stage else ngram_join.classes(df).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    if stage:
        assert sorted(map(tuple, got)) == rows[:800]
    else:
        assert {r["doc_id"]: r["component_id"] for r in got} == {i: i % 1000 for i, _ in rows}
    assert written() - before < 0.5 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("most", [12, 26])
def test_ngram_join_sieve(spark, monkeypatch, most):
    """A sieve loses no id that is wanted, also when it is full, and keeps few others when it is not."""
    monkeypatch.setattr(ngram_join, "SIEVE_LEAST", 12)
    monkeypatch.setattr(ngram_join, "SIEVE_MOST", most)
    rows = spark.range(-20_000, 20_000).withColumn("text", F.lit("x"))
    wanted = [-(1 << 63), *range(-20_000, 20_000, 8)]
    maybe = {r["id"] for r in ngram_join.marked(rows, spark.createDataFrame([(i,) for i in wanted], "id long")).where("maybe").collect()}
    assert maybe >= set(wanted[1:]) and (most == 12 or len(maybe) < 7_000)
    nobody = ngram_join.marked(rows, spark.createDataFrame([], "id long"))
    assert nobody.columns == ["id", "text", "maybe"] and nobody.where("not maybe").count() == 40_000


def test_ngram_join_counting_has_no_step():
    """The sizes that are measured and the sizes that are meant count shingles the same way."""
    assert [ngram_join.crowded(n << 20) for n in (1, 45, 100, 350, 500, 50_000)] == [False, False, True, True, True, True]


def test_one_of_each_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (None, a + " more"), (None, b), (3, a + " else"), (4, c), (4, c), (4, "another text of that id"), (5, c + " more"), (6, ""), (6, ""), (None, None), (7, "short text"), (8, "Short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("own")).withColumn("id", F.lit(1)).withColumn("a b.c", F.lit(2))
    left = ngram_join.one_of_each(spark, df, "")
    got = collections.Counter((r["doc_id"], r["text"]) for r in left.collect())
    kept = {x for x in got if x[0] is None and x[1] in (a, a + " more")}
    assert left.columns == df.columns and len(kept) == 1 and sum(got[x] for x in kept) == 1
    assert got - collections.Counter(kept) == collections.Counter([(None, b), (4, c), (4, "another text of that id"), (6, ""), (6, ""), (None, None), (7, "short text")])
    assert ngram_join.one_of_each(spark, df.limit(0), "").count() == 0


@pytest.mark.parametrize(("hot", "spread", "stretch", "chunk"), [(255, 1024, 1 << 14, 8 << 20), (6, 1 << 30, 16, 700), (4, 9, 16, 1500)])
def test_repeats_brute(spark, monkeypatch, hot, spread, stretch, chunk):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SPREAD", spread)
    monkeypatch.setattr(repeats, "STRETCH", stretch)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    rng = random.Random(hot)
    passage = " ".join(rng.choice("abcd") for _ in range(70))
    rows = []
    for i in range(120):
        k = rng.random()
        some = " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 50)))
        rows.append((i * 2 - 30, None if k < 0.05 else "" if k < 0.1 else "a" * rng.randint(0, 200) if k < 0.2 else f"{some} {passage[: rng.randint(40, 140)]} é{some}" if k < 0.7 else " ".join(rng.choice("ab") for _ in range(rng.randint(0, 150)))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], bytes(r["kept"])) for r in automaton.deduplicate(df).collect()}
    assert got == brute_words(rows, 20)
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_levels.deduplicate(df).collect()}
    assert got == brute_bytes(rows, 50)


def test_repeats_repeated_rows(spark):
    """Rows that repeat id and text have one answer; of an id's texts the words that come first stay."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (None, "x " + text), (None, "x " + text), (9, text + " end"), (9, text + " end"), (9, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_units"], r["n_removed"]) for r in automaton.deduplicate(df).collect())
    assert got == [(-1, 31, 0), (-1, 31, 0), (5, 30, 30), (5, 30, 30), (9, 30, 30), (9, 31, 30), (9, 31, 30)]
    rows = [(5, text), (5, text), (9, text), (9, text)]
    got = sorted((r["doc_id"], r["n_removed"]) for r in automaton.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 0), (5, 0), (9, 30), (9, 30)]
    got = sorted((r["doc_id"], r["n_removed"]) for r in suffix_levels.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 0), (5, 0), (9, len(text)), (9, len(text))]


@pytest.mark.parametrize("spec", [repeats.Spec(False, 50, 22, False), repeats.Spec(True, 20, 10, True)])
def test_repeats_whole_copies_are_not_matched(spark, spec):
    """Later copies of whole texts go without being sent to a shard; short ones stay."""

    def match(*_):
        raise ValueError("a copy was sent")

    texts = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(5)] + ["short text", "", None]
    rows = [(100 * c + k, t) for c in range(6) for k, t in enumerate(texts)] + [(None, texts[4])]
    done = repeats.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), match, spec)
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in done.collect()}
    for i, t in rows:
        n = len((t or "").split()) if spec.words else len(t or "")
        gone = n if i is not None and (i >= 100 or i == 4) and i % 100 < 5 else 0
        assert got[i] == (n, gone, int(gone > 0), b"" if gone else (t or "").encode())


def test_repeats_cases(docs, empty):
    for dedup in (automaton.deduplicate, suffix_levels.deduplicate):
        got = dedup(docs).collect()
        assert len(got) == docs.count() and dedup(empty).count() == 0
        assert all(r["n_units"] == 0 for r in got if r["doc_id"] in (4, 5))


def test_suffix_family_levels(monkeypatch):
    rng = np.random.default_rng(1)
    ids, texts = [], []
    for i in range(80):
        x = rng.integers(97, 99, rng.integers(0, 120)).astype(np.uint8).tobytes()
        texts.append(x[:30] + texts[rng.integers(len(texts))][5:] if texts and rng.random() < 0.6 else x)
        ids.append(i // 2)
    texts[3], texts[9] = b"\0" * 25 + texts[3][25:], b"x" + b"\0" * 24 + texts[9][25:]  # zeros at a window's end
    want = []
    first = {}
    for i, x in zip(ids, texts):
        for s in range(len(x) - 19):
            first.setdefault(x[s : s + 20], i)
    for i, x in zip(ids, texts):
        gone = np.zeros(len(x), bool)
        for s in range(len(x) - 19):
            gone[s : s + 20] |= first[x[s : s + 20]] < i
        want.append(gone)
    for size, scan in ((200, 7), (900, 64), (1 << 30, 1 << 16)):
        monkeypatch.setattr(suffix_levels, "BATCH_BYTES", size)
        monkeypatch.setattr(suffix_levels, "SCAN", scan)
        got = [np.zeros(len(x), bool) for x in texts]
        family = suffix_levels.Family(20)
        for p, a, b in zip(*suffix_levels.matched_by(family, np.array(ids), texts, repeats.Spec(False, 20, 9, False))):
            got[p][a:b] = True
        assert all((g == w).all() for g, w in zip(got, want))
        # a binary counter: as many merges as its carries, no two levels of a rank
        assert family.batches >= 6 and family.merges == family.batches - bin(family.batches).count("1") and family.scans >= family.batches - 1
        assert [lv.rank for lv in family.levels] == [k for k in range(20, -1, -1) if family.batches >> k & 1]


# op6


def test_pii_base_and_crf(docs):
    model = pii.fit()
    right = sum([s[:3] for s in pii.found([t], model)[0]] == sorted(sp, key=lambda s: (pii.KINDS.index(s[0]), s[1])) for t, sp in pii.labelled_examples(seed=50))
    assert right / len(pii.labelled_examples()) > 0.9
    got = {r["doc_id"]: r["spans"] for r in pii.detect(docs).collect()}
    assert [s["kind"] for s in got[14] if s["base"]] == ["email", "ip", "card", "phone"] and got[4] == [] and got[1] == []


@settings(max_examples=300, deadline=None)
@given(st.text("a1.@+-( )%2é\n0", max_size=40))
def test_pii_base_is_the_patterns(text):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    want = [("email", *m.span()) for m in email.finditer(text)]
    want += [("ip", *m.span()) for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    want += [("card", *m.span()) for m in card.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    want += [("phone", *m.span()) for m in phone.finditer(text) if 9 <= len(digits(m)) <= 15]
    assert pii.base_spans(text) == want


# op8


def test_secrets(spark, docs, empty):
    paths, seen, fresh = secrets.incremental(docs)
    got = {r["path"]: [(f["kind"], f["start"], f["end"]) for f in r["findings"]] for r in paths.collect()}
    assert got[13] == [("access", 0, 24), ("assign", 25, 44)] and got[4] == got[5] == []
    paths2, seen2, fresh2 = secrets.incremental(docs, seen, fresh)
    assert seen2.count() == 0 and fresh2.count() == 0
    assert {r["path"]: [f["kind"] for f in r["findings"]] for r in paths2.collect()} == {k: [x[0] for x in v] for k, v in got.items()}
    newer = tuple(secrets.Rule(r.kind, r.pattern, r.least, 2, r.group, r.hint) if r.kind == "access" else r for r in secrets.RULES)
    assert {r["rule"] for r in secrets.incremental(docs, seen, fresh, newer)[1].collect()} == {"access@2"}
    assert secrets.incremental(empty)[0].count() == 0
    masked = secrets.redact(docs, secrets.scan(secrets.distinct_blobs(secrets.addressed(docs))))
    assert masked.where("doc_id = 13").first()["text"] == "[SECRET] [SECRET] token: abc" and masked.columns == docs.columns


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("token:= abcdef012AKIZ\"'é", max_size=60), min_size=1, max_size=20))
def test_secrets_base_is_the_patterns(spark, texts):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    df = spark.createDataFrame(list(enumerate(texts)), "path long, text string").withColumn("blob", F.col("path").cast("string"))
    got = {int(r["blob"]): [(f["start"], f["kind"], f["end"]) for f in r["findings"]] for r in secrets.scan(df, secrets.BASE).collect()}
    for i, t in enumerate(texts):
        want = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert got.get(i, []) == [(a, k, b) for a, _, k, b in sorted(want)]


@pytest.mark.parametrize("text,want", [("password = hunter22", [("assign", 0, 19)]), ("my passwd: abcdef1 x", [("assign", 3, 18)]), ("PassWord\"='s3cr.t-9", [("assign", 0, 19)]), ("PASSWD:abcdefg", [("assign", 0, 14)]), ("password=short password", [])])
def test_secrets_password_alone(spark, text, want):
    """A text whose only secret is a password; the rule's cheap test must not skip it."""
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(f["kind"], f["start"], f["end"]) for f in secrets.incremental(docs)[0].first()["findings"]] == want
    masked = secrets.without_secrets(spark, docs, "").first()["text"]
    assert masked == (text[: want[0][1]] + "[SECRET]" + text[want[0][2] :] if want else text)


# op9


def test_ann_recall_and_cases(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    x[700:1000] = x[5]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] + [0.0] * 14), (2050, [1.0] * 3), (2051, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = ann.search(df, F.col("vec_id") % 50 == 0).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q, found in by.items():
        s = unit @ unit[q]
        s[q] = -2
        top = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        found.sort()
        hit += len(set(top) & {v for _, v, _ in found})
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(v < 1500 for _, v, _ in found)
    assert len(by) == 30 and hit / 150 >= 0.9
    assert [v for _, v, _ in by[700]] == [5, 701, 702, 703, 704]
    for q, found in by.items():
        for _, v, score in found:
            assert score == pytest.approx(float(np.dot(x[q], x[v]) / (np.linalg.norm(x[q]) * np.linalg.norm(x[v]))), abs=1e-13)
    assert ann.search(df.where("vec_id >= 2000"), F.col("vec_id") % 50 == 0).count() in (0, 1, 2, 3, 4, 5)
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_ann_split_files_and_few_rows(spark, monkeypatch):
    """Split files, a third of all rows alike, queries that find too few at first: each query has its k rows, once each."""
    monkeypatch.setattr(ann, "GROUP", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    x[100:200] = x[3]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 50 == 0, miss=0.9).collect():
        got[r["query_id"]].append(r["vec_id"])
    assert sorted(got) == [0, 50, 100, 150, 200, 250] and all(len(v) == len(set(v)) == 5 for v in got.values())
    assert got[100] == [3, 101, 102, 103, 104] and got[150] == [3, 100, 101, 102, 103]
    few = ann.search(df.where("vec_id < 3"), F.col("vec_id") % 50 == 0).collect()
    assert [r["vec_id"] for r in few] == [int(i) for i in np.array([1, 2])[np.argsort(-(x[1:3] @ x[0]) / np.linalg.norm(x[1:3], axis=1))]]


def test_ann_tiny_and_huge_components(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [2e-200, 1e-200]), (2, [1e200, 2e200]), (3, [5e-324, 0.0]), (4, [-3.0, 1.0])]
    got = {r["vec_id"]: r["score"] for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()}
    assert got == {2: pytest.approx(1.0), 1: pytest.approx(0.8), 3: pytest.approx(5**-0.5), 4: pytest.approx(-1 / 50**0.5)}


# op10


def brute_counts(t):
    w = WORD.findall(t)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(cover)


def test_quality_counts(docs, empty):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in quality.score(docs, None).collect():
        want = brute_counts(r["text"] or "")
        assert tuple(r[c] for c in cols) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r["kept"] == (not r["base_failed"])
    assert quality.score(empty, None).count() == 0


def test_quality_held_out(spark, sf_dir):
    from pathlib import Path

    sf = Path(sf_dir).parent / "sf0.1"
    docs, labels = common.read(spark, str(sf), "documents"), common.read(spark, str(sf), "labels")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    both = quality.score(docs.join(labels.where("doc_id % 2 = 1").withColumnRenamed("quality", "gold"), "doc_id"), model).where("not base_failed")
    good = both.where("gold = 1").agg(F.avg(F.col("kept").cast("double"))).first()[0]
    bad = both.where("gold = 0").agg(F.avg((~F.col("kept")).cast("double"))).first()[0]
    assert good > 0.99 and bad > 0.95


def test_quality_without_labels(spark, docs):
    assert quality.train(docs, spark.createDataFrame([], "doc_id long, quality int")) is None


# all


def test_clashing_columns(docs):
    """Columns that are named like an operator's own, in any case, are carried along or replaced, never a crash."""
    names = ("kept", "IDS", "n_words", "Findings", "blob", "rest_", "spans", "decoded", "text_", "salt_", "id", "row", "a b.c`", "m_key", "copies")
    wide = docs.withColumns({n: F.lit(n) for n in names})
    total = docs.count()

    def same(made, gone=(), added=()):
        assert [c.lower() for c in made.columns] == [c.lower() for c in wide.columns if c.lower() not in gone] + list(added)
        rows = made.collect()
        assert len(rows) == total and all(r[n] == n for r in rows for n in names if n.lower() not in (*gone, *added))

    rest, unpack = common.packed(wide, "doc_id", "text")
    assert rest.select(unpack).columns == wide.columns
    same(bpe.encode(wide, decoded=True), ("ids", "decoded"), ("ids", "decoded"))
    same(bpe.decode(wide.withColumn("numbers", F.array(F.lit(5))), "numbers").drop("numbers"), ("decoded",), ("decoded",))
    same(pii.detect(wide), ("spans",), ("spans",))
    quality_names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept")
    same(quality.score(wide, None), quality_names, quality_names)
    same(html_main.extract(wide.withColumn("html", F.col("text")), text_col="main"), (), ("main",))
    same(secrets.without_secrets(None, wide, ""))
    assert ngram_join.one_of_each(None, wide, "").columns == wide.columns and mixing.mixed(wide).columns == wide.columns
    assert ngram_join.classes(wide).count() == automaton.deduplicate(wide).count() == suffix_levels.deduplicate(wide).count() == total


# every query through its function


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_op2_query(spark, sf_dir, texts):
    got = by_id(ngram_join.op2_ngram_join(spark, sf_dir))
    assert {(i, r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(list(texts.items()))


def test_op3_query(spark, sf_dir, texts, tokenizer):
    got = by_id(bpe.op3_byte_bpe(spark, sf_dir))
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = tokenizer[1].encode_ordinary(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(t))


def article_of(page):
    """The article of a page of the test tables, read off its markup."""
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x.replace("<b>", ""))).split()) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(x for x in blocks if x)


def test_op4_query(spark, sf_dir):
    for folder in (sf_dir, str(Path(sf_dir).parent / "sf0.01")):
        pages = {r["page_id"]: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
        for r in html_main.op4_html_main_text(spark, folder).collect():
            want = article_of(pages[r["page_id"]]["html"])
            assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))


def test_op5_op7_queries(spark, sf_dir, texts):
    rows = list(texts.items())
    got = by_id(automaton.op5_automaton_dedup(spark, sf_dir))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == {i: (n, gone, sha(kept)) for i, (n, gone, kept) in brute_words(rows, 20).items()}
    got = by_id(suffix_levels.op7_suffix_levels(spark, sf_dir))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == {i: (n, gone, k, sha(kept)) for i, (n, gone, k, kept) in brute_bytes(rows, 50).items()}


def test_op6_query(spark, sf_dir, texts):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for i, r in by_id(pii.op6_personal_data(spark, sf_dir)).items():
        t = texts[i]
        want = [("email", *m.span()) for m in email.finditer(t)]
        want += [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in card.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        want += [("phone", *m.span()) for m in phone.finditer(t) if 9 <= len(digits(m)) <= 15]
        shown = [":".join(map(str, s)) for s in want]
        assert r["base_sha256"] == sha(",".join(shown)) and set(shown) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS] and r["n_spans"] == len([x for x in r["spans"].split(",") if x])


def test_op8_query(spark, sf_dir, texts):
    rules = {
        "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I), 2, 6),
        "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
        "hex": (re.compile("[0-9a-f]+"), 0, 24),
    }
    kinds = list(rules)
    for i, r in by_id(secrets.op8_secret_scan(spark, sf_dir)).items():
        want = sorted((m.start(), kinds.index(k), k, m.end()) for k, (p, g, least) in rules.items() for m in p.finditer(texts[i]) if len(m[g]) >= least)
        shown = [f"{k}:{a}:{b}" for a, _, k, b in want]
        assert r["base_sha256"] == sha(",".join(shown)) and [r[f"n_{k}"] for k in kinds] == [sum(s[2] == k for s in want) for k in kinds]
        assert set(shown) <= set(r["spans"].split(",")) | {""}


def test_op9_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in rows}
    every = np.array(list(x.values()))
    ids, size, hit, found = np.array(list(x)), np.sqrt((every**2).sum(1)), 0, collections.defaultdict(list)
    for r in ann.op9_permutation_neighbours(spark, sf_dir).orderBy("query_id", "rank").collect():
        q, v = x[r["query_id"]], x[r["vec_id"]]
        assert r["score"] == pytest.approx(q @ v / np.sqrt((q @ q) * (v @ v)), abs=1e-14)
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == {i for i in x if i % 50 == 0}
    for q, some in found.items():
        assert len(some) == 5 and some == sorted(some, key=lambda s: (-s[1], s[0]))
        near = np.where(ids == q, -2, every @ x[q] / size / np.linalg.norm(x[q]))
        hit += len({v for v, _ in some} & set(ids[np.argsort(-near)[:5]]))
    assert hit / (5 * len(found)) >= 0.9


def test_op10_query(spark, sf_dir, texts):
    got = by_id(quality.op10_quality_rules(spark, sf_dir))
    for i, t in texts.items():
        w = WORD.findall(t)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        seen = collections.Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if seen[x] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_suffix_levels_on_documents(texts):
    """On documents, several levels of a shard are scanned and merged."""
    rows = sorted((i, t.encode()) for i, t in texts.items() if t)[:150]
    family = suffix_levels.Family(50)
    suffix_levels.matched_by(family, np.array([i for i, _ in rows]), [t for _, t in rows], suffix_levels.BYTES)
    assert family.batches >= 8 and family.merges >= 4 and family.scans >= 8


def test_pipeline_stages(spark, sf_dir, texts, tokenizer):
    """Each stage of the pipeline on what the one before it kept, against brute force."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = quality.keep_good(spark, docs, sf_dir).persist()
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality.score(docs, model).where("kept").collect()} and good.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    once = ngram_join.one_of_each(spark, good, sf_dir).persist()
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(i for i, _, c in brute_components(rows) if i == c)
    clean = secrets.without_secrets(spark, once, sf_dir).persist()
    patterns = [(re.compile(r.pattern), r.group, r.least) for r in secrets.RULES]
    for r in clean.collect():
        text, gone = texts[r["doc_id"]], set()
        for p, g, least in patterns:
            for m in p.finditer(text):
                gone |= set(range(*m.span())) if len(m[g]) >= least else set()
        want, last = "", -1
        for a, b in sorted({(m.start(), m.end()) for p, g, least in patterns for m in p.finditer(text) if len(m[g]) >= least}):
            want += (text[max(last, 0) : a] + "[SECRET]") if a >= last else ""
            last = max(last, b)
        assert r["text"] == want + text[max(last, 0) :] and r["n_chars"] == len(r["text"]) and ("[SECRET]" in r["text"]) == bool(gone)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    mixed = mixing.mixed(clean).persist()
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter({i: n for i, n in copies.items() if n})
    masked = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in bpe.token_ids(spark, mixed, sf_dir).collect():
        assert r["ids"] == tokenizer[1].encode_ordinary(masked[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


def test_ledger_in_a_folder(spark, docs, tmp_path):
    """A second run scans nothing, a new text is scanned alone, a new rule version reads old texts again."""
    folder = str(tmp_path / "ledger")
    first = {r["path"]: r["findings"] for r in secrets.ledgered(docs, folder).collect()}
    rows = lambda name: spark.read.parquet(f"{folder}/{name}").count()
    n, k = rows("ledger"), rows("findings")
    assert n == len(secrets.RULES) * docs.select("text").fillna("").distinct().count() and any(first.values())
    assert {r["path"]: r["findings"] for r in secrets.ledgered(docs, folder).collect()} == first and (rows("ledger"), rows("findings")) == (n, k)
    more = docs.unionByName(spark.createDataFrame([(99, "secret: abcdef123", "z")], docs.schema))
    again = {r["path"]: r["findings"] for r in secrets.ledgered(more, folder).collect()}
    assert again[99][0]["kind"] == "assign" and (rows("ledger"), rows("findings")) == (n + len(secrets.RULES), k + 1)
    newer = (*secrets.BASE[:2], secrets.Rule("hex", "[0-9a-f]{24,}", 24, version=2), *secrets.EXTRA)
    assert {r["path"]: r["findings"] for r in secrets.ledgered(more, folder, newer).collect()} == again and rows("ledger") == n + len(secrets.RULES) + n // len(secrets.RULES) + 1


# more of op4 and op6


def test_leaf_blocks_inline_and_heads():
    read = lambda page: [b.text for b in html_main.leaf_blocks(page)]
    assert read("<p>one <script>x</script>two <style>y</style>three<svg><text>no</text></svg> four</p>") == ["one two three four"]
    assert read("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b <noscript>c</noscript> <object>d</object></p>") == ["a x=2 b c d"]
    assert read("<html><head><title>T</title><meta a=b><p>Text of an open head</p>") == ["Text of an open head"]
    assert read("<head><style>p{}</style>Words</head> end") == ["Words", "end"]
    assert read("<head><title>x</title></head><body><p>y") == ["y"] and read("<head>") == [] and read("<p>a</b></i></div>b") == ["a", "b"]


def test_html_cases(spark):
    deep = "<div>" * 50_000 + "<article><p>Deep words stand here.</p></article>" + "</div></span>" * 50_000
    rows = [(1, "u", deep), (2, "u", "<article><p>Some words stand here.</p></article>"), (2, "u", "<article><p>Some words stand here.</p></article>"), (None, None, "<article><p>" + "long " * 200_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["text"]) for r in html_main.extract(df).collect())
    assert got == [("1", "Deep words stand here."), ("2", "Some words stand here."), ("2", "Some words stand here."), ("None", ("long " * 200_000).strip())]
    assert html_main.extract(df.limit(0)).count() == 0


def test_viterbi_is_brute_force():
    rng = np.random.default_rng(3)
    model = pii.Crf({f"f{i}": i for i in range(6)}, rng.normal(size=(6, len(pii.LABELS))), rng.normal(size=(len(pii.LABELS), len(pii.LABELS))))
    sequences = [[[f"f{rng.integers(8)}" for _ in range(rng.integers(0, 4))] for _ in range(rng.integers(1, 5))] for _ in range(30)]
    for s, path in zip(sequences, model.decode(sequences), strict=True):
        e = [sum((model.emit[model.index[f]] for f in w if f in model.index), np.zeros(len(pii.LABELS))) for w in s]
        for x in e:
            x[0] += model.caution

        def score(p):
            return sum(e[i][y] for i, y in enumerate(p)) + sum(model.step[a, b] for a, b in zip([0, *p], [*p, 0]))

        assert score(path) == pytest.approx(max(map(score, itertools.product(range(len(pii.LABELS)), repeat=len(s)))))


def test_crf_alone(spark, sf_dir, empty):
    """Without the patterns' help the CRF finds nearly all that they find, and what they lose."""
    model = pii.default_model()
    texts = [r["text"] for r in spark.read.parquet(f"{Path(sf_dir).parent}/sf0.1/documents.parquet").select("text").collect() if r["text"]]
    hit = total = 0
    for t, spans in zip(texts, pii.crf_spans(texts, model), strict=True):
        base = set(pii.base_spans(t))
        hit, total = hit + len(base & set(spans)), total + len(base)
    assert hit >= 0.95 * total
    examples = pii.labelled_examples(seed=991, rounds=10)
    pairs = [(set(s), set(f)) for (_, s), f in zip(examples, pii.crf_spans([t for t, _ in examples], model), strict=True)]
    right = sum(len(a & b) for a, b in pairs)
    assert right >= 0.95 * sum(len(b) for _, b in pairs) and right >= 0.9 * sum(len(a) for a, _ in pairs)
    assert ("phone", 10, 27, False) in pii.found(["now call  +1 (826) 555-4081 190.137.223.204 today"], model)[0]
    long = " ".join(["12"] * 5000) + " 4111111111111111"
    assert pii.runs(long) and len(pii.runs(long)[0]) == 5001 and pii.crf_spans([long], model) is not None
    assert pii.detect(empty).count() == 0
