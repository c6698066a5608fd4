"""Sources, trees and models that the catalogue's SQL does not reach."""

import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.functions import dom, text
from pagelens.operators import classifier, curate, features, languages, models, pages, sampling, vectorize
from pagelens.plans import catalog, merge_queries
from pagelens.sources import codec, io


def test_numbered_lines(spark, tmp_path):
    lines = ["" if i % 10 == 0 else "{bad" if i % 10 == 1 else json.dumps({"a": i}) for i in range(5000)]
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = {r["line_no"]: r["value"] for r in io.numbered_lines(spark, str(path)).collect()}
        some = [tuple(r) for r in io.numbered_jsonl(spark, str(path), "a long", 25).orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == dict(enumerate(lines)) and some == [(i, i) for i in range(25) if i % 10 > 1]


def test_folders_arrays_and_url_lists(spark, tmp_path):
    for name, n in (("b", 1), ("a", 2), ("first", 3)):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"url": f"u{n}", "label": name}) + "\n")
    (tmp_path / "no.txt").write_text("no")
    first = f"file:{tmp_path}/first.jsonl"
    got = io.folder(spark, str(tmp_path), "url string, label string", first=[first]).orderBy("file_rank").collect()
    assert [(r["label"], r["file_rank"]) for r in got] == [("first", 0), ("a", 1), ("b", 2)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("x")
    with pytest.raises(ValueError):
        io.folder(spark, str(tmp_path / "none"), "url string")
    (tmp_path / "array.json").write_text('[\n  {"a": 1},\n  {"a": 2},\n  {"a": 3}]\n')
    assert sorted(r["a"] for r in io.json_array_lines(spark, str(tmp_path / "array.json"), "a long").collect()) == [1, 2, 3]
    io.write_parquet(spark.createDataFrame([("A.org/x/",), (" ",), (None,), ("A.org/x/",)], "url string"), str(tmp_path / "u.parquet"))
    assert [r["url"] for r in io.url_list(spark, str(tmp_path / "u.parquet")).collect()] == ["https://A.org/x/"]


def test_crawl_list_and_vector_cache(spark, tmp_path):
    log = tmp_path / "log"

    def fetch(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        return (200, f"page of {url}") if url != "u3" else (500, "")

    df = spark.createDataFrame([(f"u{i % 7}",) for i in range(20)], "url string")
    for _ in range(2):
        got = io.crawl_list(df, fetch, str(tmp_path / "out"), batch=3).collect()
        assert sorted(r["url"] for r in got) == [f"u{i}" for i in range(7)] and [r["success"] for r in got if r["url"] == "u3"] == [False]
    assert sorted(log.read_text().split()) == [f"u{i}" for i in range(7)]
    make = lambda: spark.createDataFrame([(1, [0.5])], "id int, v array<double>")
    for _ in range(2):
        assert io.cached_vectors(spark, str(tmp_path / "vec"), "m1", make).columns == ["id", "v"]
    with pytest.raises(ValueError):
        io.cached_vectors(spark, str(tmp_path / "vec"), "m2", make)


def test_page_codings(spark):
    packed = codec.compressed(F.col("t"))
    row = spark.createDataFrame([("é",)], "t string").select(packed.alias("p"), F.base64(F.unhex(F.lit("FF"))).alias("bad")).select(codec.prompt_page(F.col("p")).alias("a"), codec.prompt_page(F.col("bad")).alias("b"), codec.mongo_page(F.lit('{"x": 1}')).alias("c")).first()
    assert tuple(row) == ("é", "", None)


def test_labels_and_merges(spark, monkeypatch):
    df = spark.createDataFrame([(i, ["a", "b"] if i < 5 else ["b", "c", "b"] if i < 7 else ["d"]) for i in range(8)], "id int, labels array<string>")
    want = {i: ["a", "b"] if i < 5 else ["b"] for i in range(7)}
    assert {r["id"]: r["labels"] for r in curate.prune_rare(df, "labels", 3).collect()} == want
    monkeypatch.setattr(curate, "BROADCAST_ROWS", 1)
    assert {r["id"]: r["labels"] for r in curate.prune_rare(df, "labels", 3).collect()} == want
    assert curate.prune_rare(df, "labels", 100).count() == 0
    assert curate.checked_labels(df, "labels", ["a", "b", "c", "d"], strict=True).count() == 8
    with pytest.raises(ValueError):
        curate.checked_labels(df, "labels", ["a", "b"], strict=True)
    assert [r["label"] for r in curate.by_support(spark.createDataFrame([("x", 1), ("y", 5), ("a", 1)], "label string, n int")).collect()] == ["y", "a", "x"]


def test_ranked_is_a_window(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"s{i % 3}") for i in range(3000)], "id int, s string")
    w = Window.partitionBy("s").orderBy(sampling.shuffle_key("id", 4), "id")
    want = {r["id"]: (r["r"], r["n"]) for r in df.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("s"))).collect()}
    assert {r["id"]: (r["rank"], r["total"]) for r in sampling.ranked(df, ["s"], "id", 4).collect()} == want
    assert sampling.half(df, "id").where("half").count() == 1500 and sampling.group_split(df.limit(0), "s").count() == 0


def test_deep_pages():
    deep = "<div>" * 20_000 + "<article><h1>Head</h1><p>words here</p></article>"
    nodes = dom.parse(deep)
    assert dom.main_content(nodes, (), 5) == "Head words here" and dom.markdownish(nodes) == "# Head\nwords here"
    assert len(dom.parse("<p>a</p>" * 10, 16)) == 2 and features.statistics(features.Page(nodes, deep))["depth_max"] == 20_001


def test_feature_tokens():
    page = """<html lang=en><head><title>T</title><meta name=viewport content=x><meta name=generator content="WordPress 6"><meta itemprop="name url"><link rel="alternate stylesheet" type="application/rss+xml" hreflang=de href="/feed/all.xml">
    <script type="application/ld+json">{"@type": "Article"}</script><script src="https://cdn.track-er.io/lib/jquery.min.js"></script><script>dataLayer.push(1)</script><style>p{a:b} q{c:d}</style></head>
    <body itemscope itemtype="https://schema.org/Product"><form action="/search/do" class=login-box method=POST><input name="search_term"><input type=hidden></form><a href="https://other.org/a-b/c.html?x=1&y=2#z" title=t rel=nofollow target=_blank>12 <img src="data:abc"></a>
    <a href="/home/">home page</a><img src="/img/icon.png" width=16px height=16 alt=i><iframe src="https://youtube.com/x"></iframe><table><tr><td>1<td>2</table><font style="color: red; font-size: 9px">“quoted” 1.234.567 5 %</font></body></html>"""
    p = features.Page(dom.parse(page), page, "https://www.mysite.org/x")
    t = {g: set(f(p)) for g, f in features.TOKENS.items()}
    assert {"a:html[lang]", "a:rel=nofollow", "a:target", "img:icon", "x:td=2", "x:input_type=text", "x:input_type=hidden", "x:font_tag"} <= t["attr"]
    assert {"H:ext=html", "H:q=2", "H:key=x", "H:key=y", "H:frag", "H:slash", "H:depth=2", "H:depth=0"} <= t["href"]
    assert {"m:meta=viewport", "m:generator=wordpress", "m:itemprop=url", "m:link_rel=alternate", "m:link_rel=stylesheet", "m:alt_type=lication/rss+xml", "m:hreflang", "m:form_action=search", "m:js_datalayer", "s:schema_product", "s:ld_article"} <= t["meta"]
    assert {"P:jquery", "P:cdn", "P:youtube", "P:iframe_youtube", "P:datauri", "P:script_cdn", "r:ext:html"} <= t["plat"] and {"r:jquery", "r:min", "r:icon", "r:all"} <= t["res"]
    assert {"c:login", "fa:search", "in:search", "in:term"} <= t["css"] and {"uh:other", "uh:cdn"} <= t["url"]
    assert {"n:numberish", "n:thousands_sep"} <= t["shape"] and any(x.startswith("n:cc=curly_quote=") for x in t["shape"]) and "quoted" in t["words"]
    s = features.statistics(p)
    assert s["external_link_share"] == 0.5 and s["n_external_domains"] == pytest.approx(np.log(2)) and s["has_login_form"] == s["has_jsonld"] == s["has_lang"] == s["has_viewport"] == s["has_microdata"] == 1.0
    assert s["css_rules"] == pytest.approx(np.log(3)) and s["n_schema_types"] == 2 and s["n_input_hidden"] == 1 and s["n_forms_post"] == 1 and s["anchor_title_share"] == 0.5 and s["max_table_cols"] == 2 and s["n_rss_link"] == 1


def test_features_in_one_pass(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    made = pages.page_features(df).persist()
    assert made.count() == df.count() and pages.stat_columns(made).columns == ["page_id", *pages.DENSE_NAMES]
    assert {r["grp"] for r in pages.token_rows(made).select("grp").distinct().collect()} <= set(pages.GROUPS)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "no tags"), (4, "<p>x")], "page_id long, html string")
    assert [r["page_id"] for r in pages.page_features(odd).collect()] == [4] and pages.node_table(odd).count() == 1


def test_heads_are_the_optimum(spark):
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(300, 4)), 4.0
    y = np.stack([x[:, 0] + 0.3 * rng.normal(size=300) > 0.5, x[:, 1] > 10, x[:, 2] > 0], 1)
    df = spark.createDataFrame([(i, [float(v) for v in r], [int(v) for v in t]) for i, (r, t) in enumerate(zip(x, y))] + [(999, None, [0, 0, 0])], "id int, v array<double>, y array<int>").repartition(4)
    heads = models.fit_heads(df, "v", {str(k): F.col("y")[k] for k in range(3)}, c)
    assert list(heads.empty) == [False, True, False]
    one = np.concatenate([x, np.ones((300, 1))], 1)
    for k in (0, 2):
        theta = np.append(heads.weights[k], heads.bias[k])
        own = np.where(y[:, k], 300 / (2 * y[:, k].sum()), 300 / (2 * (~y[:, k]).sum()))
        assert np.abs(((1 / (1 + np.exp(-one @ theta)) - y[:, k]) * own) @ one + theta / c).max() < 1e-6
    got = {(r["id"], r["label"]): r["score"] for r in models.head_scores(df, "id", "v", heads).collect()}
    assert len(got) == 900 and got[5, "1"] == 0.0 and got[5, "0"] == pytest.approx(float(1 / (1 + np.exp(-(x[5] @ heads.weights[0] + heads.bias[0])))))
    basis = models.right_singular(df, "v", 2)
    _, _, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(basis.T @ v[:2].T), np.eye(2), atol=1e-6)
    assert models.svd_block(df.limit(0), "id", "v", 2).count() == 0 and models.fit_heads(df.limit(0), "v", {"0": F.col("y")[0]}).empty.all()


def test_more_models(spark):
    rows = [(i, "good news" if i % 2 else "bad cat", "x" if i % 2 else "y") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string, label string").withColumn("tokens", models.text_tokens(F.col("text")))
    fitted = models.text_pipeline(buckets=256).fit(df)
    small = models.quantised(fitted.stages[-1], 8)
    assert (np.abs(small.weights).sum(0) > 0).sum() <= 8
    guessed = df.select("label", F.when(F.col("id") < 30, F.col("label")).alias("guess"))
    row = models.at_one(guessed).first()
    assert (row["n"], row["p1"], row["r1"]) == (40, 1.0, 0.75)
    picked = models.selected(fitted.transform(df).select("features", "y"), "features", "y", 3)
    assert picked.first()["selected"].size == 3
    topics = models.lda_topics(df.withColumnRenamed("id", "doc_id"), k=2, words=2, weighted=True, optimizer="em", rounds=3)
    assert topics.select("topic").distinct().count() == 2


def test_languages(spark):
    df = spark.createDataFrame([(1, "der die das und"), (2, "the cat and\nthe dog"), (3, None), (4, "boom")], "id int, t string")

    def detect(texts):
        if texts == ["boom"]:
            raise RuntimeError("no")
        return languages.frequent_word_detector(texts)

    got = {r["id"]: (r["found"][0]["lang"] if r["found"] else None) for r in languages.detected(df, "id", F.col("t"), detect).collect()}
    assert got == {1: "de", 2: "en", 3: None, 4: None}
    assert {r["id"] for r in languages.is_language(df, "id", F.col("t"), "en", detect).where("is_lang").collect()} == {2}
    assert languages.is_language(df, "id", F.col("t"), "en", None).where("is_lang").count() == 4


def test_classifier_vectors_refit_and_sweep(spark):
    rows = [(i, f"<html><body><{'article' if i % 2 else 'table'}><p class='{'news' if i % 2 else 'shop'}-box'>w{i} text</p></body></html>", ["news"] if i % 2 else ["shop"]) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, html string, labels array<string>")
    vectors = df.select("page_id", F.array(*[(F.col("page_id") * k % 7).cast("double") for k in (1, 2, 3, 5)]).alias("vector"))
    config = classifier.Config(groups=("tag",), stats=False, embed_svd=2)
    model = classifier.StructuralClassifier(config).fit(df.select("page_id", "html"), df.select("page_id", "labels"), vectors, refit=True)
    assert (model.dim, len(model.basis), len(model.center)) == (4, 4, 2)
    scores = {r["label"]: r["score"] for r in model.score_page(rows[1][1], vector=[1.0, 2.0, 3.0, 5.0]).collect()}
    want = {r["label"]: r["score"] for r in model.scores(df.where("page_id = 1").select("page_id", "html"), vectors).collect()}
    assert scores == pytest.approx(want) and scores["news"] > scores["shop"]
    for bad in (None, [1.0]):
        with pytest.raises(ValueError):
            model.score_page(rows[0][1], vector=bad)
    best = classifier.sweep(df.select("page_id", "html"), df.select("page_id", "labels"), df.select("page_id", "html"), {"groups": [("tag",)], "stats": [False], "binary": [False, True]})
    assert best.count() == 2 and best.first()["macro_f1"] > 0.9 and len(classifier.LADDER) >= 14


def test_jsonl_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i * 37 % 100,) for i in range(100)], "i int").repartition(5)
    io.write_jsonl(df, str(tmp_path / "out"), order="i")
    lines = [json.loads(x)["i"] for f in sorted((tmp_path / "out").glob("part*")) for x in f.read_text().splitlines()]
    assert lines == list(range(100))


def test_jdbc_round_trip(spark):
    """A table of a database in memory, read in two parts."""
    url, driver = "jdbc:derby:memory:pages;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    df = spark.createDataFrame([(i, f"u{i}") for i in range(50)], "id int, url string")
    io.append_table(df, url, "listed", driver=driver)
    io.append_table(df.limit(5), url, "listed", driver=driver)
    got = io.table(spark, url, "listed", driver=driver, partitionColumn="id", lowerBound="0", upperBound="50", numPartitions="2")
    assert got.count() == 55 and got.rdd.getNumPartitions() == 2 and {c.lower() for c in got.columns} == {"id", "url"}


@pytest.mark.parametrize("name", ["word_pair_tfidf", "char_tfidf_tokens", "tfidf_top_terms"])
def test_tfidf_never_shuffles_counts_of_rows(spark, sf_dir, name, capsys):
    catalog.QUERIES[name](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    keys = [x.split(")")[0] for x in plan.split("hashpartitioning(")[1:]]
    assert keys and not any("doc_id#" in k and "token#" in k for k in keys)


def test_char_tfidf_has_all_tokens(spark, sf_dir):
    assert catalog.QUERIES["char_tfidf_tokens"](spark, sf_dir).select("token").distinct().count() > 300


@pytest.mark.parametrize("size", [None, 3, 1000])
def test_tfidf_of_rows_with_one_key(spark, size):
    """Rows with one key are one row, a null key is a key, null texts count as rows."""
    rows = [(1, "aab b aab"), (1, "b c"), (None, "b c d"), (2, None), (3, "c b aab"), (None, "d"), (4, "")]
    got = {(r["id"], r["token"]): r["value"] for r in vectorize.fitted(spark.createDataFrame(rows, "id long, text string").repartition(3), "id", text.words(F.col("text"), 1), list, 2, 1.0, size).collect()}
    counts: dict = {}
    for i, t in rows:
        counts.setdefault(i, Counter()).update((t or "").split())
    df = Counter(t for c in counts.values() for t in c)
    known = sorted((t for t in df if df[t] >= 2), key=lambda t: (-df[t], t))[:size]
    want = {}
    for i, c in counts.items():
        v = {t: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in c.items() if t in known}
        want |= {(i, t): x / math.sqrt(sum(y * y for y in v.values())) for t, x in v.items()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("make", [lambda df: df.select(codec.page_text(F.col("html"))), lambda df: df.select(codec.compressed(F.col("html"))), lambda df: df.select(codec.loose_text(F.col("html"))), pages.token_groups, pages.renderings, pages.node_table])
def test_pages_cross_to_python_a_few_at_a_time(spark, make):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.unset(n)
        make(spark.createDataFrame([(1, "<p>a</p>")], "page_id long, html string"))
        assert [int(spark.conf.get(n)) for n in names] == [codec.ARROW_ROWS, codec.ARROW_BYTES]
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def test_classifier_parses_pages_once_for_all_labels(spark, capsys):
    page = lambda i: f"<html><body>{'<p>a</p>' * (1 + i % 3)}<a href='/{i}'>x</a></body></html>"
    df = spark.createDataFrame([(i, page(i), [["a", "b", "c"][i % 3]]) for i in range(60)], "page_id long, html string, labels array<string>")
    model = classifier.StructuralClassifier(classifier.Config(min_label=5, groups=("tag",))).fit(df.select("page_id", "html"), df.select("page_id", "labels"))
    assert model.labels == ["a", "b", "c"]
    capsys.readouterr()
    made = model.scores(df.select("page_id", "html"))
    made.explain()
    assert capsys.readouterr().out.count("MapInPandas") == 1
    raw = model._vectors(model._raw(df.select("page_id", "html"), None))
    for label, head in model.heads.items():
        alone = {r["page_id"]: r["probability"][1] for r in head.transform(raw).collect()}
        assert {r["page_id"]: r["score"] for r in made.where(F.col("label") == label).collect()} == pytest.approx(alone)


def test_stream_files_follow_the_texts(spark, sf_dir, monkeypatch, tmp_path):
    monkeypatch.setattr(merge_queries, "FILE_BYTES", 20_000)
    monkeypatch.setattr(merge_queries, "scratch", lambda _: str(tmp_path))
    n = merge_queries.stream_classified(spark, sf_dir).count()
    assert n == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert len(list(tmp_path.glob("in/*.parquet"))) > 9 and len(list(tmp_path.glob("out/batch=*"))) == 3
