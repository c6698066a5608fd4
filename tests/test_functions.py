"""Hand-made cases for expressions that the tables do not exercise."""

import base64
import gzip
import json
import zlib

import pytest
from pyspark.sql import functions as F

from pagelens.functions import dom, html, text, urls
from pagelens.operators import curate, decide, features, models, pages, sampling, vectorize
from pagelens.sources import codec, io


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (urls.normalized, "HTTPS://Www.X.com/A/b//?q=1#f", "https://www.x.com/a/b"),
        (urls.normalized, "http://x.com", "http://x.com/"),
        (urls.with_scheme, "localhost:80/a", "http://localhost:80/a"),
        (urls.with_scheme, " x.com/A ", "https://x.com/A"),
        (urls.registrable_domain, "http://user@a.b.example.org:8080/x", "example.org"),
        (urls.registrable_domain, "localhost", "localhost"),
        (urls.registered_domain, "http://www.shop.co.uk/x", "shop.co.uk"),
        (urls.registered_domain, "http://localhost/", ""),
        (urls.homepage, "ftp://a.example.org/x", "https://example.org/"),
        (urls.is_homepage, "http://x.com/?a=1", False),
        (urls.file_tokens, "http://x.com/a/big-red_house.html", ["big", "red", "house", "big-red-house", "ext:html"]),
        (urls.file_tokens, "http://x.com/a/plain", []),
        (urls.path_tokens, "http://x.com/news/2024/cheap-flights/a.html", ["news", "cheap", "flights", "cheap-flights"]),
        (urls.href_shape, "mailto:a@b.c", ["H:ext=c", "H:mailto", "H:depth=0"]),
        (urls.href_shape, "https://a.org/x/12/p.html?id=5&Sort=up#top", ["H:ext=html", "H:q=2", "H:key=id", "H:key=sort", "H:frag", "H:numseg", "H:depth=3"]),
        (urls.href_shape, "/s/{id}/", ["H:slash", "H:template", "H:depth=0"]),
        (text.without_repeated_sentences, "A b.  A b.  C d.  A b.\nA b.", "C d."),
        (lambda c: text.without_repeated_lines(c, 1), "a\nb\na", "b"),
        (lambda c: text.scrub_web(c), "Používáme COOKIES na www.a.cz v 12:30, po dni x", "používáme dni"),
        (lambda c: text.scrub_english(c, ("the",)), "The Cat2, a dog's café", "cat dogs caf"),
        (lambda c: text.prepared(c, ("the",), {"cats": "cat"}), "The cats ran", ["cat", "ran"]),
        (text.word_length_tokens, "aa bb c ddd eee", ["n:wordlen=2", "n:wordlen=3"]),
        (urls.crawlable, "http://x.com/a.PDF", False),
        (text.normalize, "a\x01b  \n c ", "a b c"),
        (text.straight_quotes, "“a” ‘b’", "\"a\" 'b'"),
        (text.parse_labels, '["B", " a ", "b"]', ["a", "b"]),
        (text.parse_labels, "x; Y|z,,x", ["x", "y", "z"]),
        (lambda c: text.parse_label(c, ("news", "sport")), "x; Sport | news", "sport"),
        (text.safe_label, "a b/c", "__label__a_b_c"),
        (text.plain_label, "__label__a_b", "a b"),
        (text.json_answer, '```json\n{"a": 1}\n```', '{"a": 1}'),
        (text.json_answer, 'well {"a": {"b": 2}} ok', '{"a": {"b": 2}}'),
        (text.json_answer, "{broken", None),
        (text.unescape_common, "&amp;lt; &lt;b&gt;", "&lt; <b>"),
        (text.currency_mentions, "12 EUR and $5 or 7 €", 3),
        (text.without_repeated_lines, "a\nb\na\na\na", "b"),
        (lambda c: text.truncated(c, 10), "abcdefghijklmnop", "abcdefgh\n...[TRUNCATED]...\nop"),
        (text.chunks, "short", ["short"]),
        (html.title, "<TITLE> a\nb </TITLE>", "a\nb"),
        (lambda c: html.meta(c, "description"), '<meta name="description" content="d e">', "d e"),
        (lambda c: html.tag_count(c, "p"), "<p><pre><P class=a></p>", 2),
        (html.visible_text, "<p>a<script>no</script><!-- x --> b</p>", "a b"),
    ],
)
def test_expressions(spark, f, value, want):
    assert one(spark, value, f) == want
    one(spark, None, f)


def test_resolve(spark):
    cases = [("http://x.com/a/b", "c", "http://x.com/a/c"), ("http://x.com", "c", "http://x.com/c"), ("http://x.com/a/b", "/c", "http://x.com/c"), ("https://x.com/a", "//y.org/z", "https://y.org/z"), ("http://x.com/a", "?q", "http://x.com/a?q"), ("http://x.com/a#z", "#t", "http://x.com/a#t"), ("http://x.com/a", "mailto:q", "mailto:q")]
    df = spark.createDataFrame(cases, "b string, h string, w string")
    assert all(r["g"] == r["w"] for r in df.withColumn("g", urls.resolved(F.col("b"), F.col("h"))).collect())
    out = spark.createDataFrame([("http://www.x.com/", "http://x.com/a", False), ("http://x.com/", "http://y.com", True), ("http://x.com/", "a/b", False)], "b string, h string, w boolean")
    assert all(r["g"] == r["w"] for r in out.withColumn("g", urls.is_external(F.col("b"), F.col("h"))).collect())


def test_codec(spark):
    page = "<html>Žluťoučký</html>"
    gz, zl = (base64.b64encode(f(page.encode())).decode() for f in (gzip.compress, zlib.compress))
    cp = base64.b64encode(gzip.compress(b'<meta charset="windows-1250">' + "Žluť".encode("cp1250"))).decode()
    df = spark.createDataFrame([(0, gz), (1, zl), (2, "###"), (3, None), (4, cp), (5, "")], "i int, x string")
    got = {r["i"]: (r["p"], r["l"]) for r in df.select("i", codec.page_text(F.col("x")).alias("p"), codec.loose_text(F.col("x")).alias("l")).collect()}
    assert got[0][0] == got[1][0] == got[0][1] == page and got[2][0] is None and got[3] == (None, "") and got[4][0].endswith("Žluť") and got[5] == (None, "")
    back = spark.createDataFrame([(page,), ("",), (None,)], "x string").select(codec.page_text(codec.compressed(F.col("x"))).alias("y"), codec.compressed(F.col("x")).alias("z")).collect()
    assert back[0]["y"] == page and back[1]["z"] == "" == back[2]["z"]
    record = spark.createDataFrame([(json.dumps({"html": None, "compressed_html": "q"}),), (json.dumps({"compressed_html": "q"}),), ("{}",), (json.dumps({"html": page}),)], "r string")
    got = [r[0] for r in record.select(codec.encode_or_keep(F.col("r"))).collect()]
    assert got[:3] == ["", "q", ""] and gzip.decompress(base64.b64decode(got[3])).decode() == page
    mongo = spark.createDataFrame([('{"$binary": {"base64": "YQ=="}}',), ('{"a": 1}',), ("[1]",)], "r string")
    assert [r[0] for r in mongo.select(codec.mongo_binary(F.col("r"))).collect()] == ["YQ==", None, None]
    assert one(spark, "a &eacute; b", codec.unescaped) == "a é b"


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"url":"http://a","categories":["x","y"]}\n\n{bad\n{"url":"http://b","categories":"z"}\n')
    rows = io.jsonl(spark, str(tmp_path / "a.jsonl"), io.TRAINING).collect()
    assert [(r["url"], r["categories"]) for r in rows] == [("http://a", '["x","y"]'), ("http://b", "z")]
    assert io.jsonl(spark, str(tmp_path / "a.jsonl"), io.TRAINING, keep_bad=True).where("bad is not null").count() == 1
    (tmp_path / "b.json").write_text('[{"url": "u", "n": 1}, {"url": "v", "n": 2}]')
    assert io.json_array(spark, str(tmp_path / "b.json"), "url string, n int").count() == 2
    (tmp_path / "u.csv").write_text("id,url\n1,X.com/A\n2,http://Y.org/b/\n3,X.com/A\n4,\n")
    assert {r["url"] for r in io.url_list(spark, str(tmp_path / "u.csv")).collect()} == {"https://X.com/A", "http://y.org/b"}
    assert io.url_list(spark, str(tmp_path / "u.csv"), limit=1, seed=3).count() == 1
    with pytest.raises(ValueError):
        io.pages(spark, "x.xml")
    (tmp_path / "s.txt").write_text("http://a.com/ ['News']\n<p>one</p>\n<p>two</p>\nhttps://b.org/x ['Sport']\n<b>three</b>\n")
    got = io.sample_file(spark, str(tmp_path / "s.txt")).collect()
    assert [(r["url"], r["label"]) for r in got] == [("http://a.com/", "News"), ("https://b.org/x", "Sport")] and "two" in got[0]["html"]

    def fetch(url):
        if "bad" in url:
            raise TimeoutError("slow")
        return (404, "no") if "none" in url else (200, "<p>x</p>")

    got = {r["url"]: r for r in io.fetched(spark.createDataFrame([("ok",), ("none",), ("bad",)], "url string"), fetch, 2).collect()}
    assert got["ok"]["success"] and not got["none"]["success"] and got["bad"]["error"] == "TimeoutError: slow"
    df = spark.createDataFrame([("a", None)], "url string, html string")
    io.write_jsonl(df, str(tmp_path / "out"))
    assert '"html":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    io.write_parquet(df.limit(0), str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).columns == ["url", "html"]
    io.write_label_lines(spark.createDataFrame([("A b", " x  y ")], "l string, t string"), "l", "t", str(tmp_path / "ft"))
    assert "__label__A_b x y" in "".join(p.read_text() for p in (tmp_path / "ft").glob("part*"))


PAGE = """<html><head><title>T</title><meta name="description" content="d"><meta property="og:title" content="og"><script>var a = "</p>";</script></head>
<body><nav class="menu"><a href="/">h</a></nav><table><tr><td>1<td>2<tr><td>3</table><ul><li>a<li>b<li>c</ul>
<div id="content"><h1>Head</h1><p>Para <b>one<p>two</div><div style="display: none">gone</div><form action="/search"><input type="password"></form></body></html>"""


def test_dom():
    nodes = dom.parse(PAGE)
    tags = [n.tag for n in nodes]
    assert tags.count("tr") == 2 and tags.count("td") == 3 and tags.count("li") == 3 and dom.parse(" ") is None and dom.parse("no tags") is None
    assert next(n for n in nodes if n.tag == "li").parent.tag == "ul" and dom.repeats(nodes)[0] == ("li()", 3)
    assert dom.main_content(nodes, (*pages.BOILERPLATE, "menu"), 5) == "Head Para one two" and "var a" not in dom.page_text(nodes)
    fields = dom.heading_fields(nodes)
    assert (fields["title"], fields["description"], fields["og_title"], fields["headings"]) == ("T", "d", "og", ["Head"])
    assert dom.markdownish(nodes).splitlines()[0] == "h" and "# Head" in dom.markdownish(nodes)
    p = features.Page(nodes, PAGE)
    groups = {g: list(f(p)) for g, f in features.TOKENS.items()}
    assert "x:input_type=password" in groups["attr"] and groups["css"].count("fa:search") == 2 and "m:og=og:title" in groups["meta"] and "i:content" in groups["css"]
    assert len(pages.DENSE_NAMES) == len(features.statistics(p)) == 129 and "R:li>text" in groups["tag"]


def test_curate(spark):
    notes = spark.createDataFrame([("http://a/", ["x"], False, True, 1), ("http://a", ["y"], False, True, 2), ("http://b", [], False, True, 3), ("http://c", ["z"], None, True, 4), ("http://d", ["z"], False, None, 5)], "url string, categories array<string>, needs_human_review boolean, in_target_language boolean, line_no int")
    stock = spark.createDataFrame([("http://a//", "first", 1), ("http://a", "second", 2), ("http://b", None, 3)], "url string, content string, line_no int")
    got = curate.annotation_join(curate.good_annotations(notes), stock, "content", ["line_no"]).collect()
    assert [(r["url"], r["categories"], r["content"]) for r in got] == [("http://a", ["x"], "first")]
    merged = curate.union_all([spark.createDataFrame([("u", "c")], "url string, category string"), spark.createDataFrame([("u", None), ("v", "c")], "url string, category string")])
    assert curate.dedup_composite(merged, ["url", "category"], ["file_rank"]).count() == 3
    with pytest.raises(ValueError):
        curate.aligned(stock, spark.createDataFrame([("q", [1.0])], "url string, e array<float>"), "url", "e", 1)


def test_decide_edges(spark):
    scores = spark.createDataFrame([(1, "a", 0.1, 0), (1, "b", 0.2, 1), (2, "a", 0.3, 0), (2, "b", 0.3, 0)], "id int, label string, score double, y int")
    got = {(r["id"], r["label"]): r["pred"] for r in decide.decoded(scores, spark.createDataFrame([("a", 0.5), ("b", 0.5)], "label string, thr double"), "id").collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (2, "a"): 1, (2, "b"): 0}
    assert {r["label"]: r["thr"] for r in decide.best_thresholds(decide.sweep(scores, [0.1, 0.2, 0.3])).collect()}["a"] == 0.5
    assert decide.auc(scores).where("label = 'a'").count() == 0
    assert decide.shared_threshold(scores, [0.1, 0.2]) == 0.2
    flat = vectorize.minmax(spark.createDataFrame([(1.0,), (1.0,)], "x double"), ["x"])
    assert [r["x"] for r in flat.collect()] == [0.0, 0.0]
    split = sampling.group_split(spark.createDataFrame([(i, f"g{i % 20}") for i in range(200)], "i int, g string"), "g")
    assert split.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert sampling.folds(spark.range(100), "id").select("fold").distinct().count() == 3


def test_models(spark, tmp_path):
    rows = [(i, "good news today" if i % 2 else "bad cat sleeps", "x" if i % 2 else "y") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string, label string").withColumn("tokens", models.text_tokens(F.col("text")))
    model = models.text_pipeline(buckets=512).fit(df)
    assert model.transform(df).where("y <> prediction").count() == 0
    models.save(model, spark.createDataFrame([("x", 0.5)], "label string, thr double"), str(tmp_path / "m"))
    again, thr = models.load(spark, str(tmp_path / "m"))
    assert again.transform(df).where("y <> prediction").count() == 0 and thr.count() == 1
    best = models.compare(model.transform(df).select("features", F.col("y")), 2)
    assert best[0][1] > 0.9


def test_classifier(spark, tmp_path):
    from pagelens.operators import classifier

    rows = [(i, f"<html><body><{'article' if i % 2 else 'table'}><p class='{'news' if i % 2 else 'shop'}-box'>w{i} text</p></body></html>", ["news"] if i % 2 else ["shop", "sale"]) for i in range(80)]
    df = spark.createDataFrame(rows, "page_id long, html string, labels array<string>")
    vectors = df.select("page_id", F.array(F.lit(0.1), F.lit(0.2)).alias("vector"))
    model = classifier.StructuralClassifier().fit(df.select("page_id", "html"), df.select("page_id", "labels"), vectors)
    overall, by_label = model.evaluate(df.select("page_id", "html"), df.select("page_id", "labels"), vectors)
    assert overall.first()["micro_f1"] > 0.95 and by_label.count() == 3
    assert model.explain(spark, 5).where("label = 'news'").count() == 5
    model.save(str(tmp_path / "c"))
    again = classifier.StructuralClassifier.load(str(tmp_path / "c"))
    key = ["page_id", "label"]
    a, b = (m.scores(df.select("page_id", "html"), vectors).orderBy(*key).collect() for m in (model, again))
    assert a == b and classifier.config_score(0.5, 0.4, 0.2) == 0.8


def test_io_extras(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>Ž</p>", encoding="utf-8")
    (tmp_path / "b.html").write_bytes(gzip.compress("<p>gz</p>".encode()))
    assert {r["html"] for r in io.page_file(spark, str(tmp_path / "*.html")).collect()} == {"<p>Ž</p>", "<p>gz</p>"}
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert io.cached(spark, str(tmp_path / "cache"), {"groups": ("a",), "schema": 1}, make).count() == 3
    assert len(made) == 1 and io.markdown(spark.range(1)).splitlines() == ["| id |", "| --- |", "| 0 |"]
    nested = spark.read.json(spark.sparkContext.parallelize(['{"domain_name": "d", "category": "c", "html": {"compressed_html": {"$binary": {"base64": "YQ=="}}}}', '{"domain_name": "e", "category": "c", "html": null}']))
    assert [tuple(r) for r in io.flattened_export(nested).collect()] == [("d", "c", "YQ=="), ("e", "c", None)]
    stats = spark.createDataFrame([("Ab 1.50 é!",)], "x string").select(text.shape_stats(F.col("x")).alias("s")).first()["s"]
    assert stats["n_prices"] == 1 and stats["upper"] == 0.1
    enc = models.encoded(spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "id int, w array<string>"), "id", "w", lambda texts: [[3.0, 4.0] for _ in texts])
    assert enc.first()["vector"] == [0.6, 0.8]
