"""Catalogue queries over page content."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.functions import html, text
from pagelens.operators import features
from pagelens.operators import pages as trees
from pagelens.operators import vectorize
from pagelens.plans.catalog import query
from pagelens.plans.url_queries import read

SQL_BARE = rf"regexp_replace(regexp_replace(html, '{html.UNSEEN}', ' ', 'g'), '{html.TAG}', ' ', 'g')"
SQL_TEXT = rf"trim(regexp_replace({SQL_BARE}, '[ \t\r\n\f]+', ' ', 'g'))"
SQL_TITLE = r"trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
SQL_WORDS = rf"SELECT page_id, unnest(regexp_extract_all(lower({SQL_TEXT}), '\p{{L}}{{3,}}')) AS token FROM pages"
SQL_TAGS = r"SELECT page_id, lower(unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages"


def page_words(spark, sf_dir):
    return vectorize.token_counts(read(spark, sf_dir, "pages"), "page_id", text.words(html.visible_text(F.col("html"))))


@query("page_word_df", f"""
WITH t AS ({SQL_WORDS}), d AS (SELECT token, count(DISTINCT page_id) AS df FROM t GROUP BY token), n AS (SELECT count(*) AS n FROM pages)
SELECT token, df, round(ln((1.0 + n) / (1.0 + df)) + 1, 6) AS idf FROM d, n ORDER BY df DESC, token LIMIT 100""")
def page_word_df(spark, sf_dir):
    n = read(spark, sf_dir, "pages").count()
    out = vectorize.document_frequency(page_words(spark, sf_dir))
    return out.withColumn("idf", F.round(F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1, 6)).orderBy(F.desc("df"), "token").limit(100)


@query("page_title_meta", f"SELECT page_id, {SQL_TITLE} AS title, length({SQL_TITLE}) AS n_title FROM pages")
def page_title_meta(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"), F.length(html.title(F.col("html"))).cast("long").alias("n_title"))


@query("page_html_counters", "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '(?i)<{t}[\\s/>]')) AS n_{t}" for t in html.COUNTED) + f", round(length({SQL_TEXT}) / greatest(length(html), 1), 6) AS text_ratio FROM pages")
def page_html_counters(spark, sf_dir):
    made = html.counters(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", *made).select("page_id", *[F.col(f"n_{t}").cast("long").alias(f"n_{t}") for t in html.COUNTED], "text_ratio")


@query("page_tag_counts", f"WITH t AS ({SQL_TAGS}) SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM t GROUP BY tag")
def page_tag_counts(spark, sf_dir):
    tags = read(spark, sf_dir, "pages").select("page_id", F.explode(html.tags(F.col("html"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query("tag_entropy", f"WITH t AS ({SQL_TAGS}), c AS (SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT page_id, n / sum(n) OVER (PARTITION BY page_id) AS p FROM c) SELECT page_id, round(-sum(p * log2(p)), 6) AS entropy FROM s GROUP BY page_id")
def tag_entropy(spark, sf_dir):
    counts = vectorize.token_counts(read(spark, sf_dir, "pages"), "page_id", html.tags(F.col("html")), 1 << 30)
    return vectorize.entropy(counts, "page_id", "tf").select("page_id", F.round("entropy", 6).alias("entropy"))


@query("page_prompt_text", f"SELECT page_id, {SQL_TEXT} AS text FROM pages")
def page_prompt_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", html.visible_text(F.col("html")).alias("text"))


@query("page_prompt_truncated", f"SELECT page_id, CASE WHEN length(t) > 500 THEN rtrim(substr(t, 1, 400)) || chr(10) || '...[TRUNCATED]...' || chr(10) || ltrim(right(t, 100)) ELSE t END AS prompt FROM (SELECT page_id, {SQL_TEXT} AS t FROM pages)")
def page_prompt_truncated(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.truncated(html.visible_text(F.col("html")), 500).alias("prompt"))


@query("page_preview", f"SELECT page_id, CASE WHEN length(html) > 200 THEN substr(html, 1, 200) || '...' ELSE html END AS preview FROM pages")
def page_preview(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.preview(F.col("html")).alias("preview"))


def sql_needles(needles: dict) -> str:
    quoted = lambda x: x.replace("'", "''")
    cases = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(html), '{quoted(x)}')" for x in some) + f" THEN '{name}' END" for name, some in needles.items())
    return f"WITH t AS (SELECT page_id, unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS name FROM pages) SELECT name, count(*) AS n FROM t GROUP BY name"


@query("platform_fingerprints", sql_needles(html.PLATFORMS))
def platform_fingerprints(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(F.explode(html.matches(F.col("html"), html.PLATFORMS)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("marker_hits", sql_needles(html.MARKERS))
def marker_hits(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(F.explode(html.matches(F.col("html"), html.MARKERS)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("token_df_band", f"WITH t AS ({SQL_WORDS}), d AS (SELECT token, count(DISTINCT page_id) AS df FROM t GROUP BY token) SELECT token, df FROM d WHERE df BETWEEN 5 AND (SELECT greatest(5, floor(count(*) * 0.5)) FROM pages)")
def token_df_band(spark, sf_dir):
    n = read(spark, sf_dir, "pages").count()
    return vectorize.vocabulary(vectorize.document_frequency(page_words(spark, sf_dir)), n, 5, 0.5).select("token", "df")


@query("vocab_topk", f"WITH t AS ({SQL_WORDS}), d AS (SELECT token, count(DISTINCT page_id) AS df FROM t GROUP BY token) SELECT token, df, row_number() OVER (ORDER BY df DESC, token) - 1 AS col FROM d ORDER BY df DESC, token LIMIT 200")
def vocab_topk(spark, sf_dir):
    n = read(spark, sf_dir, "pages").count()
    return vectorize.vocabulary(vectorize.document_frequency(page_words(spark, sf_dir)), n, size=200).select("token", "df", F.col("col").cast("long").alias("col"))


@query("page_entities_unescaped", "SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS title FROM (SELECT page_id, " + SQL_TITLE + " AS t FROM pages)")
def page_entities_unescaped(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.unescape_common(html.title(F.col("html"))).alias("title"))


@query("dom_depth_stats")
def dom_depth_stats(spark, sf_dir):
    return trees.depth_stats(trees.node_table(read(spark, sf_dir, "pages")))


@query("dom_repeat_runs")
def dom_repeat_runs(spark, sf_dir):
    return trees.repeat_runs(trees.node_table(read(spark, sf_dir, "pages")))


SQL_NODES = r"SELECT page_id, lower(tags[pos]) AS tag, pos FROM (SELECT page_id, tags, unnest(range(1, len(tags) + 1)) AS pos FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1) AS tags FROM pages))"


@query("dom_top_tags", f"""
WITH t AS (SELECT page_id, tag, count(*) AS n, min(pos) AS first FROM ({SQL_NODES}) GROUP BY page_id, tag)
SELECT page_id, tag, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first) AS rank FROM t) WHERE rank <= 12""")
def dom_top_tags(spark, sf_dir):
    return trees.top_tags(trees.node_table(read(spark, sf_dir, "pages"))).withColumn("rank", F.col("rank").cast("long"))


@query("dom_links_before_text")
def dom_links_before_text(spark, sf_dir):
    return trees.links_before_text(trees.node_table(read(spark, sf_dir, "pages")))


@query("dom_tag_tokens", f"SELECT page_id, 't:' || tag AS token, count(*) AS tf FROM ({SQL_NODES}) GROUP BY ALL")
def dom_tag_tokens(spark, sf_dir):
    return trees.token_groups(read(spark, sf_dir, "pages"), ("tag",)).where("token like 't:%'").select("page_id", "token", F.col("tf").cast("long").alias("tf"))


#: Pages that begin with markup of known names.
DRESSED = """SELECT page_id, '<div class="product-Box x' || (page_id % 3) || '" id="top-nav"></div>' || CASE WHEN page_id % 2 = 0 THEN '<img src="/wp-content/Files/big-photo.png" width="90" height="30">' ELSE '' END || html AS html FROM pages"""


def dressed(spark, sf_dir):
    i = F.col("page_id")
    head = F.concat(F.lit('<div class="product-Box x'), i % 3, F.lit('" id="top-nav"></div>'), F.when(i % 2 == 0, '<img src="/wp-content/Files/big-photo.png" width="90" height="30">').otherwise(""))
    return read(spark, sf_dir, "pages").select("page_id", F.concat(head, "html").alias("html"))


@query("dom_name_tokens", f"""
SELECT page_id, grp, token, tf::BIGINT AS tf FROM (SELECT page_id FROM pages), (VALUES ('css', 'c:product', 1), ('css', 'c:box', 1), ('css', 'c:product-box', 1), ('css', 'i:top', 1), ('css', 'i:nav', 1), ('css', 'i:top-nav', 1)) v(grp, token, tf)
UNION ALL SELECT page_id, grp, token, 1 FROM (SELECT page_id FROM pages WHERE page_id % 2 = 0), (VALUES ('res', 'r:big'), ('res', 'r:photo'), ('res', 'r:big-photo'), ('res', 'r:ext:png')) v(grp, token)
UNION ALL SELECT page_id, 'cssraw', 'C:product-Box-|-x' || (page_id % 3), 1 FROM pages UNION ALL SELECT page_id, 'cssraw', 'C:' || c, 1 FROM (SELECT page_id, unnest(['product-box', 'x' || (page_id % 3), 'ad']) AS c FROM pages)
UNION ALL SELECT page_id, 'attr', 'img:wide', 1 FROM pages WHERE page_id % 2 = 0""")
def dom_name_tokens(spark, sf_dir):
    found = trees.token_groups(dressed(spark, sf_dir), ("css", "res", "cssraw", "attr"))
    return found.where("(grp <> 'attr' or token like 'img:%') and (grp <> 'res' or token in ('r:big', 'r:photo', 'r:big-photo', 'r:ext:png'))").select("page_id", "grp", "token", F.col("tf").cast("long").alias("tf"))


def sql_contains(needle: str) -> str:
    return "contains(lower(html), '" + needle.replace("'", "''") + "')"


SQL_MARKERS = ", ".join("CASE WHEN " + " OR ".join(map(sql_contains, some)) + f" THEN 'M:{name}' END" for name, some in features.MARKERS.items())
SQL_PLATFORMS = ", ".join(f"CASE WHEN {sql_contains(needle)} THEN 'P:{name}' END" for needle, name in features.PLATFORMS.items())


@query("dom_marker_tokens", f"SELECT page_id, unnest(list_filter([{SQL_MARKERS}], lambda x: x IS NOT NULL)) AS token FROM pages")
def dom_marker_tokens(spark, sf_dir):
    return trees.token_groups(read(spark, sf_dir, "pages"), ("marker",)).select("page_id", "token")


@query("dom_platform_tokens", f"SELECT page_id, token, count(*) AS tf FROM (SELECT page_id, unnest(list_filter([{SQL_PLATFORMS}], lambda x: x IS NOT NULL)) AS token FROM ({DRESSED})) GROUP BY ALL")
def dom_platform_tokens(spark, sf_dir):
    found = trees.token_groups(dressed(spark, sf_dir), ("plat",))
    return found.where("token like 'P:%' and not token rlike '^P:(script_|iframe_|datauri)'").select("page_id", "token", F.col("tf").cast("long").alias("tf"))


COUNTED = {k: v[0] for k, v in features.COUNTED.items() if len(v) == 1}
SQL_COUNTED = ", ".join(f"round(ln(1 + coalesce(sum(n) FILTER (tag = '{tag}'), 0)), 6) AS {name}" for name, tag in COUNTED.items())


@query("dom_counted_stats", f"""
WITH t AS (SELECT page_id, tag, count(*) AS n FROM ({SQL_NODES}) GROUP BY ALL), s AS (SELECT page_id, sum(n) AS total, max(n) AS most, count(*) AS kinds FROM t GROUP BY page_id)
SELECT page_id, {SQL_COUNTED}, round(ln(1 + any_value(total)), 6) AS n_elements, any_value(kinds)::DOUBLE AS n_unique_tags, round(any_value(most) / any_value(total), 6) AS tag_top1_share,
  round(-sum(n / total * log2(n / total)), 6) AS tag_entropy FROM t JOIN s USING (page_id) GROUP BY page_id""")
def dom_counted_stats(spark, sf_dir):
    made = trees.dense_stats(read(spark, sf_dir, "pages"))
    return made.select("page_id", *[F.round(c, 6).alias(c) for c in (*COUNTED, "n_elements", "n_unique_tags", "tag_top1_share", "tag_entropy")])


@query("page_more_counters", rf"""
SELECT page_id, len(regexp_extract_all(html, '(?i)<link\b[^>]*\brel=["'']?stylesheet')) AS n_stylesheets, len(regexp_extract_all(html, '(?i)<script\b[^>]*\bsrc=')) AS n_external_scripts, len(list_distinct(tags)) AS n_unique_tags,
  round(len(regexp_extract_all(html, '(?i)<img[\s/>]')) / greatest(length({SQL_TEXT}), 1), 6) AS image_text_ratio,
  round(coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*>(.*?)</a>', 1), lambda x: length(trim(regexp_replace(x, '<[^>]+>', '', 'g'))))), 0) / greatest(length({SQL_TEXT}), 1), 6) AS link_density
FROM (SELECT page_id, html, list_transform(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda x: lower(x)) AS tags FROM pages)""")
def page_more_counters(spark, sf_dir):
    made = read(spark, sf_dir, "pages").select("page_id", *html.more_counters(F.col("html")))
    return made.select("page_id", *[F.col(c).cast("long").alias(c) for c in ("n_stylesheets", "n_external_scripts", "n_unique_tags")], "image_text_ratio", "link_density")


@query("page_cleaned_text")
def page_cleaned_text(spark, sf_dir):
    made = trees.renderings(read(spark, sf_dir, "pages"))
    return made.select("page_id", trees.cleaned().alias("text"), trees.cleaned_plain().alias("plain"))


@query("page_encoder_text")
def page_encoder_text(spark, sf_dir):
    return trees.renderings(read(spark, sf_dir, "pages")).select("page_id", trees.encoder_text().alias("text"))


def regular(spark, sf_dir):
    """Small pages of one form: a list of ``page_id % 7`` links and a paragraph of 20 to 59 words."""
    i = F.col("page_id")
    page = F.concat(F.lit("<html><body><ul>"), F.repeat(F.lit("<li><a>x</a></li>"), (i % 7).cast("int")), F.lit("</ul><p>"), F.repeat(F.lit("w "), (20 + i % 40).cast("int")), F.lit("</p></body></html>"))
    return read(spark, sf_dir, "pages").select("page_id", page.alias("html"))


@query("tree_depths_of_lists", """
WITH k AS (SELECT page_id, page_id % 7 AS k FROM pages)
SELECT page_id, 4 + 2 * k AS n_nodes, CASE WHEN k > 0 THEN 4 ELSE 2 END AS max_depth, round((5 + 7 * k) / (4 + 2 * k), 6) AS avg_depth,
  CASE WHEN k = 0 THEN 2 WHEN floor((3 + 2 * k) * 9 / 10) < 4 + k THEN 3 ELSE 4 END AS p90_depth, greatest(2, k) AS max_children, CASE WHEN k > 0 THEN 6 ELSE 4 END AS n_tags FROM k""")
def tree_depths_of_lists(spark, sf_dir):
    made = trees.depth_stats(trees.node_table(regular(spark, sf_dir)))
    return made.select("page_id", "avg_depth", *[F.col(c).cast("long").alias(c) for c in ("n_nodes", "max_depth", "p90_depth", "max_children", "n_tags")])


@query("tree_runs_of_lists", "SELECT page_id, 2 AS parent_pos, 'li(a)' AS signature, page_id % 7 AS n FROM pages WHERE page_id % 7 >= 3")
def tree_runs_of_lists(spark, sf_dir):
    return trees.repeat_runs(trees.node_table(regular(spark, sf_dir))).withColumn("parent_pos", F.col("parent_pos").cast("long"))


@query("tree_links_before_text", "SELECT page_id, page_id % 7 AS links_before FROM pages WHERE 20 + page_id % 40 >= 40")
def tree_links_before_text(spark, sf_dir):
    return trees.links_before_text(trees.node_table(regular(spark, sf_dir)))


@query("tree_tokens_of_lists", """
WITH k AS (SELECT page_id, page_id % 7 AS k FROM pages),
t AS (SELECT page_id, k, unnest(list_filter([
  {'t': 't:html', 'n': 1}, {'t': 't:body', 'n': 1}, {'t': 't:ul', 'n': 1}, {'t': 't:p', 'n': 1}, {'t': 't:li', 'n': k}, {'t': 't:a', 'n': k}, {'t': 'p:#doc>html', 'n': 1}, {'t': 'p:html>body', 'n': 1}, {'t': 'p:body>ul', 'n': 1},
  {'t': 'p:body>p', 'n': 1}, {'t': 'p:ul>li', 'n': k}, {'t': 'p:li>a', 'n': k}, {'t': 'd:html@0', 'n': 1}, {'t': 'd:body@1', 'n': 1}, {'t': 'd:ul@2', 'n': 1}, {'t': 'd:p@2', 'n': 1}, {'t': 'd:li@3', 'n': k}, {'t': 'd:a@4', 'n': k},
  {'t': 'T:html', 'n': 1}, {'t': 'T:body', 'n': 1}, {'t': 'T:ul', 'n': 1}, {'t': 'T:p', 'n': 1}, {'t': 'T:li', 'n': least(k, 1)}, {'t': 'T:a', 'n': least(k, 1)}, {'t': 'R:li>a', 'n': CASE WHEN k >= 3 THEN 1 ELSE 0 END},
  {'t': 'X:uniq_tags=' || CASE WHEN k > 0 THEN 6 ELSE 4 END, 'n': 1}, {'t': 'X:depth=' || CASE WHEN k > 0 THEN 4 ELSE 2 END, 'n': 1}], lambda x: x.n > 0)) AS x FROM k)
SELECT page_id, x.t AS token, x.n AS tf FROM t""")
def tree_tokens_of_lists(spark, sf_dir):
    return trees.token_groups(regular(spark, sf_dir), ("tag",)).select("page_id", "token", F.col("tf").cast("long").alias("tf"))


def article(spark, sf_dir):
    """Small pages with a head, a menu and an article."""
    page = (
        "<html><head><title>T#</title><meta name='description' content='D#'><meta name='keywords' content='a, b'><meta property='og:title' content='O#'></head>"
        "<body><nav><a href='/'>home</a></nav><article><h1>H#</h1><p>one two</p><ul><li>three</li></ul></article></body></html>"
    )
    return read(spark, sf_dir, "pages").select("page_id", F.replace(F.lit(page), F.lit("#"), F.col("page_id").cast("string")).alias("html"))


@query("tree_renderings_of_articles", """
SELECT page_id, 'T' || page_id AS title, 'D' || page_id AS description, 'a, b' AS keywords, 'O' || page_id AS og_title, '' AS og_description, 'H' || page_id AS headings, 'home H' || page_id || ' one two three' AS body,
  'T' || page_id || ' H' || page_id || ' one two three' AS main, 'home' || chr(10) || '# H' || page_id || chr(10) || 'one two' || chr(10) || '* three' AS lines FROM pages""")
def tree_renderings_of_articles(spark, sf_dir):
    return trees.renderings(article(spark, sf_dir)).withColumn("headings", F.array_join("headings", ","))


@query("tree_texts_of_articles", """
WITH p AS (SELECT page_id, 'T' || page_id AS t, 'D' || page_id AS d, 'O' || page_id AS o, 'H' || page_id AS h FROM pages)
SELECT page_id, t || ' ' || t || ' ' || d || ' ' || o || ' ' || h || ' home ' || h || ' one two three' AS weighted, t || ' ' || d || ' home ' || h || ' one two three' AS encoder FROM p""")
def tree_texts_of_articles(spark, sf_dir):
    made = trees.renderings(article(spark, sf_dir))
    return made.select("page_id", trees.weighted_text({"title": 2, "description": 1, "og_title": 1, "headings": 1}).alias("weighted"), trees.encoder_text().alias("encoder"))


@query("dom_token_groups")
def dom_token_groups(spark, sf_dir):
    return trees.token_groups(read(spark, sf_dir, "pages"))


@query("dom_dense_stats")
def dom_dense_stats(spark, sf_dir):
    return trees.dense_stats(read(spark, sf_dir, "pages"))


@query("dom_page_features")
def dom_page_features(spark, sf_dir):
    """Tokens of all groups and all statistics, from one parse of each page."""
    made = trees.page_features(read(spark, sf_dir, "pages"))
    return made.select("page_id", F.size("tokens").alias("n_distinct"), F.aggregate("tokens", F.lit(0), lambda n, t: n + t["tf"]).alias("n_tokens"), "stats")


@query("dom_renderings")
def dom_renderings(spark, sf_dir):
    return trees.renderings(read(spark, sf_dir, "pages"))


@query("page_weighted_text")
def page_weighted_text(spark, sf_dir):
    made = trees.renderings(read(spark, sf_dir, "pages"))
    return made.select("page_id", trees.weighted_text({"title": 3, "description": 2, "og_title": 2, "og_description": 1, "headings": 2}).alias("text"))


LINKED = '<script type="application/ld+json">{"@type": "Article"}</script>'


@query("page_noise_stripped", rf"SELECT page_id, regexp_replace(regexp_replace(CASE WHEN page_id % 2 = 0 THEN '{LINKED}' ELSE '' END || html, '(?s)<!--.*?(-->|\z)', '', 'g'), '(?is)(<script>).*?(</script>|\z)', '\1\2', 'g') AS html FROM pages")
def page_noise_stripped(spark, sf_dir):
    """Half of the pages begin with linked data, which stays."""
    page = F.concat(F.when(F.col("page_id") % 2 == 0, LINKED).otherwise(""), "html")
    return read(spark, sf_dir, "pages").select("page_id", html.strip_noise(page).alias("html"))


@query("structural_classifier")
def structural_classifier(spark, sf_dir):
    from pagelens.operators import classifier

    found = read(spark, sf_dir, "pages").select("page_id", "html", F.array(F.regexp_extract("url", "/([a-z]{2})/", 1)).alias("labels"))
    model = classifier.StructuralClassifier(classifier.Config(min_label=5)).fit(found.select("page_id", "html"), found.select("page_id", "labels"))
    return model.predict(found.select("page_id", "html")).select("page_id", "label", F.round("score", 6).alias("score"), "pred")
