"""Catalogue queries over page urls and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import html, urls
from pagelens.operators import curate
from pagelens.plans.catalog import query

AUTH = urls.AUTHORITY.replace("'", "''")
SQL_HOST = f"lower(regexp_replace(regexp_extract(url, '{AUTH}', 1), '^[^@]*@|:[0-9]*$|\\.$', '', 'g'))"
SQL_PATH = f"regexp_extract(url, '{urls.PATH}', 1)"
SQL_DOMAIN = f"array_to_string(list_slice(string_split({SQL_HOST}, '.'), greatest(len(string_split({SQL_HOST}, '.')) - 1, 1), len(string_split({SQL_HOST}, '.'))), '.')"
SQL_SCHEME = f"lower(regexp_extract(url, '{urls.SCHEME}', 1))"
SQL_LINKS = "SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref=\"([^\"]*)\"', 1)) AS href FROM pages"
BLACKLIST = ("spam-farm.example.org", "example.net")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url", F.explode(html.hrefs(F.col("html"))).alias("href"))


@query("url_normalized", f"SELECT page_id, lower({SQL_SCHEME} || '://' || regexp_extract(url, '{AUTH}', 1) || CASE WHEN regexp_replace({SQL_PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({SQL_PATH}, '/+$', '') END) AS normalized, regexp_replace(url, '/+$', '') AS key FROM pages")
def url_normalized(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.normalized(F.col("url")).alias("normalized"), urls.strip_slashes(F.col("url")).alias("key"))


@query("url_with_scheme", f"SELECT page_id, CASE WHEN regexp_matches(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN u ELSE 'https://' || u END AS completed FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^https?://', '') END AS u FROM pages)")
def url_with_scheme(spark, sf_dir):
    bare = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^https?://", ""))
    return read(spark, sf_dir, "pages").select("page_id", urls.with_scheme(bare).alias("completed"))


@query("url_registrable_domain", f"SELECT page_id, {SQL_HOST} AS host, {SQL_DOMAIN} AS domain FROM pages")
def url_registrable_domain(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.registrable_domain(F.col("url")).alias("domain"))


SUFFIXED = "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'http://shop' || page_id || '.a.co.uk/x' WHEN 1 THEN 'https://b' || page_id || '.com.au' ELSE url END AS url FROM pages"
SQL_KEEP = f"CASE WHEN list_contains({list(urls.TWO_LABEL_SUFFIXES)}, {SQL_DOMAIN}) THEN 3 ELSE 2 END"


@query("url_homepage", f"""
WITH s AS (SELECT page_id, url, {SQL_SCHEME} AS scheme, string_split({SQL_HOST}, '.') AS labels, {SQL_KEEP} AS keep, {SQL_PATH} IN ('', '/') AND regexp_extract(url, '{urls.QUERY}', 1) = '' AS is_homepage FROM ({SUFFIXED}))
SELECT page_id, CASE WHEN scheme IN ('http','https') THEN scheme ELSE 'https' END || '://' || CASE WHEN len(labels) >= keep THEN array_to_string(labels[-keep:], '.') ELSE '' END || '/' AS homepage, is_homepage FROM s""")
def url_homepage(spark, sf_dir):
    i = F.col("page_id")
    url = F.when(i % 3 == 0, F.concat(F.lit("http://shop"), i, F.lit(".a.co.uk/x"))).when(i % 3 == 1, F.concat(F.lit("https://b"), i, F.lit(".com.au"))).otherwise(F.col("url"))
    made = read(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    return made.select("page_id", urls.homepage(F.col("url")).alias("homepage"), urls.is_homepage(F.col("url")).alias("is_homepage"))


@query("url_parts", f"SELECT {SQL_SCHEME} AS scheme, regexp_extract(url, '{urls.QUERY}', 1) <> '' AS has_query, contains(url, '#') AS has_fragment, count(*) AS n FROM pages GROUP BY ALL")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").groupBy(urls.scheme(u).alias("scheme"), (urls.query(u) != "").alias("has_query"), u.contains("#").alias("has_fragment")).agg(F.count("*").alias("n"))


SQL_STOP = ", ".join(f"'{x}'" for x in urls.STOP_LABELS)


def sql_names(x: str) -> str:
    parts = f"list_filter(string_split_regex(lower(substr(trim({x}), 1, 40)), '[^a-z0-9]+'), lambda p: length(p) > 2 AND NOT regexp_full_match(p, '[0-9]+'))"
    return f"list_concat({parts}, CASE WHEN len({parts}) >= 2 AND length(array_to_string({parts}, '-')) <= 40 THEN [array_to_string({parts}, '-')] ELSE [] END)"


@query("url_tokens_long", f"""
WITH t AS (
  SELECT 'host' AS part, unnest(flatten(list_transform(list_filter(string_split({SQL_HOST}, '.'), lambda l: l NOT IN ({SQL_STOP})), lambda l: {sql_names('l')}))) AS token FROM pages
  UNION ALL
  SELECT 'path', unnest(flatten(list_transform(list_slice(s, 1, len(s) - 1), lambda l: {sql_names('l')}))) FROM (SELECT list_filter(string_split({SQL_PATH}, '/'), lambda l: l <> '') AS s FROM pages)
  UNION ALL
  SELECT 'file', unnest(CASE WHEN contains(f, '.') THEN list_concat({sql_names("regexp_replace(f, '\\.[^.]*$', '')")}, CASE WHEN length(regexp_extract(f, '\\.([^.]*)$', 1)) BETWEEN 1 AND 5 THEN ['ext:' || lower(regexp_extract(f, '\\.([^.]*)$', 1))] ELSE [] END) ELSE [] END)
  FROM (SELECT string_split({SQL_PATH}, '/')[-1] AS f FROM pages))
SELECT part, token, count(*) AS n FROM t GROUP BY ALL""")
def url_tokens_long(spark, sf_dir):
    u = F.col("url")
    parts = F.map_from_arrays(F.array(F.lit("host"), F.lit("path"), F.lit("file")), F.array(urls.host_tokens(u), urls.path_tokens(u), urls.file_tokens(u)))
    return read(spark, sf_dir, "pages").select(F.explode(parts).alias("part", "tokens")).select("part", F.explode("tokens").alias("token")).groupBy("part", "token").agg(F.count("*").alias("n"))


#: Links made from page urls, as the pages' own are all of one shape.
MADE_LINKS = """SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN url || '?id=' || page_id || '&Sort=up#top' WHEN 1 THEN '/a/' || page_id || '/b.HTML' WHEN 2 THEN 'mailto:a@b.example.org' WHEN 3 THEN 'https://other' || (page_id % 7) || '.example.com/{x}/'
  WHEN 4 THEN '//' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/x/y/z' ELSE 'javascript:go(%d)' END AS href FROM pages"""


def made_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("page_id"), F.col("url")
    href = (
        F.when(i % 6 == 0, F.concat(u, F.lit("?id="), i, F.lit("&Sort=up#top"))).when(i % 6 == 1, F.concat(F.lit("/a/"), i, F.lit("/b.HTML"))).when(i % 6 == 2, "mailto:a@b.example.org")
        .when(i % 6 == 3, F.concat(F.lit("https://other"), i % 7, F.lit(".example.com/{x}/"))).when(i % 6 == 4, F.concat(F.lit("//"), urls.authority(u), F.lit("/x/y/z"))).otherwise("javascript:go(%d)")
    )
    return read(spark, sf_dir, "pages").select("page_id", "url", href.alias("href"))


@query("href_shape_counts", rf"""
WITH l AS ({MADE_LINKS} UNION ALL {SQL_LINKS}),
q AS (SELECT href, CASE WHEN contains(href, '?') THEN string_split(substr(href, strpos(href, '?') + 1), '&') ELSE [] END AS pairs, lower(regexp_extract(href, '\.([A-Za-z0-9]{{1,5}})(?:[?#]|$)', 1)) AS ext,
  len(list_filter(string_split(regexp_extract(href, '^([^?]*)', 1), '/'), lambda x: x <> '')) - 2 AS depth FROM l),
t AS (SELECT unnest(list_concat(list_filter([
    CASE WHEN ext <> '' THEN 'H:ext=' || ext END, CASE WHEN len(pairs) > 0 THEN 'H:q=' || least(len(pairs), 6) END, CASE WHEN contains(href, '#') THEN 'H:frag' END, CASE WHEN regexp_matches(href, '/[0-9]{{1,8}}([./]|$)') THEN 'H:numseg' END,
    CASE WHEN ends_with(href, '/') THEN 'H:slash' END, CASE WHEN starts_with(href, 'mailto:') THEN 'H:mailto' END, CASE WHEN starts_with(href, 'javascript:') THEN 'H:jscript' END,
    CASE WHEN regexp_matches(href, '[{{}}]|%d') THEN 'H:template' END, 'H:depth=' || greatest(0, least(depth, 8))], lambda x: x IS NOT NULL),
  list_transform(list_filter(list_transform(pairs[1:6], lambda x: lower(string_split(x, '=')[1])), lambda k: length(k) <= 16), lambda k: 'H:key=' || k))) AS token FROM q WHERE href <> '')
SELECT token, count(*) AS n FROM t GROUP BY token""")
def href_shape_counts(spark, sf_dir):
    every = made_links(spark, sf_dir).unionByName(links(spark, sf_dir))
    return every.select(F.explode(urls.href_shape(F.col("href"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("page_links_resolved", f"""
WITH l AS ({SQL_LINKS}), r AS (SELECT page_id, CASE WHEN starts_with(href, '/') THEN {SQL_SCHEME} || '://' || regexp_extract(url, '{AUTH}', 1) || href ELSE href END AS url FROM l)
SELECT DISTINCT page_id, lower({SQL_SCHEME} || '://' || regexp_extract(url, '{AUTH}', 1) || CASE WHEN regexp_replace({SQL_PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({SQL_PATH}, '/+$', '') END) AS link
FROM r WHERE {SQL_SCHEME} IN ('http','https') AND NOT regexp_matches(lower(url), '{urls.SKIPPED_FILES}')""")
def page_links_resolved(spark, sf_dir):
    out = links(spark, sf_dir).select("page_id", urls.resolved(F.col("url"), F.col("href")).alias("link"))
    return out.where(urls.crawlable(F.col("link"))).select("page_id", urls.normalized(F.col("link")).alias("link")).distinct()


@query("link_external_share", f"""
WITH l AS ({MADE_LINKS} UNION ALL {SQL_LINKS}), d AS (SELECT *, {SQL_DOMAIN} AS domain, lower(regexp_replace(regexp_extract(href, '{AUTH}', 1), '^[^@]*@|:[0-9]*$|\\.$', '', 'g')) AS host FROM l)
SELECT page_id, count(*) AS n_links, round(sum(CASE WHEN regexp_matches(href, '^([a-zA-Z][a-zA-Z0-9+.-]*:)?//') AND array_to_string(string_split(host, '.')[-2:], '.') <> domain THEN 1 ELSE 0 END) / count(*), 6) AS external_share FROM d GROUP BY page_id""")
def link_external_share(spark, sf_dir):
    every = made_links(spark, sf_dir).unionByName(links(spark, sf_dir))
    out = every.withColumn("out", urls.is_external(F.col("url"), F.col("href")).cast("int"))
    return out.groupBy("page_id").agg(F.count("*").alias("n_links"), F.round(F.sum("out") / F.count("*"), 6).alias("external_share"))


@query("domain_page_counts", f"SELECT {SQL_DOMAIN} AS domain, count(*) AS n_pages, count(DISTINCT {SQL_HOST}) AS n_hosts FROM pages GROUP BY 1")
def domain_page_counts(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").groupBy(urls.registrable_domain(u).alias("domain")).agg(F.count("*").alias("n_pages"), F.countDistinct(urls.host(u)).alias("n_hosts"))


@query("domain_blacklist_anti", f"SELECT page_id, host FROM (SELECT page_id, {SQL_HOST} AS host, {SQL_DOMAIN} AS domain FROM pages) WHERE host NOT IN {BLACKLIST} AND domain NOT IN {BLACKLIST}")
def domain_blacklist_anti(spark, sf_dir):
    black = spark.createDataFrame([(x,) for x in BLACKLIST], "name string")
    out = read(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.registrable_domain(F.col("url")).alias("domain"))
    out = curate.anti(out, black.withColumnRenamed("name", "host"), "host")
    return curate.anti(out, black.withColumnRenamed("name", "domain"), "domain").select("page_id", "host")
