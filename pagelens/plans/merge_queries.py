"""Catalogue queries over annotated pages, files and their codings. The annotations and files are made from the tables by fixed rules, so that SQL can follow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import text, urls
from pagelens.operators import curate, languages, sampling
from pagelens.plans.catalog import query
from pagelens.plans.url_queries import read
from pagelens.sources import codec, io
from pagelens.streaming import incremental

CATEGORIES = ["news", "shop", "sport", "forum", "blog"]
#: Annotations of pages: some twice, some with a slash at the end, some without labels or a language.
NOTES = """
SELECT page_id AS line_no, url || CASE WHEN page_id % 3 = 0 THEN '/' ELSE '' END AS url, CASE WHEN page_id % 7 = 0 THEN '' ELSE 'C' || (page_id % 5) || '; c' || (page_id % 4) END AS raw,
  page_id % 11 = 0 AS needs_human_review, CASE WHEN page_id % 13 = 0 THEN NULL ELSE page_id % 10 <> 0 END AS in_target_language FROM pages
UNION ALL SELECT page_id + 1000000, url, 'late', false, true FROM pages WHERE page_id % 2 = 0"""
SQL_LIST = "list_sort(list_distinct(list_filter(list_transform(string_split_regex(raw, '[,;|]'), lambda x: lower(trim(x))), lambda x: x <> '')))"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = read(spark, sf_dir, "pages"), F.col("page_id")
    raw = F.when(i % 7 == 0, "").otherwise(F.concat(F.lit("C"), i % 5, F.lit("; c"), i % 4))
    first = p.select(i.alias("line_no"), F.concat("url", F.when(i % 3 == 0, "/").otherwise("")).alias("url"), raw.alias("raw"), (i % 11 == 0).alias("needs_human_review"), F.when(i % 13 != 0, i % 10 != 0).alias("in_target_language"))
    late = p.where(i % 2 == 0).select((i + 1000000).alias("line_no"), "url", F.lit("late").alias("raw"), F.lit(False).alias("needs_human_review"), F.lit(True).alias("in_target_language"))
    return first.unionByName(late).withColumn("categories", text.parse_labels(F.col("raw")))


@query("annotation_join", f"""
WITH n AS (SELECT *, {SQL_LIST} AS categories, regexp_replace(url, '/+$', '') AS key FROM ({NOTES})),
g AS (SELECT * FROM n WHERE needs_human_review = false AND in_target_language = true AND len(categories) > 0),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY line_no) AS r FROM g) WHERE r = 1),
p AS (SELECT * FROM (SELECT regexp_replace(url, '/+$', '') AS key, html, row_number() OVER (PARTITION BY regexp_replace(url, '/+$', '') ORDER BY page_id) AS r FROM pages) WHERE r = 1)
SELECT l.key AS url, array_to_string(categories, ',') AS categories, line_no, md5(html) AS content FROM l JOIN p ON l.key = p.key WHERE html IS NOT NULL""")
def annotation_join(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("url", F.md5("html").alias("content"), F.col("page_id").alias("line_no"))
    out = curate.annotation_join(curate.good_annotations(notes(spark, sf_dir)), pages, "content", ["line_no"])
    return out.select("url", F.array_join("categories", ",").alias("categories"), "line_no", "content")


@query("annotation_good", f"SELECT line_no, array_to_string({SQL_LIST}, ',') AS categories FROM ({NOTES}) WHERE needs_human_review = false AND in_target_language = true AND len({SQL_LIST}) > 0")
def annotation_good(spark, sf_dir):
    return curate.good_annotations(notes(spark, sf_dir)).select("line_no", F.array_join("categories", ",").alias("categories"))


#: Three files of pages that overlap; some rows have no url.
FILES = """
SELECT 0 AS file_rank, page_id AS line_no, CASE WHEN page_id % 17 = 0 THEN NULL ELSE url END AS url, html FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT 1, page_id, CASE WHEN page_id % 19 = 0 THEN ' ' ELSE url END, html || 'b' FROM pages WHERE page_id % 3 <> 1
UNION ALL SELECT 2, page_id, url, html || 'c' FROM pages WHERE page_id % 2 = 0"""


def files(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    p, i = read(spark, sf_dir, "pages"), F.col("page_id")
    row = lambda url, html: [i.alias("line_no"), url.alias("url"), html.alias("html"), F.array(F.lit("x")).alias("categories")]
    return [
        p.where(i % 3 == 0).select(*row(F.when(i % 17 != 0, F.col("url")), F.col("html"))),
        p.where(i % 3 != 1).select(*row(F.when(i % 19 == 0, " ").otherwise(F.col("url")), F.concat("html", F.lit("b")))),
        p.where(i % 2 == 0).select(*row(F.col("url"), F.concat("html", F.lit("c")))),
    ]


@query("merge_files", f"SELECT url, md5(html) AS page FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY file_rank, line_no) AS r FROM ({FILES}) WHERE trim(url) <> '') WHERE r = 1")
def merge_files(spark, sf_dir):
    """Merged, compressed and inflated again."""
    return curate.merged(files(spark, sf_dir))[0].select("url", F.md5(codec.page_text(F.col("compressed_html"))).alias("page"))


@query("merge_status", f"""
WITH f AS ({FILES}), g AS (SELECT url, count(*) AS n FROM f WHERE trim(url) <> '' GROUP BY url)
SELECT 'processed' AS status, count(*)::BIGINT AS n FROM g UNION ALL SELECT 'duplicate', sum(n - 1)::BIGINT FROM g UNION ALL SELECT 'error', count(*)::BIGINT FROM f WHERE coalesce(trim(url), '') = ''""")
def merge_status(spark, sf_dir):
    return curate.merged(files(spark, sf_dir))[1]


@query("merge_file_ranks", f"SELECT file_rank::BIGINT AS file_rank, count(*) AS n FROM ({FILES}) GROUP BY file_rank")
def merge_file_ranks(spark, sf_dir):
    return curate.union_all(files(spark, sf_dir)).groupBy(F.col("file_rank").cast("long").alias("file_rank")).agg(F.count("*").alias("n"))


@query("first_line_of_url", f"SELECT url, min(line_no) AS line_no FROM ({NOTES}) WHERE url IS NOT NULL GROUP BY url")
def first_line_of_url(spark, sf_dir):
    return curate.first_positions(notes(spark, sf_dir).select("url", "line_no"), "url", "line_no")


@query("codec_round_trip", "SELECT page_id, md5(html) AS strict, md5(html) AS loose, md5(html) AS prompt, html AS mongo FROM pages")
def codec_round_trip(spark, sf_dir):
    """gzip and base64, back by each way of decoding; the last out of a nested ``$binary``."""
    packed = codec.compressed(F.col("html"))
    nested = F.to_json(F.struct(F.struct(F.col("packed").alias("base64")).alias("$binary")))
    p = read(spark, sf_dir, "pages").select("page_id", packed.alias("packed"))
    return p.select("page_id", F.md5(codec.page_text(F.col("packed"))).alias("strict"), F.md5(codec.loose_text(F.col("packed"))).alias("loose"), F.md5(codec.prompt_page(F.col("packed"))).alias("prompt"), codec.mongo_page(nested).alias("mongo"))


@query("codec_loose_kinds", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN html WHEN 2 THEN 'plain text?' ELSE 'short' END AS text FROM pages")
def codec_loose_kinds(spark, sf_dir):
    i = F.col("page_id") % 4
    raw = F.when(i == 0, "  ").when(i == 1, F.col("html")).when(i == 2, "plain text?").otherwise(F.base64(F.lit("short").cast("binary")))
    return read(spark, sf_dir, "pages").select("page_id", codec.loose_text(raw).alias("text"))


@query("codec_encode_or_keep", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN 'kept' ELSE '' END AS page FROM pages")
def codec_encode_or_keep(spark, sf_dir):
    i = F.col("page_id") % 3
    record = F.when(i == 0, F.to_json(F.struct("html"))).when(i == 1, F.lit('{"compressed_html": "kept"}')).otherwise("{}")
    made = read(spark, sf_dir, "pages").select("page_id", i.alias("i"), codec.encode_or_keep(record).alias("made"))
    return made.select("page_id", F.when(F.col("i") == 0, codec.page_text(F.col("made"))).otherwise(F.col("made")).alias("page"))


@query("export_flattened", "SELECT url, 'c' || (page_id % 5) AS category, md5(html) AS page FROM pages")
def export_flattened(spark, sf_dir):
    binary = F.struct(F.struct(codec.compressed(F.col("html")).alias("base64")).alias("$binary")).alias("compressed_html")
    export = read(spark, sf_dir, "pages").select(F.col("url").alias("domain_name"), F.concat(F.lit("c"), F.col("page_id") % 5).alias("category"), F.struct(binary).alias("html"))
    return io.flattened_export(export).select("url", "category", F.md5(codec.page_text(F.col("compressed_html"))).alias("page"))


@query("entities_all", "SELECT page_id, 'é <b> & ' || page_id AS text FROM pages")
def entities_all(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", codec.unescaped(F.concat(F.lit("&eacute; &lt;b&gt; &amp; "), F.col("page_id"))).alias("text"))


@query("jsonl_good_lines", "SELECT doc_id, source FROM documents WHERE doc_id % 10 <> 3")
def jsonl_good_lines(spark, sf_dir):
    """Lines of which some are cut off."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    line = F.to_json(F.struct("doc_id", "source"))
    return io.json_lines_of(d.select(F.when(F.col("doc_id") % 10 == 3, F.substring(line, 1, 9)).otherwise(line).alias("line")), "line", "doc_id long, source string")


def scratch(spark: SparkSession) -> str:
    """A folder of its own below the shared one that the session names for checkpoints."""
    context = spark.sparkContext
    shared = context._jsc.sc().getCheckpointDir()
    top = shared.get() if shared.isDefined() else spark.conf.get("spark.checkpoint.dir")
    return f"{top}/files-{uuid.uuid4().hex}"


@query("jsonl_round_trip", "SELECT doc_id, md5(text) AS text, lang FROM documents")
def jsonl_round_trip(spark, sf_dir):
    path = scratch(spark)
    io.write_jsonl(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return io.jsonl(spark, path, "doc_id long, text string, lang string").select("doc_id", F.md5("text").alias("text"), "lang")


@query("jsonl_append_twice", "SELECT doc_id, 2::BIGINT AS n FROM labels")
def jsonl_append_twice(spark, sf_dir):
    path, d = scratch(spark), read(spark, sf_dir, "labels").select("doc_id")
    for _ in range(2):
        io.write_jsonl(d, path, append=True)
    return io.jsonl(spark, path, "doc_id long").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("jsonl_numbered", "SELECT n AS line_no, doc_id FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS n, doc_id FROM labels) WHERE n < 100")
def jsonl_numbered(spark, sf_dir):
    """Line numbers of one file, the first hundred lines."""
    path = scratch(spark)
    read(spark, sf_dir, "labels").select("doc_id").orderBy("doc_id").coalesce(1).write.json(path)
    return io.numbered_jsonl(spark, path, "doc_id long", 100).select("line_no", "doc_id")


@query("json_array_elements", "SELECT doc_id, quality FROM labels")
def json_array_elements(spark, sf_dir):
    path = scratch(spark)
    row = F.to_json(F.struct("doc_id", "quality"))
    body = read(spark, sf_dir, "labels").select(F.concat(F.lit("  "), row, F.lit(",")).alias("value"))
    body.write.text(path)
    return io.json_array_lines(spark, path, "doc_id long, quality int")


@query("url_list_distinct", "SELECT DISTINCT CASE WHEN regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN lower(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', ''), '/+$', '')) END AS url FROM pages")
def url_list_distinct(spark, sf_dir):
    path = f"{scratch(spark)}.parquet"
    io.write_parquet(read(spark, sf_dir, "pages").select("url").unionByName(read(spark, sf_dir, "pages").select("url")), path)
    return io.url_list(spark, path)


@query("label_lines_written", "SELECT '__label__' || regexp_replace(source, '[^0-9A-Za-z]+', '_', 'g') || ' ' || trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g'), '[\\s\\x{A0}]+', ' ', 'g')) AS value, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND text IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def label_lines_written(spark, sf_dir):
    path = scratch(spark)
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").where("text is not null and source is not null")
    io.write_label_lines(d, "source", "text", path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


@query("doc_labelled_semi", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def doc_labelled_semi(spark, sf_dir):
    return curate.semi(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


@query("doc_new_keys", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def doc_new_keys(spark, sf_dir):
    return curate.difference(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")


KNOWN = ["c0", "c1", "c2", "c3"]


@query("labels_known_only", f"SELECT line_no, array_to_string(list_filter({SQL_LIST}, lambda x: x IN {tuple(KNOWN)}), ',') AS labels FROM ({NOTES}) WHERE len(list_filter({SQL_LIST}, lambda x: x IN {tuple(KNOWN)})) > 0")
def labels_known_only(spark, sf_dir):
    kept = curate.classified(curate.checked_labels(notes(spark, sf_dir), "categories", KNOWN), "categories")
    return kept.select("line_no", F.array_join("categories", ",").alias("labels"))


@query("first_rows_in_order", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def first_rows_in_order(spark, sf_dir):
    return curate.head(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 25)


@query("stratified_head", "SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3")
def stratified_head(spark, sf_dir):
    out = curate.stratified_head(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), "doc_id"], 3)
    return out.select("source", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("vectors_aligned", "SELECT doc_id, CASE WHEN e.vec_id IS NULL THEN 0.0 ELSE round(embedding[1]::DOUBLE, 6) END AS first FROM documents LEFT JOIN embeddings e ON doc_id = vec_id")
def vectors_aligned(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    out = curate.aligned(read(spark, sf_dir, "documents").select("doc_id"), e, "doc_id", "embedding", 64, most_missing=1.0)
    return out.select("doc_id", F.round(F.element_at("vec", 1).cast("double"), 6).alias("first"))


SQL_SETS = "SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN doc_id % 97 = 0 THEN 'rare' END], lambda x: x IS NOT NULL) AS labels FROM labels"


@query("split_multilabel", f"""
WITH s AS ({SQL_SETS}), u AS (SELECT doc_id, unnest(labels) AS label FROM s), c AS (SELECT label, count(*) AS c FROM u GROUP BY label),
r AS (SELECT doc_id, label AS stratum FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY c, label) AS r FROM u JOIN c USING (label)) WHERE r = 1),
p AS (SELECT s.doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || s.doc_id), s.doc_id) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM s LEFT JOIN r USING (doc_id))
SELECT doc_id, stratum, CASE WHEN CASE WHEN n < 2 OR stratum IS NULL THEN ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 100 < 15 ELSE r <= ceil(n * 15 / 100) END THEN 'valid' ELSE 'train' END AS split FROM p""")
def split_multilabel(spark, sf_dir):
    from pagelens.plans.document_queries import label_lists

    return sampling.multilabel_split(label_lists(spark, sf_dir), "labels", "doc_id").select("doc_id", "stratum", "split")


@query("split_folds", "SELECT doc_id, ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT % 3 AS fold FROM documents")
def split_folds(spark, sf_dir):
    return sampling.folds(read(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", F.col("fold").cast("long").alias("fold"))


def _found(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return languages.detected(d, "doc_id", F.col("text"), languages.frequent_word_detector)


SQL_FOUND = "WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\s\\x{A0}]+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, " + ", ".join(f"len(list_filter(w, lambda x: x IN {some})) AS n_{lang}" for lang, some in text.FREQUENT.items()) + " FROM w)"
SQL_TOTAL = " + ".join(f"n_{lang}" for lang in text.FREQUENT)


@query("doc_lang_detected", f"{SQL_FOUND} SELECT doc_id, coalesce(n_de > 0.5 * ({SQL_TOTAL}), false) AND n_de > 0 AS mostly_de, n_en > 0 AND n_en >= 0.75 * ({SQL_TOTAL}) AS surely_en FROM c")
def doc_lang_detected(spark, sf_dir):
    return _found(spark, sf_dir).select("doc_id", languages.first_is(F.col("found"), "de").alias("mostly_de"), languages.any_is(F.col("found"), "en").alias("surely_en"))


@query("page_language_tag", r"""
SELECT page_id, CASE WHEN regexp_matches(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?#:]*)', 1), '\.cz$') THEN 'cs'
  WHEN length(regexp_replace(html, '[^\p{L}]', '', 'g')) < 200 THEN CASE WHEN contains(url, '.cz') THEN 'cs' ELSE 'en' END
  WHEN length(regexp_replace(lower(html), '[^ěščřžýáíéúůďťň]', '', 'g')) / greatest(length(regexp_replace(html, '[^\p{L}]', '', 'g')), 1) > 0.004 THEN 'cs' ELSE 'en' END AS lang
FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'https://www.a.cz/x' ELSE url END AS url, html FROM pages)""")
def page_language_tag(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 5 == 0, "https://www.a.cz/x").otherwise(F.col("url"))
    return p.select("page_id", text.language_tag(url, F.col("html")).alias("lang"))


#: Bytes of text in a file that a stream reads.
FILE_BYTES = 16 << 20
SQL_PROMPT = "CASE WHEN length(text) > 900 THEN rtrim(substr(text, 1, 720)) || chr(10) || '...[TRUNCATED]...' || chr(10) || ltrim(right(text, 180)) ELSE text END"


@query("stream_classified", f"SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN NULL WHEN length({SQL_PROMPT}) % 7 = 0 THEN NULL ELSE 'n' || length({SQL_PROMPT}) END AS reply, CASE WHEN trim(coalesce(text, '')) = '' THEN 'NO_TEXT' WHEN length({SQL_PROMPT}) % 7 = 0 THEN 'FAILED' ELSE 'OK' END AS status FROM documents")
def stream_classified(spark, sf_dir):
    """A stream of files, asked of a client batch by batch; each batch is written before the next begins. The client gives up on some texts."""
    folder, d = scratch(spark), read(spark, sf_dir, "documents").select("doc_id", "text")
    # three batches, of as many files as the texts need at FILE_BYTES each
    each = max(1, -(-(d.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (3 * FILE_BYTES)))
    d.repartition(3 * each).write.parquet(f"{folder}/in")

    def client(prompt: str) -> str:
        if len(prompt) % 7 == 0:
            raise TimeoutError
        return f"n{len(prompt)}"

    def answered(batch: DataFrame) -> DataFrame:
        return incremental.classified(batch, client, "{text}", "doc_id", retry=incremental.Retry(2, 0.0), most=900)

    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", each).parquet(f"{folder}/in")
    incremental.durable(stream, answered, f"{folder}/out", f"{folder}/offsets").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", "reply", "status")


@query("crawl_by_levels", """
WITH RECURSIVE t AS (SELECT 0::BIGINT AS id, 0 AS level UNION ALL SELECT p.page_id, t.level + 1 FROM t JOIN pages p ON p.page_id IN (2 * t.id + 1, 2 * t.id + 2) WHERE p.page_id % 10 <> 9 AND p.page_id % 23 <> 22 AND t.level < 5)
SELECT 'http://d' || id || '.org/' AS url, level FROM t""")
def crawl_by_levels(spark, sf_dir):
    """Pages linked as a tree, a domain each; some domains are listed as bad, some pages are not accepted."""
    i = F.col("page_id")
    name = lambda c: F.concat(F.lit("http://d"), c, F.lit(".org/"))
    pages = read(spark, sf_dir, "pages").select("page_id")
    links = pages.where("page_id > 0").select(name(F.floor((i - 1) / 2)).alias("url"), name(i).alias("link"))
    bad = pages.where("page_id % 23 = 22").select(urls.registrable_domain(name(i)).alias("domain"))
    accept = lambda df: df.where(F.regexp_extract("url", "([0-9]+)", 1).cast("long") % 10 != 9)
    starts = spark.createDataFrame([("http://d0.org/",)], "url string")
    return incremental.crawl(links, starts, urls.registrable_domain, bad, accept, 6, 1 << 30).withColumn("level", F.col("level").cast("long"))
