"""Catalogue queries over documents, labels, conversations, benchmark and the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagelens.functions import text
from pagelens.operators import curate, sampling, vectorize
from pagelens.plans.catalog import query
from pagelens.plans.url_queries import SQL_DOMAIN, read

STOP = tuple(w for some in text.FREQUENT.values() for w in some)
SQL_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP))
SHOPPING = ("the", "and", "price", "shop", "sale", "that", "buy", "with")
SQL_SHOPPING = ", ".join(f"'{w}'" for w in SHOPPING)
W1 = r"regexp_extract_all(lower(text), '\p{L}{1,}')"
W3 = r"regexp_extract_all(lower(text), '\p{L}{3,}')"
TEMPLATE = "Classify this page.\n{text}\nAnswer in JSON."


def documents(spark, sf_dir):
    return read(spark, sf_dir, "documents")


@query("doc_word_stats", f"SELECT doc_id, len({W1}) AS n_words, round(coalesce(list_sum(list_transform({W1}, lambda x: length(x))), 0) / greatest(len({W1}), 1), 6) AS avg_length, len(list_distinct({W1})) AS n_distinct FROM documents")
def doc_word_stats(spark, sf_dir):
    s = documents(spark, sf_dir).select("doc_id", text.word_stats(F.col("text")).alias("s"))
    return s.select("doc_id", F.col("s.n_words").cast("long").alias("n_words"), "s.avg_length", F.col("s.n_distinct").cast("long").alias("n_distinct"))


@query("doc_normalized", r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g'), '[\s\x{A0}]+', ' ', 'g')) AS text FROM documents")
def doc_normalized(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.normalize(F.col("text")).alias("text"))


@query("doc_scrubbed", r"""
WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://[^ \t\n]+|www\.[^ \t\n]+', ' ', 'g'), '[^ \t\n]+@[^ \t\n]+\.[^ \t\n]+', ' ', 'g'), '[0-9]{1,2}:[0-9]{2}', ' ', 'g'), '[^\p{L}\p{N} ]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, trim(regexp_replace(array_to_string(list_filter(string_split(t, ' '), lambda x: length(x) > 2), ' '), ' +', ' ', 'g')) AS text FROM s""")
def doc_scrubbed(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.scrub(F.col("text")).alias("text"))


@query("doc_content_words", f"WITH t AS (SELECT unnest(list_filter({W3}, lambda x: x NOT IN ({SQL_STOP}))) AS token, doc_id FROM documents) SELECT token, count(*) AS n, count(DISTINCT doc_id) AS df FROM t GROUP BY token HAVING count(*) >= 5")
def doc_content_words(spark, sf_dir):
    t = documents(spark, sf_dir).select("doc_id", F.explode(text.content_words(F.col("text"), STOP)).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("df")).where("n >= 5")


@query("keyword_percentage", f"SELECT doc_id, round(100.0 * len(list_filter({W1}, lambda x: x IN ({SQL_SHOPPING}))) / {len(SHOPPING)}, 6) AS of_keywords, round(100.0 * len(list_filter({W1}, lambda x: x IN ({SQL_SHOPPING}))) / greatest(len({W1}), 1), 6) AS of_words FROM documents")
def keyword_percentage(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.round(text.keyword_share(t, SHOPPING), 6).alias("of_keywords"), F.round(text.keyword_share(t, SHOPPING, False), 6).alias("of_words"))


VOTES = [f"{{'n': len(list_filter({W1}, lambda x: x IN ({', '.join(repr(w) for w in words)}))), 'lang': '{lang}'}}" for lang, words in sorted(text.FREQUENT.items(), reverse=True)]


@query("doc_lang_vote", f"WITH v AS (SELECT doc_id, lang, list_max([{', '.join(VOTES)}]) AS best FROM documents) SELECT lang, CASE WHEN best.n > 0 THEN best.lang END AS voted, count(*) AS n FROM v GROUP BY ALL")
def doc_lang_vote(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("lang", text.language_vote(F.col("text")).alias("voted")).agg(F.count("*").alias("n"))


@query("doc_lang_letters", "SELECT doc_id, " + ", ".join(f"round(len(regexp_extract_all(lower(text), '[{letters}]')) / greatest(len(regexp_extract_all(text, '\\p{{L}}')), 1), 6) AS {lang}_share" for lang, letters in text.LETTERS.items()) + " FROM documents")
def doc_lang_letters(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *[F.round(text.letter_share(F.col("text"), letters), 6).alias(f"{lang}_share") for lang, letters in text.LETTERS.items()])


@query("doc_lang_filter", "SELECT doc_id, lang FROM documents WHERE lang = 'de' AND length(text) >= 50")
def doc_lang_filter(spark, sf_dir):
    return documents(spark, sf_dir).where((F.col("lang") == "de") & (F.length("text") >= 50)).select("doc_id", "lang")


@query("doc_skip_reasons", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL THEN 'missing' WHEN trim(text) = '' THEN 'empty' WHEN length(text) < 180 THEN 'short' ELSE 'ok' END AS reason FROM documents) GROUP BY reason")
def doc_skip_reasons(spark, sf_dir):
    return curate.reasons(documents(spark, sf_dir), "text", 180).groupBy("reason").agg(F.count("*").alias("n"))


@query("doc_min_length_filter", "SELECT doc_id, n_chars FROM documents WHERE length(text) >= 180")
def doc_min_length_filter(spark, sf_dir):
    return documents(spark, sf_dir).where(F.length("text") >= 180).select("doc_id", "n_chars")


@query("doc_dedup_exact", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def doc_dedup_exact(spark, sf_dir):
    # texts are grouped by a digest, so that they themselves are not shuffled
    return documents(spark, sf_dir).groupBy(F.sha2(F.col("text"), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("doc_dedup_composite", "SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(source, ''), coalesce(lang, ''), n_chars // 500 ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def doc_dedup_composite(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "source", "lang", F.floor(F.col("n_chars") / 500).alias("size"))
    return curate.dedup_composite(d, ["source", "lang", "size"], ["doc_id"]).select("doc_id", "source", "lang")


@query("doc_repeated_lines", r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
SELECT doc_id, array_to_string(list_filter(lines, lambda x: len(list_filter(lines, lambda y: y = x)) <= 3), chr(10)) AS text FROM l""")
def doc_repeated_lines(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.without_repeated_lines(F.col("text")).alias("text"))


@query("doc_stratified_sample", "SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 10")
def doc_stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(documents(spark, sf_dir).select("source", "doc_id"), "source", "doc_id", 10).select("source", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("doc_seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('3:' || doc_id), doc_id LIMIT 50")
def doc_seeded_sample(spark, sf_dir):
    return sampling.sample_rows(documents(spark, sf_dir).select("doc_id"), "doc_id", 50, 3)


@query("doc_label_join_filter", "SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND l.toxic = 0")
def doc_label_join_filter(spark, sf_dir):
    good = read(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return documents(spark, sf_dir).select("doc_id", "source").join(good, "doc_id").select("doc_id", "source", "quality", "toxic")


@query("doc_unlabelled_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def doc_unlabelled_anti(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")


LABELS = "SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN doc_id % 97 = 0 THEN 'rare' END], lambda x: x IS NOT NULL) AS labels FROM labels"


def label_lists(spark, sf_dir):
    made = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("doc_id") % 97 == 0, "rare")))
    return read(spark, sf_dir, "labels").select("doc_id", made.alias("labels"))


@query("label_universe", f"WITH l AS ({LABELS}), u AS (SELECT unnest(list_distinct(labels)) AS label FROM l) SELECT label, count(*) AS n FROM u GROUP BY label")
def label_universe(spark, sf_dir):
    return curate.label_counts(label_lists(spark, sf_dir), "labels")


@query("rare_label_prune", f"WITH l AS ({LABELS}), u AS (SELECT unnest(labels) AS label FROM l), k AS (SELECT label FROM u GROUP BY label HAVING count(*) >= 10), p AS (SELECT doc_id, list_sort(list_filter(labels, lambda x: x IN (SELECT label FROM k))) AS labels FROM l) SELECT doc_id, array_to_string(labels, ',') AS labels FROM p WHERE len(labels) > 0".replace("list_filter(labels, lambda x: x IN (SELECT label FROM k))", "list_intersect(labels, (SELECT list(label) FROM k))"))
def rare_label_prune(spark, sf_dir):
    return curate.prune_rare(label_lists(spark, sf_dir), "labels", 10).select("doc_id", F.array_join(F.sort_array("labels"), ",").alias("labels"))


@query("label_parse", """
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(raw, '[,;|]'), lambda x: lower(trim(x))), lambda x: x <> ''))), ',') AS labels
FROM (SELECT doc_id, coalesce(upper(lang), '') || '; ' || coalesce(source, '') || ' |' || coalesce(lang, '') || ',' AS raw FROM documents)""")
def label_parse(spark, sf_dir):
    raw = F.concat(F.coalesce(F.upper("lang"), F.lit("")), F.lit("; "), F.coalesce("source", F.lit("")), F.lit(" |"), F.coalesce("lang", F.lit("")), F.lit(","))
    return documents(spark, sf_dir).select("doc_id", F.array_join(text.parse_labels(raw), ",").alias("labels"))


@query("label_binarized", f"WITH l AS ({LABELS}), c AS (SELECT unnest(['good', 'rare', 'toxic']) AS label) SELECT doc_id, label, CASE WHEN list_contains(labels, label) THEN 1 ELSE 0 END AS y FROM l, c")
def label_binarized(spark, sf_dir):
    from pagelens.operators import decide

    return decide.binarised(label_lists(spark, sf_dir), "doc_id", F.col("labels"), ["good", "rare", "toxic"])


@query("label_encoded", "SELECT source, row_number() OVER (ORDER BY source) - 1 AS code FROM (SELECT DISTINCT source FROM documents)")
def label_encoded(spark, sf_dir):
    from pagelens.operators import decide

    return decide.encoded(documents(spark, sf_dir), "source").select("source", F.col("code").cast("long").alias("code"))


@query("split_stratified", "SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= ceil(count(*) OVER (PARTITION BY lang) * 15 / 100) THEN 'valid' ELSE 'train' END AS split FROM documents")
def split_stratified(spark, sf_dir):
    return sampling.stratified_split(documents(spark, sf_dir).select("doc_id", "lang"), F.col("lang"), "doc_id").select("doc_id", "lang", "split")


@query("split_by_domain", f"""
WITH p AS (SELECT page_id, {SQL_DOMAIN} AS domain FROM pages), g AS (SELECT domain, row_number() OVER (ORDER BY md5('0:' || domain), domain) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT domain FROM p))
SELECT page_id, domain, CASE WHEN r * 100 < n * 70 THEN 'train' WHEN r * 100 < n * 85 THEN 'valid' ELSE 'test' END AS split FROM p JOIN g USING (domain)""")
def split_by_domain(spark, sf_dir):
    from pagelens.functions import urls

    pages = read(spark, sf_dir, "pages").select("page_id", urls.registrable_domain(F.col("url")).alias("domain"))
    return sampling.group_split(pages, "domain").select("page_id", "domain", "split")


@query("split_cross_lingual", """
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents WHERE lang = 'en')
SELECT doc_id, CASE WHEN r <= greatest(200, floor(n * 15 / 100)) THEN 'valid' ELSE 'train' END AS split FROM o UNION ALL SELECT doc_id, 'test' FROM documents WHERE lang = 'de'""")
def split_cross_lingual(spark, sf_dir):
    return sampling.cross_split(documents(spark, sf_dir).select("doc_id", "lang"), "lang", "en", "de", "doc_id").select("doc_id", "split")


@query("split_half", "SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) > count(*) OVER () // 2 AS half FROM documents")
def split_half(spark, sf_dir):
    return sampling.half(documents(spark, sf_dir).select("doc_id"), "doc_id")


@query("minmax_scaled", "WITH s AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) SELECT doc_id, round(CASE WHEN hi > lo THEN (n_chars - lo) / (hi - lo) ELSE 0 END, 9) AS scaled FROM documents, s")
def minmax_scaled(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", F.col("n_chars").cast("double").alias("scaled"))
    return vectorize.minmax(d, ["scaled"]).select("doc_id", F.round("scaled", 9).alias("scaled"))


@query("signed_log_zscore", "WITH x AS (SELECT doc_id, ln(1 + n_chars) AS v FROM documents), s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM x) SELECT doc_id, round(0.5 * greatest(-8, least(8, (v - m) / CASE WHEN s < 1e-6 THEN 1 ELSE s END)), 6) AS z FROM x, s")
def signed_log_zscore(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", F.col("n_chars").cast("double").alias("z"))
    return vectorize.standardised(d, ["z"], 0.5).select("doc_id", F.round("z", 6).alias("z"))


@query("tfidf_top_terms", f"""
WITH c AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({W3}) AS token FROM documents) GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
d AS (SELECT token, count(*) AS df FROM c GROUP BY token HAVING count(*) >= 3), v AS (SELECT doc_id, token, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS value FROM c JOIN d USING (token), n),
u AS (SELECT doc_id, token, value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS value FROM v)
SELECT doc_id, token, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(value, 6) DESC, token) AS r FROM u) WHERE r <= 3""")
def tfidf_top_terms(spark, sf_dir):
    made = vectorize.fitted(documents(spark, sf_dir), "doc_id", text.words(F.col("text")), list, 3, 1.0, None, 1 << 30, top=3)
    out = made.withColumn("value", F.round("value", 6))
    w = Window.partitionBy("doc_id").orderBy(F.desc("value"), "token")
    return out.withColumn("r", F.row_number().over(w)).where("r <= 3").select("doc_id", "token", "value")


@query("char_ngram_df", r"""
WITH w AS (SELECT doc_id, ' ' || unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) || ' ' AS w FROM documents),
g AS (SELECT doc_id, substr(w, i, 3) AS gram FROM (SELECT doc_id, w, unnest(range(1, length(w) - 1)) AS i FROM w WHERE length(w) >= 3))
SELECT gram, count(DISTINCT doc_id) AS df FROM g GROUP BY gram HAVING count(DISTINCT doc_id) >= 3""")
def char_ngram_df(spark, sf_dir):
    grams = documents(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(vectorize.char_ngrams(F.col("text"), 3, 3))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("df")).where("df >= 3")


@query("token_ids", f"SELECT token, ('0x' || substr(md5(token), 1, 15))::BIGINT AS token_id FROM (SELECT DISTINCT unnest({W3}) AS token FROM documents)")
def token_ids(spark, sf_dir):
    return documents(spark, sf_dir).select(F.explode(text.words(F.col("text"))).alias("token")).distinct().select("token", vectorize.token_id(F.col("token")).alias("token_id"))


@query("doc_text_chunks", """
SELECT doc_id, i AS chunk, CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, floor(i * ((length(text) - 1000) / 3))::INT + 1, 1000) END AS part
FROM documents, (SELECT unnest(range(0, 4)) AS i) WHERE i = 0 OR length(text) > 1000""")
def doc_text_chunks(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("chunk", "part")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "part")


@query("doc_label_lines", "SELECT doc_id, '__label__' || regexp_replace(source, '[^0-9A-Za-z]+', '_', 'g') AS label FROM documents")
def doc_label_lines(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.safe_label(F.col("source")).alias("label"))


@query("conversation_turn_prompt", "SELECT conv_id, turn, replace('Classify this page.' || chr(10) || '{text}' || chr(10) || 'Answer in JSON.', '{text}', text) AS prompt FROM conversations WHERE role = 'user'")
def conversation_turn_prompt(spark, sf_dir):
    return read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", text.prompt(TEMPLATE, F.col("text")).alias("prompt"))


@query("llm_response_parse", "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE lower(role) END AS role FROM conversations")
def llm_response_parse(spark, sf_dir):
    body = F.concat(F.lit('{"role": "'), F.col("role"), F.lit('"}'))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("Sure: "), body, F.lit(" done"))).otherwise("no answer")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.get_json_object(text.json_answer(reply), "$.role").alias("role"))


@query("source_value_counts", "SELECT source, lang, count(*) AS n, count(DISTINCT text) AS texts FROM documents GROUP BY ALL")
def source_value_counts(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"), F.countDistinct(F.sha2("text", 256)).alias("texts"))


@query("order_sample_per_priority", "SELECT o_orderpriority, o_orderkey, rank FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('0:' || o_orderkey), o_orderkey) AS rank FROM orders) WHERE rank <= 100")
def order_sample_per_priority(spark, sf_dir):
    return sampling.stratified_sample(read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", 100).select("o_orderpriority", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("segment_nation_topk", "WITH g AS (SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment) SELECT n_name, c_mktsegment, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY n DESC, c_mktsegment) AS rank FROM g) WHERE rank <= 2")
def segment_nation_topk(spark, sf_dir):
    c, n = read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment"), read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    counts = c.join(curate.small(n), c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"))
    w = Window.partitionBy("n_name").orderBy(F.desc("n"), "c_mktsegment")
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 2")


@query("supplier_region_rollup", "SELECT r_name, n_name, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def supplier_region_rollup(spark, sf_dir):
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(curate.small(n), s["s_nationkey"] == n["n_nationkey"]).join(curate.small(r), n["n_regionkey"] == r["r_regionkey"])
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("event_props_json", "SELECT event_id, event_type, json_extract_string(props, '$.' || k) AS first_value, k AS first_key FROM (SELECT *, json_keys(props)[1] AS k FROM events)")
def event_props_json(spark, sf_dir):
    key = F.element_at(F.json_object_keys("props"), 1)
    e = read(spark, sf_dir, "events").withColumn("first_key", key)
    return e.select("event_id", "event_type", F.element_at(F.from_json("props", "map<string,string>"), F.col("first_key")).alias("first_value"), "first_key")


@query("event_tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling_counts(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour")["start"].alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("event_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session""")
def event_sessions(spark, sf_dir):
    from pagelens.streaming import incremental

    return incremental.sessions(read(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")


@query("word_pair_tfidf", f"""
WITH w AS (SELECT doc_id, {W3} AS w FROM documents), t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS token FROM w),
c AS (SELECT doc_id, token, least(count(*), 32767) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT token, count(*) AS df, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1 AS idf FROM c, n GROUP BY token HAVING count(*) BETWEEN 3 AND greatest(3, floor(any_value(n) * 0.9)) ORDER BY df DESC, token LIMIT 500),
x AS (SELECT doc_id, token, (1 + ln(tf)) * idf AS value FROM c JOIN v USING (token))
SELECT doc_id, token, round(value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)), 6) AS value FROM x""")
def word_pair_tfidf(spark, sf_dir):
    return vectorize.word_tfidf(documents(spark, sf_dir), "doc_id", text.words(F.col("text")), size=500).select("doc_id", "token", F.round("value", 6).alias("value"))


@query("char_tfidf_tokens", r"""
WITH w AS (SELECT doc_id, ' ' || unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) || ' ' AS w FROM documents),
g AS (SELECT doc_id, substr(w, i, k) AS token FROM (SELECT doc_id, w, k, unnest(range(1, length(w) - k + 2)) AS i FROM w, (SELECT unnest([3, 4, 5]) AS k) WHERE length(w) >= k)),
c AS (SELECT doc_id, token, least(count(*), 32767) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT token, count(*) AS df, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1 AS idf FROM c, n GROUP BY token HAVING count(*) >= 3),
x AS (SELECT doc_id, token, (1 + ln(tf)) * idf AS value FROM c JOIN v USING (token))
SELECT doc_id, token, round(value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)), 6) AS value FROM x""")
def char_tfidf_tokens(spark, sf_dir):
    return vectorize.char_tfidf(documents(spark, sf_dir), "doc_id", F.col("text"), size=None).select("doc_id", "token", F.round("value", 6).alias("value"))


VOCABULARY = sorted(set(STOP) | set(SHOPPING))


@query("vocabulary_tfidf", f"""
WITH t AS (SELECT doc_id, unnest(list_filter({W1}, lambda x: x IN {tuple(VOCABULARY)})) AS token FROM documents), c AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT token, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1 AS idf FROM c, n GROUP BY token), x AS (SELECT doc_id, token, tf * idf AS value FROM c JOIN v USING (token))
SELECT doc_id, token, round(value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)), 6) AS value FROM x""")
def vocabulary_tfidf(spark, sf_dir):
    return vectorize.vocabulary_tfidf(documents(spark, sf_dir), "doc_id", text.words(F.col("text"), 1), VOCABULARY).select("doc_id", "token", F.round("value", 6).alias("value"))


@query("doc_prepared_words", f"WITH w AS (SELECT doc_id, list_transform({W3}, lambda x: CASE x WHEN 'thing' THEN 'item' WHEN 'ther' THEN 'the' ELSE x END) AS w FROM documents) SELECT doc_id, array_to_string(list_filter(w, lambda x: length(x) >= 3 AND x NOT IN ({SQL_STOP})), ' ') AS words FROM w")
def doc_prepared_words(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(text.prepared(F.col("text"), STOP, {"thing": "item", "ther": "the"}), " ").alias("words"))


@query("doc_scrub_english", rf"""
WITH s AS (SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[0-9]', '', 'g'), '[^\x00-\x7F]', '', 'g'), '[!-/:-@\[-`{{-~]', '', 'g')) AS t FROM documents)
SELECT doc_id, array_to_string(list_filter(string_split(t, ' '), lambda w: length(w) >= 3 AND w NOT IN ({SQL_STOP})), ' ') AS text FROM s""")
def doc_scrub_english(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.scrub_english(F.col("text"), STOP).alias("text"))


@query("doc_word_lengths", r"""
WITH s AS (SELECT doc_id, list_transform(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''), lambda w: least(length(w), 15)) AS s FROM documents)
SELECT doc_id, 'n:wordlen=' || k AS token FROM s, (SELECT unnest(range(1, 16)) AS k) WHERE len(list_filter(s, lambda x: x = k)) >= 2""")
def doc_word_lengths(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.explode(text.word_length_tokens(F.col("text"))).alias("token"))


SHAPES = (("upper", r"\p{Lu}"), ("digit", r"\p{N}"), ("punctuation", r"\p{P}"), ("space", r"\s"), ("beyond_ascii", r"[^\x00-\x7F]"))


@query("doc_shape_stats", "SELECT doc_id, " + ", ".join(f"round((length(text) - length(regexp_replace(text, '{p}', '', 'g'))) / greatest(length(text), 1), 6) AS {n}" for n, p in SHAPES) + ", len(regexp_extract_all(text, '[0-9]{4}')) AS n_years FROM documents")
def doc_shape_stats(spark, sf_dir):
    s = documents(spark, sf_dir).select("doc_id", text.shape_stats(F.col("text")).alias("s"))
    return s.select("doc_id", *[F.col(f"s.{c}").alias(c) for c, _ in SHAPES], F.col("s.n_years").cast("long").alias("n_years"))


@query("doc_currency", r"SELECT doc_id, len(regexp_extract_all(text, '[$€£]|\b(?:EUR|USD|GBP|CZK|Kč)\b')) AS n FROM documents")
def doc_currency(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.currency_mentions(F.col("text")).cast("long").alias("n"))


@query("doc_phrases_removed", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)licensed under[^.]{0,300}', ' ', 'g'), '(?i)all rights reserved', ' ', 'g'), ' +', ' ', 'g')) AS text FROM documents")
def doc_phrases_removed(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.without_phrases(F.col("text"), ("licensed under[^.]{0,300}", "all rights reserved")).alias("text"))


@query("doc_quotes_straight", "SELECT doc_id, chr(34) || source || chr(34) || ' ' || chr(39) || lang || chr(39) AS text FROM documents")
def doc_quotes_straight(spark, sf_dir):
    quoted = F.concat(F.lit("“"), "source", F.lit("” ‘"), "lang", F.lit("’"))
    return documents(spark, sf_dir).select("doc_id", text.straight_quotes(quoted).alias("text"))


@query("doc_bad_references", r"SELECT doc_id, regexp_replace('a&#38;b&#x;c&#12 ' || doc_id || '&#ab', '&#\w*[^\d;]', '', 'g') AS text FROM documents")
def doc_bad_references(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.drop_bad_references(F.concat(F.lit("a&#38;b&#x;c&#12 "), "doc_id", F.lit("&#ab"))).alias("text"))


@query("label_round_trip", "SELECT doc_id, regexp_replace(source, '[^0-9A-Za-z]+', ' ', 'g') AS label FROM documents")
def label_round_trip(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.plain_label(text.safe_label(F.col("source"))).alias("label"))


@query("label_first_known", "SELECT doc_id, CASE WHEN lang IN ('de', 'fr') THEN lang END AS label FROM documents")
def label_first_known(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.parse_label(F.concat(F.lit("none; "), F.coalesce(F.upper("lang"), F.lit("")), F.lit(" | es?")), ("de", "fr")).alias("label"))


@query("token_sets_joined", f"SELECT DISTINCT unnest([{SQL_STOP}, {SQL_SHOPPING}]) AS word")
def token_sets_joined(spark, sf_dir):
    """A stop list and a keyword list as one set; the first place of a repeated word stays."""
    both = F.array_distinct(F.array_union(F.lit(list(STOP)), F.lit(list(SHOPPING))))
    return spark.range(1).select(F.explode(both).alias("word"))
