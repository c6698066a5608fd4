"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of a text is addressed by its SHA-256. A (blob, rule, rule version) is scanned once: the
ledger holds the pairs that were scanned, findings hold the spans, and a join on the blob brings them
back to all documents that carry it. Copies, however many, are reduced to one row per map task before
they are shuffled, and a blob is shuffled once.

:func:`ledgered` keeps ledger and findings in a folder from one run to the next; the query scans a table that
has no history, so it starts from an empty ledger and keeps none.

Spans are [start, end) in code points. Null and empty texts are the same empty blob, which has no
findings. Rows with the same id get the same answer each. The base rules are ``BASE``; ``EXTRA`` adds
kinds and never takes a base span away.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import common


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts (0: the whole match), its least length, a cheap test."""

    kind: str
    pattern: str
    least: int
    version: int = 1
    group: int = 0
    hint: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, group=1, hint=r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    # the next two match maximal runs, so a least length in the pattern drops just the runs that fail
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, hint="PRIVATE KEY-----"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 1),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 1),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 1),
)
RULES = BASE + EXTRA
SALTS = 16
FINDINGS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches as structs of start, rank, kind and end.

    The gaps that ``split`` leaves and the matches between them give every position by running sums.
    """
    gaps, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    long_enough = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    triples = F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: F.struct(F.length(F.element_at(gaps, i)).alias("g"), F.length(F.element_at(found, i)).alias("m"), F.length(F.element_at(long_enough, i)).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(FINDINGS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        one = F.array(F.struct((acc["at"] + x["g"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (acc["at"] + x["g"] + x["m"]).alias("end"))).cast(FINDINGS)
        return F.struct((acc["at"] + x["g"] + x["m"]).alias("at"), F.when(x["n"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(triples, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(FINDINGS))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, text)`` to ``(blob, findings)``: the sorted spans of all rules, for the blobs that have any."""
    some = F.col("text").rlike("|".join(f"(?:{r.hint or r.pattern})" for r in rules))
    each = [F.when(F.col("text").rlike(r.hint or r.pattern), spans(F.col("text"), r, i)).otherwise(F.array().cast(FINDINGS)) for i, r in enumerate(rules)]
    return blobs.where(some).select("blob", F.array_sort(F.concat(*each)).alias("findings")).where(F.size("findings") > 0)


def addressed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(path, blob, text)``: each document's id and its content address."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("path"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))


def distinct_blobs(versions: DataFrame) -> DataFrame:
    """One row for each blob; each map task reduces its own copies before any text is shuffled."""
    return versions.select("blob", "text").dropDuplicates(["blob"])


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> list[tuple[tuple[Rule, ...], DataFrame]]:
    """The blobs that each rule has not read yet, by the rules that they share."""
    if ledger is None:
        return [(rules, blobs)]
    wanted = F.array(*[F.lit(r.key) for r in rules])
    done = ledger.where(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.array_sort(F.collect_set("rule")).alias("done"))
    left = blobs.join(done, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))).drop("done")
    return [((r,), left.where(F.array_contains("todo", r.key)).drop("todo")) for r in rules]


def incremental(docs: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan what the ledger has not seen.

    Returns ``(paths, ledger, findings)``: every document with the findings of its blob, the rows
    ``(blob, rule)`` to append to the ledger, and the rows ``(blob, findings)`` to append to the
    findings. A second run with both appended scans nothing; a new rule version scans old blobs with
    that rule alone.
    """
    versions = addressed(docs, id_col, text_col)
    blobs = distinct_blobs(versions)
    work = unseen(blobs, ledger, rules)
    fresh = None
    for some, rows in work:
        one = scan(rows, some)
        if len(some) < len(rules):
            rank = rules.index(some[0])
            one = one.withColumn("findings", F.transform("findings", lambda x: x.withField("rank", F.lit(rank))))
        fresh = one if fresh is None else fresh.unionByName(one)
    seen = None
    for some, rows in work:
        one = rows.select("blob", F.explode(F.array(*[F.lit(r.key) for r in some])).alias("rule"))
        seen = one if seen is None else seen.unionByName(one)
    every = fresh if findings is None else fresh.unionByName(findings)
    if findings is not None or len(work) > 1:
        every = every.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("findings"))
    paths = with_findings(versions.drop("text"), every, F.col("path"))
    return paths.select("path", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings")), seen, fresh


def ledgered(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(path, blob, findings)`` of every document, by a ledger and findings that live in ``folder``, a path that all executors share.

    What the ledger lacks is scanned and appended; findings are written first, so a run that breaks off
    between the two scans its blobs again and nothing is lost.
    """
    spark = docs.sparkSession

    def held(name: str) -> DataFrame | None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return common.checkpointed(spark.read.parquet(f"{folder}/{name}")) if there else None

    paths, seen, fresh = incremental(docs, held("ledger"), held("findings"), rules, id_col, text_col)
    paths, seen, fresh = (common.checkpointed(df) for df in (paths, seen, fresh))
    fresh.write.mode("append").parquet(f"{folder}/findings")
    seen.write.mode("append").parquet(f"{folder}/ledger")
    return paths


def with_findings(rows: DataFrame, found: DataFrame, spread: Column) -> DataFrame:
    """``rows`` with the findings of their blob. A blob that many rows carry is dealt over ``SALTS`` keys, which
    adaptive execution splits further where they are skewed; its findings, one short row, are repeated for each."""
    salted = found.select("blob", "findings", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_"))
    return rows.withColumn("salt_", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, ["blob", "salt_"], "left").drop("salt_")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, _, _ = incremental(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in BASE]

    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")

    return paths.select(
        F.col("path").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(shown(F.filter("findings", lambda x: x["kind"].isin(kinds))), 256).alias("base_sha256"),
        shown(F.col("findings")).alias("spans"),
    )


def _sql(rules: list[tuple[str, str, int, int]], n_base: int) -> str:
    """The query over ``documents`` in SQL: of each kind the pattern's matches, placed by the gaps between them."""
    quoted = lambda x: x.replace("'", "''")
    parts = [
        f"""SELECT doc_id, {i} AS rank, '{kind}' AS kind, gaps, found, longs, unnest(range(1, len(found) + 1)) AS k, {least} AS least
FROM (SELECT doc_id, string_split_regex(t, '{quoted(p)}') AS gaps, regexp_extract_all(t, '{quoted(p)}', 0) AS found, regexp_extract_all(t, '{quoted(p)}', {group}) AS longs FROM d)"""
        for i, (kind, p, group, least) in enumerate(rules)
    ]
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in rules[:n_base])
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
p AS (SELECT doc_id, rank, kind, length(found[k]) AS size,
    (list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM m WHERE length(longs[k]) >= least),
s AS (SELECT *, kind || ':' || start || ':' || (start + size) AS shown FROM p),
g AS (SELECT doc_id, {counts}, string_agg(shown, ',' ORDER BY start, rank) FILTER (rank < {n_base}) AS base, string_agg(shown, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in rules[:n_base])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


#: The base rules as the contract words them, and the extra ones.
OP8_SQL = _sql(
    [("assign", BASE[0].pattern, BASE[0].group, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)] + [(r.kind, r.pattern, r.group, r.least) for r in EXTRA],
    len(BASE),
)


def redact(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each found span of its text replaced by ``mark``; overlapping spans become one. Null texts stay null."""
    text = F.col("text_")
    merged = F.aggregate(
        "findings",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    found = findings.where(F.size("findings") > 0).select("blob", "findings").dropDuplicates(["blob"])
    rest, unpack = common.carried(docs, text_col, ())
    keyed = rest.withColumn("blob", F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))
    spread = F.col("rest_").getField(id_col)
    done = with_findings(keyed, found, spread).withColumn("text_", F.when(F.size("findings") > 0, merged).otherwise(text))
    return done.select(*unpack)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, with its secrets masked and ``n_chars`` brought up to date."""
    done = redact(docs, scan(distinct_blobs(addressed(docs))))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
