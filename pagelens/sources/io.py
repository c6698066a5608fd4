"""Scans and sinks. Schemas are explicit; malformed lines are kept aside, not silently dropped."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.sources import codec

#: ``categories`` is text, as it comes as a list, as JSON text or as divided text.
TRAINING = "url string, categories string, compressed_html string, html string, label string"
SCRAPE = "url string, status_code int, content string, success boolean"


def jsonl(spark: SparkSession, paths: str | list[str], schema: str, keep_bad: bool = False) -> DataFrame:
    """JSON lines with ``file`` they came from; blank lines are skipped, bad ones dropped or kept in ``bad``."""
    text = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    rows = text.withColumn("row", F.from_json("value", f"{schema}, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})).select("row.*", "file")
    return rows if keep_bad else rows.where("bad is null").drop("bad")


def numbered_lines(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """``line_no, value`` of a text file, blank lines included, numbered from 0; the first ``most`` lines if asked.

    Lines are numbered within their part of the file and moved up by the lines of the parts before, which are
    counted first; a part is a stretch of the file's bytes, so its order is that of the file.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"))
    counts = raw.groupBy("at").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    before = counts.select("at", "first", (F.sum("n").over(Window.orderBy("at")) - F.col("n")).alias("before"))  # a row for each part
    out = raw.join(before, "at").select((F.col("i") - F.col("first") + F.col("before")).alias("line_no"), "value")
    return out if most is None else out.where(F.col("line_no") < most)


def numbered_jsonl(spark: SparkSession, path: str, schema: str, most: int | None = None) -> DataFrame:
    """JSON lines with their line number, ``most`` counting bad and blank lines too; these are skipped then."""
    rows = numbered_lines(spark, path, most).withColumn("row", F.from_json("value", f"{schema}, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}))
    return rows.where((F.trim("value") != "") & F.col("row.bad").isNull()).select("line_no", "row.*").drop("bad")


def folder(spark: SparkSession, path: str, schema: str, glob: str = "*.jsonl", first: list[str] | None = None) -> DataFrame:
    """JSON lines of explicit files, in their order, then of a folder's files that match, by name, with ``file_rank``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path").distinct()
    named = [(f, i) for i, f in enumerate(first or [])]
    listed = [f for f, _ in named] + [r["path"] for r in found.orderBy("path").collect()]
    parts = [jsonl(spark, f, schema).withColumn("file_rank", F.lit(i)) for i, f in enumerate(dict.fromkeys(listed))]
    if not parts:
        raise ValueError(f"no {glob} in {path}")
    return reduce(lambda a, b: a.unionByName(b), parts)


def json_lines_of(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The same over lines that a column already holds."""
    parsed = df.withColumn("row", F.from_json(column, f"{schema}, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}))
    return parsed.where("row.bad is null").select("row.*").drop("bad")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array. Many such files are read in parallel, each by one task."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_array_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same of a large file that has an element a line, as exports do: lines are split among tasks, brackets and commas around elements go."""
    element = F.regexp_replace(F.trim("value"), r"^\[\s*|\s*[,\]]+$", "")
    rows = spark.read.text(path).select(element.alias("element")).where(F.col("element").rlike(r"^\{"))
    return json_lines_of(rows, "element", schema)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages by suffix: .jsonl, .json, .csv or .parquet; others raise."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("jsonl", "json"):
        return jsonl(spark, path, TRAINING)
    if suffix == "csv":
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown kind of file: {path}")


def labelled(df: DataFrame) -> DataFrame:
    """``html, labels`` of either input schema: html and label, or compressed_html and categories."""
    if {"html", "label"} <= set(df.columns) and "compressed_html" not in df.columns:
        return df.select("*", F.array("label").alias("labels")).dropna(subset=["html", "label"])
    if {"compressed_html", "categories"} <= set(df.columns):
        return df.withColumn("html", codec.page_text(F.col("compressed_html"))).dropna(subset=["html", "categories"])
    raise ValueError("neither html and label nor compressed_html and categories are there")


def url_list(spark: SparkSession, path: str, column: str = "url", limit: int | None = None, seed: int | None = None) -> DataFrame:
    """Distinct urls of a Parquet file or a CSV with a header, with a scheme, shuffled by ``seed`` before a limit."""
    rows = spark.read.parquet(path) if path.rstrip("/").lower().endswith(".parquet") else spark.read.option("header", True).csv(path)
    if column not in rows.columns:
        raise ValueError(f"no column {column}")
    out = rows.where(F.trim(column) != "").select(urls.with_scheme(F.col(column), lower=True).alias("url")).distinct()
    if seed is not None:
        out = out.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "url")))
    return out if limit is None else out.limit(limit)


def table(spark: SparkSession, url: str, name: str, fetch: int = 10_000, **options: str) -> DataFrame:
    """A table of a database over JDBC, fetched in portions; ``partitionColumn`` and its bounds split it."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, fetchsize=str(fetch), **options).load()


def append_table(df: DataFrame, url: str, name: str, batch: int = 1000, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=name, batchsize=str(batch), **options).mode("append").save()


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a text file, such as words or one page a line."""
    return spark.read.text(path).where(F.trim("value") != "")


def sample_file(spark: SparkSession, path: str) -> DataFrame:
    """``url, label, html`` of a file of blocks: a line of url and ``['label']``, then the page."""
    text = spark.read.text(path, wholetext=True)
    parts = text.select(F.explode(F.split("value", r"(?m)(?=^https?://\S+ \['[^']*'\]$)")).alias("part")).where(F.trim("part") != "")
    head = r"^(https?://\S+) \['([^']*)'\]\n?"
    return parts.select(F.regexp_extract("part", head, 1).alias("url"), F.regexp_extract("part", head, 2).alias("label"), F.regexp_replace("part", head, "").alias("html"))


def fetched(df: DataFrame, fetch: Callable[[str], tuple[int, str]], parallel: int | None = None) -> DataFrame:
    """``url, status_code, content, success, error`` by a client that the caller brings; a failure is a row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for url in part["url"]:
                try:
                    status, content = fetch(url)
                    ok = 200 <= status < 300 and bool(content.strip())
                    out.append((url, status, content if ok else None, ok, None))
                except Exception as e:  # any failure of the client is data here
                    out.append((url, None, None, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["url", "status_code", "content", "success", "error"])

    rows = df.select("url")
    return (rows.repartition(parallel) if parallel else rows).mapInPandas(run, f"{SCRAPE}, error string")


def crawl_list(df: DataFrame, fetch: Callable[[str], tuple[int, str]], path: str, batch: int = 25, parallel: int | None = None) -> DataFrame:
    """Fetch what ``path`` does not hold yet, a batch after the other, each written before the next; the visited set is ``path`` itself.

    A run that breaks off goes on where it stopped. Urls are fetched once, failures included.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    left = df.select("url").distinct()
    if there:
        left = left.join(spark.read.parquet(path).select("url").distinct(), "url", "left_anti")
    parts = max(1, -(-left.count() // batch))
    dealt = left.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(parts)))
    for i in range(parts):
        fetched(dealt.where(F.col("part") == i).drop("part"), fetch, parallel).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False, order: str | None = None) -> None:
    """JSON lines; null keys are written too. With ``order`` the files follow each other in the order of that column."""
    (df if order is None else df.orderBy(order)).write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Parquet; an empty frame keeps its columns."""
    df.write.mode("overwrite").parquet(path)


def write_label_lines(df: DataFrame, label: str, text: str, path: str) -> None:
    """``__label__x text`` lines."""
    from pagelens.functions import text as t

    df.select(F.concat_ws(" ", t.safe_label(F.col(label)), t.normalize(F.col(text))).alias("value")).write.mode("overwrite").text(path)


def page_file(spark: SparkSession, path: str) -> DataFrame:
    """``path, html`` of page files; gzip and zlib are inflated, bytes decoded by their charset."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    packed = F.hex(F.substring("content", 1, 2)).isin("1F8B", "789C", "78DA", "7801")
    return raw.select("path", codec.decoded_bytes(F.when(packed, codec.inflated(F.base64("content"))).otherwise(F.col("content"))).alias("html"))


def flattened_export(df: DataFrame) -> DataFrame:
    """``url, category, compressed_html`` of a document-store export with ``domain_name`` and a nested ``html``."""
    packed = F.col("html.compressed_html.`$binary`.base64")
    return df.select(F.col("domain_name").alias("url"), "category", packed.alias("compressed_html"))


def cached(spark: SparkSession, folder: str, parts: dict[str, object], make: Callable[[], DataFrame]) -> DataFrame:
    """A Parquet cache whose name is a digest of everything that decides its content; made where it is absent."""
    key = hashlib.md5(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder}/{key}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_vectors(spark: SparkSession, path: str, model: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A cache of vectors that names its model; an error if the cache was made by another one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().withColumn("model", F.lit(model)).write.mode("overwrite").parquet(path)
    found = spark.read.parquet(path)
    other = found.where(F.col("model") != model).select("model").limit(1).collect()
    if other:
        raise ValueError(f"{path} holds vectors of {other[0]['model']}, not of {model}")
    return found.drop("model")


def markdown(report: DataFrame, most: int = 1000) -> str:
    """A small report as a Markdown table."""
    rows = report.limit(most).collect()
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(report.columns), line(["---"] * len(report.columns)), *[line(r) for r in rows]])
