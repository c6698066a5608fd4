"""Micro-batches, retries, crawl levels and windows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.streaming import incremental


def test_retry():
    waits, calls = [], []

    def client(prompt):
        calls.append(len(prompt))
        if len(calls) == 1:
            raise incremental.Busy
        if len(prompt) > 5000:
            raise incremental.TooLong
        return "ok"

    assert incremental.ask(client, "x" * 12_000, incremental.Retry(sleep=waits.append)) == "ok"
    assert calls == [12_000, 12_000, 6000, 4000] and waits == [1.0]

    def broken(prompt):
        raise TimeoutError

    assert incremental.ask(broken, "x", incremental.Retry(attempts=2, sleep=waits.append)) is None


def test_classified(spark):
    def client(prompt):
        if "fail" in prompt:
            raise RuntimeError
        return prompt[-3:]

    df = spark.createDataFrame([("a", "text abc"), ("b", ""), ("c", None), ("d", "fail")], "url string, text string")
    got = {r["url"]: (r["reply"], r["status"]) for r in incremental.classified(df, client, "Q: {text}", retry=incremental.Retry(1, 0.0)).collect()}
    assert got == {"a": ("abc", "OK"), "b": (None, "NO_TEXT"), "c": (None, "NO_TEXT"), "d": (None, "FAILED")}


def test_durable(spark, tmp_path):
    for part in range(2):
        spark.range(part * 10, part * 10 + 10).write.mode("append").json(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        incremental.durable(stream, lambda b: b.withColumn("double", F.col("id") * 2), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 20 and got.select("id").distinct().count() == 20


def test_crawl(spark):
    links = spark.createDataFrame([("http://a.com/", "http://b.com/"), ("http://b.com/", "http://a.com/"), ("http://b.com/", "http://c.com/x"), ("http://b.com/", "http://bad.com/"), ("http://c.com/x", "http://d.com/"), ("http://d.com/", "http://e.com/")], "url string, link string")
    black = spark.createDataFrame([("bad.com",)], "domain string")
    got = incremental.crawl(links, spark.createDataFrame([("http://a.com/",)], "url string"), urls.registrable_domain, black, lambda df: df.where("domain <> 'd.com'"), 10, 100)
    assert [(r["url"], r["level"]) for r in got.orderBy("level").collect()] == [("http://a.com/", 0), ("http://b.com/", 1), ("http://c.com/x", 2)]


def test_windows(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, start), (1, start + timedelta(minutes=20)), (1, start + timedelta(minutes=70)), (2, start)], "user int, ts timestamp")
    assert sorted(r["n"] for r in incremental.sessions(df, "user", "ts", "30 minutes").collect()) == [1, 1, 2]
    assert incremental.windowed(df, "ts", "user").count() == 3 and incremental.windowed(df, "ts", "user", "1 hour", "30 minutes").count() > 3
