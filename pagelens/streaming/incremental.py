"""Incremental work: durable micro-batches, retries as data, a crawl by levels, and windows over event time."""

from __future__ import annotations

import tempfile
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelens.functions import text


class TooLong(Exception):
    """The client says that its input is too long."""


class Busy(Exception):
    """The client asks to wait."""


@dataclass(frozen=True)
class Retry:
    attempts: int = 5
    first_wait: float = 1.0
    least_input: int = 4000
    sleep: Callable[[float], None] = time.sleep


def ask(client: Callable[[str], str], prompt: str, retry: Retry) -> str | None:
    """The reply, or None: waits double while busy, the input is halved while too long, other errors wait once."""
    for attempt in range(retry.attempts):
        try:
            return client(prompt)
        except Busy:
            retry.sleep(retry.first_wait * 2**attempt)
        except TooLong:
            if len(prompt) <= retry.least_input:
                return None
            prompt = prompt[: max(retry.least_input, len(prompt) // 2)]
        except Exception:  # timeouts and the like: failures become rows, not failed tasks
            retry.sleep(retry.first_wait)
    return None


def classified(df: DataFrame, client: Callable[[str], str], template: str, key: str = "url", column: str = "text", retry: Retry = Retry(), most: int = 15_000) -> DataFrame:
    """``key, reply, status``: NO_TEXT, FAILED or OK for every row; the client runs in Arrow batches."""
    prompts = df.select(key, F.when(F.trim(F.coalesce(column, F.lit(""))) != "", text.prompt(template, text.truncated(F.col(column), most))).alias("prompt"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            replies = [None if p is None else ask(client, p, retry) for p in part["prompt"]]
            status = ["NO_TEXT" if p is None else "FAILED" if r is None else "OK" for p, r in zip(part["prompt"], replies)]
            yield pd.DataFrame({key: part[key], "reply": replies, "status": status})

    return prompts.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, reply string, status string")


def durable(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch transformed and written before the next begins; a batch that runs again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the session's shared folder; a temporary one is set only where there is none and the master is local, as in tests."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pagelens-"))
    return df.checkpoint()


def crawl(links: DataFrame, starts: DataFrame, domain_of: Callable[[Column], Column], blacklist: DataFrame, accept: Callable[[DataFrame], DataFrame], levels: int, budget: int) -> DataFrame:
    """``url, level``: breadth first over ``links(url, link)``, one page for each domain not seen before.

    Links are followed only from accepted pages. Each level is checkpointed; the budget cuts by level and url.
    """
    frontier = starts.select("url").distinct().withColumn("domain", domain_of(F.col("url"))).join(blacklist, "domain", "left_anti")
    frontier = frontier.groupBy("domain").agg(F.min("url").alias("url")).withColumn("level", F.lit(0))
    found = kept(accept(frontier))
    seen, last = kept(frontier.select("domain")), found
    for level in range(1, levels):
        new = links.join(last.select("url"), "url").select(F.col("link").alias("url")).distinct().withColumn("domain", domain_of(F.col("url")))
        new = new.join(blacklist, "domain", "left_anti").join(seen, "domain", "left_anti")
        new = new.groupBy("domain").agg(F.min("url").alias("url")).withColumn("level", F.lit(level))
        new = kept(new)
        if new.isEmpty():
            break
        last = kept(accept(new))
        seen, found = kept(seen.unionByName(new.select("domain"))), kept(found.unionByName(last))
    return found.orderBy("level", "url").limit(budget).select("url", "level")


def windowed(events: DataFrame, time_col: str, by: str, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling or sliding windows; on a stream, events later than ``late`` are dropped."""
    window = F.window(time_col, length, slide) if slide else F.window(time_col, length)
    return events.withWatermark(time_col, late).groupBy(window.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def sessions(events: DataFrame, by: str, time_col: str, gap: str) -> DataFrame:
    """``by, started, n``: runs of events with no pause above ``gap``."""
    return events.groupBy(by, F.session_window(time_col, gap).alias("w")).agg(F.min(time_col).alias("started"), F.count("*").alias("n")).select(by, "started", "n")


def distinct_events(stream: DataFrame, keys: list[str], time_col: str, late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)
