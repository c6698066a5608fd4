"""The corpus pipeline: quality rules, near duplicates, secrets, source mix and token ids, in this order.

Each stage takes all rows that the one before it kept and returns the columns of ``documents``; the last
returns token ids. Documents that the quality rules reject go; of near duplicates the least id stays;
secrets are masked; the mix repeats or leaves out whole documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelens.llm import bpe, common, mixing, ngram_join, quality, secrets


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it. A null id has a key like any other, a null source is the last source, rows that repeat are taken or left together."""
    return mixing.mixed(docs)


STAGES = [
    ("quality_rules", quality.keep_good),
    ("ngram_join", ngram_join.one_of_each),
    ("secret_scan", secrets.without_secrets),
    ("source_mix", mix_sources),
    ("byte_bpe", bpe.token_ids),
]
#: The first stage is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder before the next reads it."""
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.checkpointed(docs)
    return docs
