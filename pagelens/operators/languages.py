"""Languages by a detector that the caller brings: a function from texts to lists of (language, probability)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import text

Detector = Callable[[list[str]], list[list[tuple[str, float]]]]


def detected(df: DataFrame, key: str, content: Column, detect: Detector, most: int | None = None) -> DataFrame:
    """``key, found``: an array of ``lang, p``, the likeliest first; of the first ``most`` characters if asked.

    Line ends are blanks. A text that the detector fails on has none; a null text too.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for t in part["content"]:
                try:
                    found = detect([t])[0] if t else []
                except Exception:  # a detector's failure is an answer here
                    found = []
                out.append([{"lang": lang, "p": float(p)} for lang, p in sorted(found, key=lambda x: -x[1])])
            yield pd.DataFrame({key: part[key], "found": out})

    one = F.regexp_replace(content, r"[\r\n]+", " ")
    rows = df.select(key, (one if most is None else F.substring(one, 1, most)).alias("content"))
    return rows.mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, found array<struct<lang:string,p:double>>")


def frequent_word_detector(texts: list[str]) -> list[list[tuple[str, float]]]:
    """A small detector that needs no model: each language's share of the frequent words that a text has."""
    out = []
    for t in texts:
        words = t.lower().split()
        counts = {lang: sum(w in some for w in words) for lang, some in text.FREQUENT.items()}
        total = sum(counts.values())
        out.append([(lang, n / total) for lang, n in counts.items() if n])
    return out


def first_is(found: Column, lang: str, least: float = 0.5) -> Column:
    """The likeliest language is ``lang`` with more than ``least``."""
    best = F.try_element_at(found, F.lit(1))
    return F.coalesce((best["lang"] == lang) & (best["p"] > least), F.lit(False))


def any_is(found: Column, lang: str, least: float = 0.75) -> Column:
    """Among the languages is ``lang`` with at least ``least``."""
    return F.exists(found, lambda x: (x["lang"] == lang) & (x["p"] >= least))


def is_language(df: DataFrame, key: str, content: Column, lang: str, detect: Detector | None, least: float = 0.75, most: int = 5000) -> DataFrame:
    """``df`` with ``is_lang``; without a detector every row is, on a detector's failure none."""
    if detect is None:
        return df.withColumn("is_lang", F.lit(True))
    return df.join(detected(df, key, content, detect, most), key).withColumn("is_lang", any_is(F.col("found"), lang, least)).drop("found")
