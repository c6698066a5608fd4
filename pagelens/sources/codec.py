"""Decoding and encoding of compressed pages. Inflating has no built-in expression, so it runs in Arrow
batches; base64 and the tests around it are native."""

from __future__ import annotations

import base64
import binascii
import gzip
import html
import re
import zlib

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CHARSET = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)
#: Names that pages use for encodings that Python calls otherwise.
ALIASES = {"windows-1250": "cp1250", "win-1250": "cp1250", "x-sjis": "shift_jis", "iso8859-2": "iso-8859-2", "utf8": "utf-8"}


#: Rows and bytes that cross to Python at a time, as a page may inflate to many times its size.
ARROW_ROWS, ARROW_BYTES = 256, 4 << 20


def small_batches() -> None:
    """Pages cross to Python a few at a time, so that a worker's memory does not follow its input. Settings of the session; smaller ones stay."""
    spark = SparkSession.active()
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def inflate_bytes(raw: bytes | None) -> bytes | None:
    """gzip, else zlib, else None; None for no bytes."""
    if not raw:
        return None
    for open_ in (gzip.decompress, zlib.decompress):
        try:
            return open_(raw)
        except (OSError, EOFError, zlib.error):
            continue
    return None


def decode_page(raw: bytes | None) -> str | None:
    """UTF-8 if valid, else the charset that the first 4096 bytes declare, else cp1250, else latin-1."""
    if raw is None:
        return None
    declared = _CHARSET.search(raw[:4096])
    name = declared[1].decode("ascii", "ignore").lower() if declared else ""
    for encoding in ("utf-8", ALIASES.get(name, name), "cp1250"):
        try:
            return raw.decode(encoding)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("latin-1")


@F.pandas_udf(T.BinaryType())
def _inflate(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: inflate_bytes(None if x is None else bytes(x)))


@F.pandas_udf(T.StringType())
def _decode(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: decode_page(None if x is None else bytes(x)))


@F.pandas_udf(T.StringType())
def _replaced(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: "" if x is None else bytes(x).decode("utf-8", "replace"))


@F.pandas_udf(T.StringType())
def _strict(raw: pd.Series) -> pd.Series:
    def one(x) -> str | None:
        try:
            return None if x is None else bytes(x).decode("utf-8")
        except UnicodeDecodeError:
            return None

    return raw.map(one)


@F.pandas_udf(T.BinaryType())
def _deflate(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else gzip.compress(bytes(x), mtime=0))


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(T.StringType())
def _loose(value: pd.Series) -> pd.Series:
    def one(x: str) -> str:
        try:
            raw = base64.b64decode(x)
        except (binascii.Error, ValueError):
            return x
        inflated = inflate_bytes(raw)
        return raw.decode("utf-8", "ignore") if inflated is None else inflated.decode("utf-8", "ignore")

    return value.map(lambda x: "" if x is None else one(x))


def inflated(encoded: Column) -> Column:
    """base64 of gzip or zlib to bytes; null where it is neither."""
    small_batches()
    return _inflate(F.try_to_binary(encoded, F.lit("base64")))


def page_text(encoded: Column) -> Column:
    """base64 of a compressed page to its text, by its charset."""
    return _decode(inflated(encoded))


def prompt_page(encoded: Column) -> Column:
    """base64 of a compressed page as UTF-8, bad bytes replaced; empty where it can't be inflated."""
    return _replaced(inflated(encoded))


def mongo_page(raw: Column) -> Column:
    """The page under ``$binary`` of a JSON object; null for any other shape, for what can't be inflated and for bytes that are not UTF-8."""
    return _strict(inflated(mongo_binary(raw)))


def decoded_bytes(raw: Column) -> Column:
    """Text of page bytes; valid UTF-8 never leaves the JVM."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(_decode(raw))


def loose_text(value: Column) -> Column:
    """Blank is empty, markup stays, base64 is decoded and inflated where it can be, the rest stays."""
    small_batches()
    markup = F.lower(value).rlike("<html|<body|<div")
    return F.when(value.isNull() | (F.trim(value) == ""), "").when(markup, value).otherwise(_loose(value))


def compressed(text: Column) -> Column:
    """base64 of gzip without a time stamp; empty for empty text."""
    small_batches()
    return F.when(text.isNull() | (text == ""), "").otherwise(F.regexp_replace(F.base64(_deflate(text.cast("binary"))), r"[\r\n]", ""))


def mongo_binary(raw: Column) -> Column:
    """The base64 text under ``$binary`` of a JSON object; null for any other shape."""
    return F.get_json_object(raw, "$['$binary'].base64")


def encode_or_keep(record: Column) -> Column:
    """Of a JSON record: its ``html`` compressed if the key is there at all, else its ``compressed_html``, else empty."""
    has = F.array_contains(F.json_object_keys(record), "html")
    return F.when(F.coalesce(has, F.lit(False)), compressed(F.coalesce(F.get_json_object(record, "$.html"), F.lit("")))).otherwise(F.coalesce(F.get_json_object(record, "$.compressed_html"), F.lit("")))


def unescaped(text: Column) -> Column:
    """All character references; texts without an ampersand never leave the JVM."""
    return F.when(text.contains("&"), _unescape(text)).otherwise(text)
