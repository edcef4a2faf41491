"""Strict decoding and encoding of many charsets, and detection, as functions that never fail on a row.

They take a row at a time: Arrow would send 10,000 whole texts at once, and a task's memory would grow with their sizes.
"""

from __future__ import annotations

import codecs

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


@F.udf(_struct(("text", T.StringType()), ("error", T.StringType())), useArrow=False)
def _decode(content: bytes | None, charset: str | None) -> tuple:
    return _try(lambda c, n: bytes(c).decode(n), content, charset)


@F.udf(_struct(("content", T.BinaryType()), ("error", T.StringType())), useArrow=False)
def _encode(text: str | None, charset: str | None) -> tuple:
    return _try(lambda t, n: t.encode(n), text, charset)


def _try(f, value, name):
    if value is None or name is None:
        return None, "NULL"
    try:
        codecs.lookup(name)
    except LookupError:
        return None, "ENCODING_UNKNOWN"
    try:
        return f(value, name), None
    except UnicodeEncodeError:
        return None, "UNREPRESENTABLE"
    except UnicodeDecodeError:
        return None, "MALFORMED"


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_text(content: str | Column, charset: str | Column) -> Column:
    """struct(text, error): strict, so malformed input is an error and no replacement character."""
    return _decode(_column(content), _column(charset))


def encode_text(text: str | Column, charset: str | Column) -> Column:
    return _encode(_column(text), _column(charset))


def _guess(raw: bytes | None) -> tuple[str, int]:
    """A byte order mark, else UTF-16 by its zero bytes, else UTF-8, else nothing sure."""
    if not raw:
        return "utf-8", 0
    for mark, name in ((codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if raw.startswith(mark):
            return name, 100
    if len(raw) >= 4 and len(raw) % 2 == 0 and 0 in raw:
        low, high = raw[1::2].count(0), raw[0::2].count(0)
        name = "utf-16-le" if low > high else "utf-16-be"
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            return "unknown", 0
        good = sum(c.isprintable() or c in "\r\n\t" for c in text)
        if good >= 0.95 * len(text) and max(low, high) >= 0.12 * len(raw) / 2:
            return name, 90
        return "unknown", 0
    try:
        raw.decode("utf-8")
        return "utf-8", 100
    except UnicodeDecodeError:
        return "unknown", 0


@F.udf(_struct(("found", T.StringType()), ("confidence", T.IntegerType())), useArrow=False)
def _detect(content: bytes | None) -> tuple:
    return _guess(None if content is None else bytes(content))


def detect(content: str | Column) -> Column:
    """struct(found, confidence); a confidence under 50 is no answer."""
    return _detect(_column(content))
