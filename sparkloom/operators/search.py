"""Text searches over lines: matches with context, counts, files, pages."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: A word boundary between ASCII words, whatever the letters around.
_BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_LOOK_AROUND = re.compile(r"\(\?(?:[=!]|<[=!]|>)|\\[1-9]")


def any_of(patterns: Sequence[str], case_sensitive: bool = True) -> str:
    """One regular expression that matches where any pattern does; look-around and back references are refused."""
    for p in patterns:
        re.compile(p)
        if _LOOK_AROUND.search(p):
            raise ValueError(f"not supported: {p}")
    joined = "|".join(f"(?:{re.sub(r'((?:^|[^\\])(?:\\\\)*)\\b', lambda m: m[1] + _BOUNDARY, p)})" for p in patterns)
    return joined if case_sensitive else f"(?i:{joined})"


def byte_column(line: Column, pattern: str) -> Column:
    """1-based byte offset of the first match in a line."""
    return (F.octet_length(F.substring(line, F.lit(1), F.regexp_instr(line, F.lit(pattern)) - 1)) + 1).cast("int")


def grep(texts: DataFrame, patterns: Sequence[str], key: str = "path", before: int = 0, after: int = 0, case_sensitive: bool = True, matches_only: bool = False) -> DataFrame:
    """(key, ln, col, text, before, after): the matching lines; contexts of near matches overlap, as they do not merge.

    texts: (key, own), from framed() or cr_framed().  Each text is searched in its place; only hits leave it.
    """
    pattern = any_of(patterns, case_sensitive)
    own = F.col("own")
    around = lambda lo, hi: F.slice(own, lo, hi - lo + 1)
    numbered = F.filter(F.transform(own, lambda line, i: F.struct((i + 1).alias("ln"), line.alias("line"))), lambda r: r["line"].rlike(pattern))
    empty = F.array().cast("array<string>")

    def with_context(r: Column) -> Column:
        ahead = around(F.greatest(r["ln"] - before, F.lit(1)), r["ln"] - 1) if before else empty
        behind = around(r["ln"] + 1, r["ln"] + after) if after else empty
        return F.struct(r["ln"].alias("ln"), r["line"].alias("line"), ahead.alias("before"), behind.alias("after"))

    hits = texts.select(key, F.inline(F.transform(numbered, with_context)))
    shown = F.regexp_extract("line", pattern, 0) if matches_only else F.col("line")
    return hits.select(key, "ln", byte_column(F.col("line"), pattern).alias("col"), shown.alias("text"), "before", "after")


def count_matches(texts: DataFrame, patterns: Sequence[str], key: str = "path") -> DataFrame:
    """(key, n): matching lines of each text (key, own), not occurrences; texts without one are absent."""
    pattern = any_of(patterns)
    n = F.size(F.filter("own", lambda line: line.rlike(pattern))).cast("bigint")
    return texts.select(key, F.explode(F.filter(F.array(n), lambda k: k > 0)).alias("n"))


def page(rows: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def after_key(rows: DataFrame, keys: Sequence[str], anchor: Sequence[object], limit: int) -> DataFrame:
    """The next page after an anchor, by the key itself: no row before it is read again in order."""
    return rows.where(F.struct(*keys) > F.struct(*[F.lit(a).cast(rows.schema[k].dataType).alias(k) for k, a in zip(keys, anchor, strict=True)])).orderBy(*keys).limit(limit)


def read_range(texts: DataFrame, key: str, first: int, count: int) -> DataFrame:
    """(key, body, total_lines): some lines of each text (key, own) joined again; the total is that of the whole text."""
    own = texts.where("own is not null")
    return own.select(key, F.array_join(F.slice("own", first, count), "\n").alias("body"), F.size("own").cast("bigint").alias("total_lines"))


def likely_binary(text: Column) -> Column:
    """NUL, or a tenth and more control characters, among the first 8192 characters."""
    head = F.substring(text, 1, 8192)
    return F.coalesce(head.contains("\0") | (F.regexp_count(head, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]")) * 10 >= F.length(head)) & (F.length(head) > 0), F.lit(False))


def edits(a: str | None, b: str | None) -> int | None:
    """Levenshtein distance of two strings by code points: a column of the table is one number of bits (Myers, Hyyrö)."""
    if a is None or b is None:
        return None
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, len(a) - 1
    up, down, found = every, 0, len(a)
    for c in b:
        equal = places.get(c, 0)
        level = ((((equal & up) + up) ^ up) | equal) & every
        more, less = down | (every ^ (level | up)), up & level
        found += (more >> last) - (less >> last)
        equal |= down
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | (every ^ (equal | more)), more & equal
    return found


#: A row at a time: texts are large, and Arrow would gather 10,000 of them.
_edits = F.udf(edits, T.IntegerType(), useArrow=False)


def fuzzy_windows(texts: DataFrame, key: str) -> DataFrame:
    """(key, ln, distance, similarity): each window of as many lines as the sought text has, with its edits to the sought text.

    texts: (key, text, sought).  Lines are framed as in lines() and compared whole; the similarity is 1 - edits / the longer
    length, of lines whose blanks are collapsed.
    """
    framed = [F.regexp_replace(c, r"\r(\n|\z)", "$1") for c in ("text", "sought")]
    own, wanted = F.split(framed[0], "\n"), F.split(framed[1], "\n")
    cut = texts.select(key, own.alias("own"), framed[1].alias("a"), F.size(wanted).alias("n")).where("size(own) >= n")
    each = cut.select(key, "a", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("own") - F.col("n") + 1), lambda i: F.array_join(F.slice("own", i, F.col("n")), "\n"))).alias("at", "b"))
    x, y = (F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\S\n]+", " "), " ?\n ?", "\n")) for c in ("a", "b"))
    met = each.select(key, (F.col("at") + 1).alias("ln"), "a", "b", x.alias("x"), y.alias("y"))
    same = (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))
    met = met.withColumn("distance", _edits("a", "b")).withColumn("plain", _edits(F.when(~same, F.col("x")), F.when(~same, F.col("y"))))
    return met.select(key, "ln", "distance", (1 - F.coalesce("plain", "distance") / F.greatest(F.length("x"), F.length("y"), F.lit(1))).alias("similarity"))


def common_run(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, run): the longest run of equal trimmed lines of two sides: (keys, ln, line) each.  Runs are islands of one diagonal."""
    a = left.select(*keys, F.col("ln").alias("i"), F.trim("line").alias("line"))
    b = right.select(*keys, F.col("ln").alias("j"), F.trim("line").alias("line"))
    met = a.join(b, [*keys, "line"]).withColumn("diagonal", F.col("i") - F.col("j"))
    island = F.col("i") - F.row_number().over(W.partitionBy(*keys, "diagonal").orderBy("i"))
    runs = met.withColumn("island", island).groupBy(*keys, "diagonal", "island").agg(F.count(F.lit(1)).alias("run"))
    return runs.groupBy(*keys).agg(F.max("run").alias("run"))
