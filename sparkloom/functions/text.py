"""Line endings, byte order marks, globs and other column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def ending_counts(text: Column) -> tuple[Column, Column]:
    """(line feeds alone, carriage returns with line feed)."""
    crlf = F.regexp_count(text, F.lit("\r\n"))
    return (F.regexp_count(text, F.lit("\n")) - crlf).cast("int"), crlf.cast("int")


def ending_style(lf: Column, crlf: Column) -> Column:
    return F.when((lf > 0) & (crlf > 0), "mixed").when(crlf > 0, "crlf").when(lf > 0, "lf").otherwise("none")


def to_lf(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def to_crlf(text: Column) -> Column:
    """A lone carriage return stays as it is."""
    return F.replace(to_lf(text), F.lit("\n"), F.lit("\r\n"))


def bom_type(content: Column) -> Column:
    """Name of the byte order mark at the start; the four-byte mark goes before the two-byte one that begins it."""
    head = F.hex(F.substring(content, 1, 4))
    marks = [("FFFE0000", "utf-32-le"), ("0000FEFF", "utf-32-be"), ("EFBBBF", "utf-8"), ("FFFE", "utf-16-le"), ("FEFF", "utf-16-be")]
    found = F.lit("none")
    for prefix, name in reversed(marks):
        found = F.when(head.startswith(prefix), name).otherwise(found)
    return found


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: `*` and `?` stay within a segment, `**/` spans any number of them."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def glob_match(path: Column, pattern: str) -> Column:
    """The whole path or its last segment matches."""
    regex = glob_regex(pattern)
    return path.rlike(regex) | F.element_at(F.split(path, "/"), -1).rlike(regex)


def excluded(path: Column, patterns: list[str]) -> Column:
    """By glob, or by the exact name of any segment."""
    out = F.lit(False)
    for p in patterns:
        out = out | (glob_match(path, p) if re.search(r"[*?\[]", p) else F.array_contains(F.split(path, "/"), p))
    return out


def saturating_add(a: Column, b: Column) -> Column:
    """The sum of two longs, held at the largest or smallest one; null if either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_add(a, b), F.when(a > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63)))))


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / the longer length, of whitespace-collapsed text."""
    x, y = (F.trim(F.regexp_replace(c, r"\s+", " ")) for c in (a, b))
    return 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))


def normalized_reference(name: Column) -> Column:
    """A spelled reference: blanks, call brackets and type arguments dropped, `::` and `\\` as dots, leading scopes stripped."""
    out = F.regexp_replace(F.trim(name), r"\(\)$", "")
    out = F.regexp_replace(out, r"<[^<>]*>", "")
    out = F.regexp_replace(out, r"::|\\", ".")
    return F.regexp_replace(out, r"^(crate|self|global)\.", "")


def valid_json(text: Column) -> Column:
    """One whole JSON value.  The parser stops after a first value, so it must also hold within an array and an object."""
    inside = [F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull() for a, b in (("[", "]"), ('{"a":', "}"))]
    return inside[0] & inside[1]
