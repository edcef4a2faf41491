"""Edits of texts: unified diffs, strict patches, and positions of what a charset lacks."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import text as fx

_HEADER = r"^@@ -(\d{1,9})(?:,(\d{1,9}))? \+(\d{1,9})(?:,(\d{1,9}))? @@"
#: Characters outside a charset, by its name.  Fixed values.
LACKS = {"ascii": r"[^\x00-\x7F]", "iso-8859-1": r"[^\x00-\xFF]"}


@F.udf(T.StringType(), useArrow=False)
def unified_diff(old: str | None, new: str | None, path: str | None) -> str | None:
    """(old, new, path): with three lines of context; empty if the texts are equal, null if either is null.  Lines end at line feeds alone.

    A row at a time: Arrow would send 10,000 whole texts at once.
    """
    if old is None or new is None:
        return None
    rows = list(difflib.unified_diff(old.split("\n"), new.split("\n"), f"a/{path}", f"b/{path}", lineterm=""))
    return "\n".join(rows) + "\n" if rows else ""


def _header_error(path: Column) -> Column:
    """What is wrong with the lines (patch) before the first hunk, and with the patch as a whole; null if nothing is."""
    lines, first = F.col("patch"), F.col("heads")[0]["at"]
    name = lambda k: F.substring_index(F.regexp_extract(F.element_at(lines, k), r"^(?:---|\+\+\+)\s+(\S*)", 1), "/", -1)
    other = lambda k: (F.regexp_extract(F.element_at(lines, k), r"^\S+\s+(\S*)", 1).isin("", "/dev/null")) | F.coalesce(name(k) != F.substring_index(path, "/", -1), F.lit(False))
    return (
        F.when((F.size(lines) < 3) | ~F.element_at(lines, 1).startswith("--- ") | ~F.element_at(lines, 2).startswith("+++ "), "no file header")
        .when(other(1) | other(2), "another file")
        .when(F.exists(F.slice(lines, 3, F.size(lines)), lambda x: x.startswith("--- ") | x.startswith("+++ ")), "several files")
        .when(F.exists(lines, lambda x: x == "\\ No newline at end of file"), "no-newline mark")
        .when(F.size("heads") == 0, "no hunk")
        .when(F.exists(F.slice(lines, F.lit(3), first - 2), lambda x: x != ""), "text before the first hunk")
    )


def _hunk(head: Column, k: Column) -> Column:
    """A hunk as a row: what it takes out of the source, from where, and what it puts there."""
    number = lambda g: F.regexp_extract(head["line"], _HEADER, g)
    count = lambda g: F.when(number(g) == "", F.lit(1)).otherwise(F.try_to_number(F.lpad(number(g), 9, "0"), F.lit("999999999")).cast("int"))
    start = lambda g: F.try_to_number(F.lpad(number(g), 9, "0"), F.lit("999999999")).cast("int")
    stop = F.coalesce(F.try_element_at(F.col("heads"), k + 2)["at"], F.size("patch"))
    body = F.slice(F.col("patch"), head["at"] + 2, stop - head["at"] - 1)
    side = lambda without: F.transform(F.filter(body, lambda x: ~x.startswith(without)), lambda x: F.substring(x, 2, 1 << 30))
    taken, put = side("+"), side("-")
    at = F.when(count(2) == 0, start(1)).otherwise(start(1) - 1)
    strange = F.exists(body, lambda x: ~F.substring(x, 1, 1).isin(" ", "-", "+"))
    fits = (F.size(taken) == count(2)) & (F.size(put) == count(4))
    return F.struct(at.alias("at"), taken.alias("taken"), put.alias("put"), start(3).alias("new_start"), strange.alias("strange"), fits.alias("fits"), (head["at"] + 1).alias("line"))


def apply_patches(rows: DataFrame, text: str, patch: str, path: str | None = None, into: str = "got") -> DataFrame:
    """rows with into: struct(text, error), the text with its unified patch, or the reason against it.

    A patch is for one file (of the name of path, where that is given) and applies as it stands or not at all.  Its hunks become
    rows: each is checked against the slice of the source that it names, then all slices and replacements are joined at once.
    Texts whose endings are all CRLF keep them, mixed ones become LF; the patch's own endings don't count.  Null if either is null.
    """
    lf, crlf = fx.ending_counts(F.col(text))
    lines = F.split(fx.to_lf(F.col(patch)), "\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    heads = F.filter(F.transform("patch", lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda r: (r["at"] > 1) & r["line"].rlike(_HEADER))
    own = rows.select(F.struct(*rows.columns).alias("row"), F.split(fx.to_lf(F.col(text)), "\n").alias("source"), (fx.ending_style(lf, crlf) == "crlf").alias("crlf"), lines.alias("patch"))
    own = own.withColumn("heads", heads).withColumn("wrong", _header_error(F.col(f"row.{path}") if path else F.lit(None)))
    # What has no sound header has no hunks.
    own = own.withColumn("hunks", F.when(F.col("wrong").isNull(), F.transform("heads", _hunk)))
    end = lambda h: h["at"] + F.size(h["taken"])
    last = lambda k: F.try_element_at(F.col("hunks"), F.when(k > 0, k))
    before = lambda k: F.coalesce(end(last(k)), F.lit(0))
    new_at = lambda h: h["new_start"] - F.when(F.size(h["put"]) > 0, 1).otherwise(0)
    # Both sides have as many lines between two hunks.  Told from the hunk before, as a sum over all of them is quadratic; the first wrong hunk is the same.
    new_before = lambda k: F.coalesce(new_at(last(k)) + F.size(last(k)["put"]), F.lit(0))

    def wrong(h: Column, k: Column) -> Column:
        outside = (h["at"] < before(k)) | (end(h) > F.size("source"))
        return (
            F.when(h["strange"], F.lit("a line without a mark"))
            .when(~h["fits"], "not as many lines as announced")
            .when(outside, "overlaps or lies outside")
            .when(F.slice("source", h["at"] + 1, F.size(h["taken"])) != h["taken"], "the source differs")
            .when(new_at(h) - new_before(k) != h["at"] - before(k), "another new start")
        )

    found = F.filter(F.transform("hunks", lambda h, k: F.concat(F.lit("hunk at line "), h["line"].cast("string"), F.lit(": "), wrong(h, k))), lambda e: e.isNotNull())
    own = own.withColumn("error", F.coalesce("wrong", F.try_element_at(found, F.lit(1))))
    pieces = F.flatten(F.transform("hunks", lambda h, k: F.concat(F.slice("source", before(k) + 1, F.greatest(h["at"] - before(k), F.lit(0))), h["put"])))
    rest = F.slice("source", end(F.element_at("hunks", -1)) + 1, F.size("source"))
    made = F.array_join(F.concat(pieces, rest), "\n")
    done = F.when(F.col("error").isNull() & F.col("source").isNotNull() & F.col("patch").isNotNull(), F.when(F.col("crlf"), fx.to_crlf(made)).otherwise(made))
    shown = F.when(F.col("source").isNotNull() & F.col("patch").isNotNull(), F.col("error"))
    return own.select("row.*", F.struct(done.alias("text"), shown.alias("error")).alias(into))


def unrepresentable(texts: DataFrame, charset: str, key: str, most: int = 64) -> DataFrame:
    """(key, total, line, column, char, code): the first characters of each text that a charset lacks, and how many there are in all.

    Lines and columns count from 1, in characters; a carriage return is a character of its line.
    """
    lacks = LACKS[charset]
    chars = lambda line, ln: F.transform(F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0)), lambda c, i: F.struct((ln + 1).alias("line"), (i + 1).alias("column"), c.alias("char")))
    each_line = F.transform(F.split("text", "\n"), lambda line, ln: F.when(line.rlike(lacks), F.filter(chars(line, ln), lambda c: c["char"].rlike(lacks))).otherwise(F.filter(chars(F.lit(""), ln), lambda c: F.lit(False))))
    found = texts.select(key, F.flatten(each_line).alias("found"))
    hits = found.select(key, F.size("found").alias("total"), F.inline(F.slice("found", 1, most)))
    code = F.hex(F.ascii("char"))
    return hits.select(key, "total", "line", "column", "char", F.concat(F.lit("U+"), F.repeat(F.lit("0"), F.greatest(4 - F.length(code), F.lit(0))), code).alias("code"))


def position(text: Column, offset: Column) -> Column:
    """(line, column) of a byte offset, both from 1; null where the offset lies outside or within a character."""
    head = F.try_validate_utf8(F.substring(text.cast("binary"), F.lit(1), offset).cast("string"))
    line = F.regexp_count(head, F.lit("\n")) + 1
    column = F.length(F.substring_index(head, "\n", -1)) + 1
    return F.when((offset >= 0) & (offset <= F.octet_length(text)) & head.isNotNull(), F.struct(line.alias("line"), column.alias("column")))


def path_key(path: Column) -> Column:
    """A path without blanks around, empty and `.` segments; `..` takes back the segment before it; an empty path is `.`."""
    trimmed = F.trim(path)
    rooted = trimmed.startswith("/")

    def step(kept: Column, part: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        back = F.when(last.isNotNull() & (last != ".."), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(rooted, kept).otherwise(F.concat(kept, F.array(part)))
        return F.when(part.isin("", "."), kept).when(part == "..", back).otherwise(F.concat(kept, F.array(part)))

    kept = F.array_join(F.aggregate(F.split(trimmed, "/"), F.array().cast("array<string>"), step), "/")
    whole = F.when(rooted, F.concat(F.lit("/"), kept)).otherwise(kept)
    return F.when(whole == "", ".").otherwise(whole)


def path_stem(key: Column) -> Column:
    """The key of a path without the last extension of its last segment; `.` for a segment that is nothing but one."""
    stem = F.regexp_replace(key, r"\.[^./]*\z", "")
    return F.when(key.isin(".", "..", "/"), key).when(stem == "", ".").otherwise(F.when(stem.endswith("/"), F.regexp_replace(stem, r"(?<=.)/\z", "")).otherwise(stem))
