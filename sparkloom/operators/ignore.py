"""Nested ignore files: their rules as a table, joined to paths by the folders above them.

A rule holds below the folder of its file.  Of all rules that match a file or folder, the one of the deepest file counts, in a file
the last line; one that begins with `!` takes it back.  What lies in an ignored folder is ignored, and so is a folder `.git`.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The most rules of a file, bytes and segments of a pattern; more are an error.  Fixed values.
MOST_RULES, MOST_BYTES, MOST_SEGMENTS = 10_000, 4096, 128
#: The most (folder, rules) rows that are broadcast.
SMALL = 1 << 16

_PIECE = re.compile(r"(?P<any>\*+)|(?P<one>\?)|\[(?P<no>\^?)(?P<set>(?:\\.|[^\\\]])+)\]|\\(?P<escaped>.)|(?P<plain>[^*?\[\\])", re.S)


def _segment(glob: str) -> str | None:
    """A segment's glob as a regular expression that stays within a segment; null if it is malformed."""
    out, at = "", 0
    while at < len(glob):
        m = _PIECE.match(glob, at)
        if m is None:
            return None
        at = m.end()
        if m["any"]:
            out += "[^/]*"
        elif m["one"]:
            out += "[^/]"
        elif m["set"]:
            inner = "".join(c if c == "-" and 0 < k < len(parts) - 1 else re.escape(c[-1]) for parts in [re.findall(r"\\.|.", m["set"], re.S)] for k, c in enumerate(parts))
            out += f"(?:(?!/)[{m['no']}{inner}])"
        else:
            out += re.escape(m["escaped"] or m["plain"])
    return out


def pattern_regex(pattern: str, anchored: bool) -> str | None:
    """For a path below the rule's folder: a bare name is any of its segments, other patterns are the whole path."""
    if "/" not in pattern and not anchored:
        own = _segment(pattern)
        return None if own is None else f"^(?:.*/)?{own}(?:/.*)?$"
    out, parts = "", pattern.split("/")
    while len(parts) > 1 and parts[-1] == parts[-2] == "**":
        parts.pop()
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            # Any number of segments, none as well.
            out = (out[:-1] if out.endswith("/") else out) + ("(?:/[^/]+)*" if out else "(?:.*)") if last else out + "(?:[^/]+/)*"
            continue
        own = _segment(part)
        if own is None:
            return None
        out += own + ("" if last else "/")
    return f"^{out}$"


def _regexes(patterns: pd.Series, anchored: pd.Series) -> pd.Series:
    return pd.Series([pattern_regex(p, a) for p, a in zip(patterns, anchored, strict=True)], dtype=object)


def rules(files: DataFrame) -> DataFrame:
    """(scope, no, regex, negated, dir_only) of ignore files (scope, text); scope is the file's folder, empty for the root.

    A pattern that is malformed or too long, or a file with too many rules, is an error.
    """
    each = files.select("scope", F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    bare = F.regexp_replace("raw", r"\r\z", "")
    # Blanks at the end go, but for one that a backslash keeps.
    kept = F.regexp_replace(F.regexp_replace(bare, r"(?<!\\)((?:\\\\)*) +\z", "$1"), r"(?<!\\)((?:\\\\)*)\\( ) *\z", "$1$2")
    lines = each.select("scope", "no", kept.alias("line")).where("line <> '' and not startswith(line, '#')")
    lines = lines.select("scope", "no", F.col("line").startswith("!").alias("negated"), F.regexp_replace("line", r"\A!?(?:\\(?=[#!]))?", "").alias("line"))
    lines = lines.select("scope", "no", "negated", F.col("line").endswith("/").alias("dir_only"), F.regexp_replace("line", r"/\z", "").alias("line"))
    lines = lines.select("scope", "no", "negated", "dir_only", F.col("line").startswith("/").alias("anchored"), F.regexp_replace("line", r"\A/", "").alias("pattern")).where("pattern <> ''")
    regex = F.pandas_udf(_regexes, T.StringType())
    made = lines.withColumn("regex", regex("pattern", "anchored"))
    sound = F.col("regex").isNotNull() & (F.octet_length("pattern") <= MOST_BYTES) & (F.size(F.split("pattern", "/")) <= MOST_SEGMENTS)
    named = F.concat(F.lit("bad ignore pattern: "), "scope", F.lit("/.gitignore line "), (F.col("no") + 1).cast("string"))
    return made.select("scope", "no", F.when(sound, F.col("regex")).otherwise(F.raise_error(named).cast("string")).alias("regex"), "negated", "dir_only")


def _ancestors(path: str) -> Column:
    """The path's own folders from the top, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def ignored(paths: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """(path, ignored) of paths (path, is_dir), each relative to the root, `/` between segments.

    Folders are judged once each, whatever they hold; a node meets the rules of a folder above it as one row.
    """
    by_scope = rules(ignore_files).groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("no", "regex", "negated", "dir_only"))).alias("own"))
    checked = F.when(F.size("own") > MOST_RULES, F.raise_error(F.concat(F.lit("too many rules in "), "scope")).cast(by_scope.schema["own"].dataType)).otherwise(F.col("own"))
    by_scope = by_scope.select("scope", checked.alias("own"))
    by_scope = F.broadcast(by_scope) if by_scope.count() <= SMALL else by_scope
    above = paths.select("path", "is_dir", F.posexplode(_ancestors("path")).alias("at", "node"))
    above = above.select("path", "node", (F.col("is_dir") | (F.col("node") != F.col("path"))).alias("is_dir"))
    nodes = above.select("node", "is_dir").distinct()
    scopes = F.concat(F.array(F.lit("")), F.filter(_ancestors("node"), lambda a: a != F.col("node")))
    met = nodes.select("node", "is_dir", F.posexplode(scopes).alias("depth", "scope")).join(by_scope, "scope")
    below = F.when(F.col("scope") == "", F.col("node")).otherwise(F.expr("substr(node, length(scope) + 2)"))
    hits = F.filter("own", lambda r: (~r["dir_only"] | F.col("is_dir")) & F.rlike(F.col("below"), r["regex"]))
    judged = met.withColumn("below", below).select("node", "is_dir", "depth", F.try_element_at(hits, F.lit(-1))["negated"].alias("negated")).where("negated is not null")
    closed = judged.groupBy("node", "is_dir").agg(F.max_by("negated", "depth").alias("negated")).where("not negated").select("node", "is_dir")
    git = nodes.where(F.col("is_dir") & (F.element_at(F.split("node", "/"), -1) == ".git")).select("node", "is_dir")
    shut = above.join(closed.union(git).distinct(), ["node", "is_dir"], "left_semi").select("path").distinct()
    return paths.join(shut.withColumn("ignored", F.lit(True)), "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))
