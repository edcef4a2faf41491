"""Markdown: sections, links between documents, and what is wrong with them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.edits import path_key

_FENCE = r"\A {0,3}(?:`{3,}[^`]*|~{3,}.*)\z"
_HEADING = r"^ {0,3}#{1,6}(?:[ \t]|$)"
_CODE = r"(?<!`)(`+)(?!`).*?(?<!`)\1(?!`)"
_IMAGE = r"!\[[^\]]*\]\([^()]*\)"
#: A link's target, in angle brackets or bare, and a title after it.
_LINK = r"""\[[^\]]*\]\(\s*(?:<([^<>]*)>|([^)\s]+))(?:\s+(?:"[^"]*"|'[^']*'|\([^()]*\)))?\s*\)"""


def _hits(texts: DataFrame, key: str, pattern: str) -> DataFrame:
    """(key, total, ln, line): the lines that match and lie outside fenced blocks, and how many lines the text has.

    A fence ends at one of its own character, at least as long and with nothing behind it, else at the end of the text.  Only the
    fence lines of a text pass a fold; the others are told by how many fences begin or end before them.
    """
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct((i + 1).alias("ln"), F.regexp_replace(line, r"\r\z", "").alias("line")))
    own = texts.select(key, F.size(F.split("text", "\n")).alias("total"), numbered.alias("numbered"))
    fences = F.filter("numbered", lambda r: r["line"].rlike(_FENCE))

    def step(a: Column, r: Column) -> Column:
        mark = F.regexp_extract(r["line"], r"\A {0,3}(`+|~+)", 1)
        opens = a["mark"] == ""
        closes = r["line"].rlike(r"\A {0,3}(?:`+|~+)[ \t]*\z") & mark.startswith(a["mark"])
        turned = F.concat(a["turns"], F.array(r["ln"]))
        return F.when(opens, F.struct(mark.alias("mark"), turned.alias("turns"))).when(closes, F.struct(F.lit("").alias("mark"), turned.alias("turns"))).otherwise(a)

    start = F.struct(F.lit("").alias("mark"), F.array().cast("array<int>").alias("turns"))
    turns = own.select(key, "total", F.aggregate(fences, start, step, lambda a: a["turns"]).alias("turns"), F.filter("numbered", lambda r: r["line"].rlike(pattern) & ~r["line"].rlike(_FENCE)).alias("found"))
    hits = turns.select(key, "total", "turns", F.inline("found"))
    return hits.where(F.size(F.filter("turns", lambda t: t < F.col("ln"))) % 2 == 0).drop("turns")


def fragment(title: Column) -> Column:
    """Lower case, only letters, digits, `_`, `-`, and `-` for each blank."""
    return F.replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\- ]", ""), F.lit(" "), F.lit("-"))


def number_until_free(slugs: list[str]) -> list[str]:
    """Each name as it is, or with the first number that no earlier name has."""
    seen: dict[str, int] = {}
    out = []
    for slug in slugs:
        name = slug
        while name in seen:
            seen[slug] += 1
            name = f"{slug}-{seen[slug]}"
        seen[name] = 0
        out.append(name)
    return out


def sections(texts: DataFrame, key: str = "path") -> DataFrame:
    """(key, ln, end_ln, level, title, parent_ln, fragment): headings by `#`, each to the line before the next one of its level or a higher one.

    Fragments are numbered until they are free.  Ends, parents and numbers come from windows over a text's headings; only in texts
    where a heading spells another one's number (`a` twice and `a-1`) names are given one after the other.
    """
    line = F.col("line")
    title = F.regexp_replace(F.regexp_extract(line, r"^ {0,3}#+[ \t]*(.*)$", 1), r"(?:^|[ \t]+)#*[ \t]*$", "")
    heads = _hits(texts, key, _HEADING).select(key, "total", "ln", F.length(F.regexp_extract(line, r"^ {0,3}(#+)", 1)).alias("level"), title.alias("title")).withColumn("slug", fragment(F.col("title")))
    own = W.partitionBy(key).orderBy("ln")
    after, before = own.rowsBetween(1, W.unboundedFollowing), own.rowsBetween(W.unboundedPreceding, -1)
    of_level = lambda made: F.coalesce(*[F.when(F.col("level") == k, made(k)) for k in range(1, 7)])
    ends = {f"end{k}": F.min(F.when(F.col("level") <= k, F.col("ln"))).over(after) for k in range(1, 7)}
    parents = {f"up{k}": F.max(F.when(F.col("level") < k, F.col("ln"))).over(before) for k in range(2, 7)}
    again = F.row_number().over(W.partitionBy(key, "slug").orderBy("ln")) - 1
    known = heads.withColumns(ends | parents).withColumns({"end_ln": F.coalesce(of_level(lambda k: F.col(f"end{k}")) - 1, "total"), "parent_ln": of_level(lambda k: F.col(f"up{k}") if k > 1 else F.lit(None))})
    known = known.select(key, "ln", "end_ln", "level", "title", "parent_ln", "slug").withColumn("again", again)
    plain = F.when(F.col("again") > 0, F.concat("slug", F.lit("-"), F.col("again").cast("string"))).otherwise(F.col("slug"))
    # A name that is numbered and one that looks so.
    numbered = heads.groupBy(key, "slug").count().where("count > 1").select(key, F.col("slug").alias("base"))
    alike = heads.select(key, F.regexp_extract("slug", r"^(.*)-\d+$", 1).alias("base"), "slug").where(r"slug rlike '-\\d+$'")
    clashing = alike.join(numbered, [key, "base"], "left_semi").select(key).distinct().withColumn("clash", F.lit(True))
    marked = known.withColumn("fragment", plain).join(clashing, key, "left")
    columns = [key, "ln", "end_ln", "level", "title", "parent_ln", "fragment"]
    schema = marked.select(*columns).schema

    def rename(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ln")
        pdf["fragment"] = number_until_free(pdf["slug"].tolist())
        return pdf[columns].astype({"parent_ln": "Int32"})

    return marked.where("clash is null").select(*columns).unionByName(marked.where("clash").groupBy(key).applyInPandas(rename, schema))


def links(texts: DataFrame, key: str = "path") -> DataFrame:
    """(key, ln, target, fragment): inline links within the workspace, their paths resolved against the text's own folder.

    Code spans and images are none; the target is the text itself for a bare fragment, fragment is empty without one.
    """
    bare = F.regexp_replace(F.regexp_replace("line", _CODE, ""), _IMAGE, "")
    found = _hits(texts, key, r"\]\(").select(key, "ln", F.explode(F.regexp_extract_all(bare, F.lit(_LINK), F.lit(0))).alias("link"))
    href = F.concat(F.regexp_extract("link", _LINK, 1), F.regexp_extract("link", _LINK, 2))
    inner = found.select(key, "ln", href.alias("href")).where(~F.col("href").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:|//)"))
    path = F.substring_index("href", "#", 1)
    folder = F.regexp_extract(F.col(key), r"^(.*/)?[^/]*$", 1)
    resolved = F.when(path.startswith("/"), path_key(F.regexp_replace(path, "^/+", ""))).otherwise(path_key(F.concat(folder, path)))
    return inner.select(key, "ln", F.when(path == "", F.col(key)).otherwise(resolved).alias("target"), F.regexp_extract("href", "#(.*)$", 1).alias("fragment"))


def diagnostics(texts: DataFrame, roots: list[str]) -> DataFrame:
    """(path, ln, kind, detail): links to absent documents or fragments, and documents that no other one links to, roots apart (ln null)."""
    found, known = links(texts), texts.select(F.col("path").alias("target")).distinct()
    absent = found.join(known, "target", "left_anti").select("path", "ln", F.lit("missing_document").alias("kind"), F.col("target").alias("detail"))
    names = sections(texts).select(F.col("path").alias("target"), "fragment").distinct()
    lost = found.where("fragment <> ''").join(known, "target", "left_semi").join(names, ["target", "fragment"], "left_anti")
    unnamed = lost.select("path", "ln", F.lit("missing_fragment").alias("kind"), F.concat_ws("#", "target", "fragment").alias("detail"))
    linked = found.where("path <> target").select("target").distinct()
    alone = known.where(~F.col("target").isin(roots)).join(linked, "target", "left_anti").select(F.col("target").alias("path"), F.lit(None).cast("int").alias("ln"), F.lit("orphan").alias("kind"), F.lit("").alias("detail"))
    return absent.unionByName(unnamed).unionByName(alone)
