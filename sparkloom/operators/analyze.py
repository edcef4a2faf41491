"""Declarations, imports and links of source and markup files, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: For each language (by file extension) what a line that declares something looks like: kind and pattern, the name in group 1.
DECLARATIONS = {
    "py": [("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("import", r"^\s*(?:from|import)\s+([\w.]+)")],
    "java": [("package", r"^\s*package\s+([\w.]+)"), ("import", r"^\s*import\s+(?:static\s+)?([\w.*]+)"), ("class", r"\b(?:class|interface|enum|record)\s+(\w+)"), ("method", r"^\s*(?:(?:public|protected|private|static|final|abstract)\s+)+[\w<>\[\], ]+\s+(\w+)\s*\(")],
    "go": [("package", r"^package\s+(\w+)"), ("import", r"^\s*import\s+\"([^\"]+)\""), ("type", r"^type\s+(\w+)"), ("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)")],
    "ts": [("import", r"^\s*import\b.*?from\s+['\"]([^'\"]+)"), ("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("function", r"\bfunction\s+(\w+)")],
    "js": [("import", r"^\s*import\b.*?from\s+['\"]([^'\"]+)"), ("class", r"\bclass\s+(\w+)"), ("function", r"\bfunction\s+(\w+)")],
    "sql": [("table", r"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([\w.]+)"), ("view", r"(?i)\bcreate\s+(?:or\s+replace\s+)?view\s+([\w.]+)")],
    "md": [("heading", r"^#{1,6}\s+(.+?)\s*#*$")],
    "rs": [("module", r"^\s*(?:pub\s+)?mod\s+(\w+)"), ("import", r"^\s*(?:pub\s+)?use\s+([\w:]+)"), ("struct", r"\b(?:struct|enum|trait)\s+(\w+)"), ("function", r"\bfn\s+(\w+)")],
    "c": [("include", r"^\s*#\s*include\s+[<\"]([^>\"]+)"), ("struct", r"\bstruct\s+(\w+)\s*\{")],
    "rb": [("module", r"^\s*module\s+(\w+)"), ("class", r"^\s*class\s+(\w+)"), ("method", r"^\s*def\s+([\w.?!]+)"), ("import", r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)")],
}


def symbols(files: DataFrame) -> DataFrame:
    """(path, ln, kind, name): declarations and imports, line by line, all in the JVM."""
    cut = files.select("path", F.regexp_extract("path", r"\.(\w+)\z", 1).alias("ext"), F.posexplode(F.split("text", "\r\n|\n")).alias("at", "line"))
    tried = None
    for ext, rules in DECLARATIONS.items():
        found = F.array(*[F.when((F.col("ext") == ext) & F.col("line").rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", p, 1).alias("name"))) for kind, p in rules])
        tried = found if tried is None else F.concat(tried, found)
    hits = cut.select("path", (F.col("at") + 1).alias("ln"), F.explode(F.array_compact(tried)).alias("hit"))
    return hits.select("path", "ln", "hit.kind", "hit.name")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, href): the targets of all links."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\b[^<>]*?href="([^"<>]*)"'), 1)).alias("href"))


def tag_counts(pages: DataFrame) -> DataFrame:
    tags = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)[^<>]*>"), 1)).alias("tag"))
    return tags.groupBy("page_id", F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
