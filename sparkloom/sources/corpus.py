"""Tables as a corpus of files: documents, pages and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, doc_id, text): one file for each document, in a folder for each source."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return table(spark, sf_dir, "documents").select(path.alias("path"), "doc_id", "text")


def lines(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, ln, line): framed at line feeds, the carriage return before one stripped; a final feed gives a last empty line."""
    cut = texts.select(*keys, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return cut.select(*keys, (F.col("at") + 1).alias("ln"), F.regexp_replace("line", r"\r\z", "").alias("line"))


def cr_lines(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """As lines(), but a lone carriage return ends a line too (the numbering that searches use)."""
    return texts.select(*keys, F.posexplode(F.split(text, "\r\n|\n|\r")).alias("at", "line")).select(*keys, (F.col("at") + 1).alias("ln"), "line")


def framed(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, own): the lines of lines() as an array, for work that stays within a text."""
    stripped = F.when(F.contains(F.col(text), F.lit("\r")), F.regexp_replace(text, r"\r(\n|\z)", "$1")).otherwise(F.col(text))
    return texts.select(*keys, F.split(stripped, "\n").alias("own"))


def cr_framed(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, own): the lines of cr_lines() as an array."""
    return texts.select(*keys, F.split(text, "\r\n|\n|\r").alias("own"))


def bounded_files(files: DataFrame, most: int) -> DataFrame:
    """(path, truncated): the smallest paths, each once; truncated says that there are more."""
    first = files.select("path").distinct().orderBy("path").limit(most + 1)
    placed = first.select("path", F.row_number().over(W.orderBy("path")).alias("place"), F.count(F.lit(1)).over(W.partitionBy()).alias("n"))
    return placed.where(F.col("place") <= most).select("path", (F.col("n") > most).alias("truncated"))


def read_multiple(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(request_id, place, path, text, error): a result for each path of a request, in its order; one that is missing fails alone.

    requests: (request_id, paths).  A path may be asked for repeatedly; a request without paths has no rows.
    """
    asked = requests.select("request_id", F.posexplode("paths").alias("place", "path"))
    met = asked.join(files.select("path", "text", F.lit(True).alias("found")), "path", "left")
    return met.select("request_id", "place", "path", "text", F.when(F.col("found").isNull(), "NOT_FOUND").alias("error"))


def binary_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified, content) of all files below root; unused columns, contents too, are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
