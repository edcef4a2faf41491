"""Exact deduplication: 128-bit content hashes find the groups, bytes decide them.

1. Each text is normalised (every run of `[\\x20\\x09-\\x0D]` becomes one space) and hashed to 128 bits.  Only the hash, the id
   and the digest of a row are written; rows are numbered there, so that a lost task cannot change which one stays.
2. Hashes are counted, with partial sums before the shuffle, so a group of any size is a few partial rows.  A hash that comes
   once is decided: its row stays.
3. The texts of repeated hashes are read once more and grouped by hash and bytes, again with partial groups, so a task sends
   a text once, however many copies it has.  A hash with one text is a group as it stands.
4. A hash with several texts is a collision: its rows are grouped by their bytes themselves.

The texts of hashes that come once are never shuffled while the repeated hashes are few enough to be broadcast (SMALL, counted
first); beyond that the join shuffles them.

Nulls and edge cases: a null text counts as empty.  Null doc_ids come last: such a row stays only where no equal text has an
id (then keep_id is null).  Rows that share doc_id and text are rows of their own in group_size, and exactly one row of every
group has kept true.  An empty table gives no rows; other columns of any name are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import WHITE, Scratch

#: The most hashes that are broadcast; more are joined by a shuffle.
SMALL = 1 << 20


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, " ")


def content_hash(text: Column) -> Column:
    """128 bits of the text's bytes."""
    return F.unhex(F.md5(text))


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def _groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, first, group_size): rows without an id come last."""
    return rows.groupBy(*by).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"))


def _verdicts(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Each row with its group; rows without one are their own."""
    first = F.col("first")
    stays = F.coalesce(first["row"] == F.col("row"), F.lit(True))
    keep = F.when(first.isNull(), F.col("doc_id")).otherwise(first["doc_id"])
    size = F.coalesce("group_size", F.lit(1)).cast("bigint")
    return rows.join(groups, by, "left").select("doc_id", keep.alias("keep_id"), size.alias("group_size"), stays.alias("kept"), "text_sha256")


def dedup(spark: SparkSession, docs: DataFrame, scratch: Scratch, hashed=content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs (doc_id, text); hashed gives the content hash."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised("text").alias("text")).withColumn("hash", hashed(F.col("text")))
    rows = scratch.write(texts.select("hash", "doc_id", F.sha2("text", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "rows")
    repeated = scratch.write(_groups(rows, ["hash"]).where("group_size > 1"), "repeated")

    hashes = _few(repeated.select("hash"))
    variants = texts.join(hashes, "hash", "left_semi").groupBy("hash", "text").count().groupBy("hash").agg(F.count(F.lit(1)).alias("texts"))
    collided = scratch.write(variants.where("texts > 1").select("hash"), "collided")
    if collided.isEmpty():
        return _verdicts(rows, _few(repeated), ["hash"])
    several = _few(collided)
    alone = _verdicts(rows.join(several, "hash", "left_anti"), _few(repeated.join(several, "hash", "left_anti")), ["hash"])
    apart = texts.join(several, "hash", "left_semi").select("hash", "text", "doc_id", F.sha2("text", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    apart = scratch.write(apart, "apart")
    return alone.unionByName(_verdicts(apart, _groups(apart, ["hash", "text"]), ["hash", "text"]))
