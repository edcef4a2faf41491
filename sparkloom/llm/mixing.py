"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted target / size times.  The whole part is taken for certain; the fractions
are rounded by the pivotal method: two fractions meet, and one of them becomes 0 or 1 at random while their sum
and each one's expectation stay.  Documents meet others of their source and of about their size, in groups of
bounded size, which leave one open fraction each; these meet again, level by level, until a source has one
group.  So each source's words come near its target with an error of a few documents, in bounded memory.

All draws depend on the seed and on the members of a group alone, which are chosen by hashes: reruns agree
however Spark partitions the rows.

Nulls and edge cases: a null source is a source (last in the order); a null or wordless text has size 0 and is
taken 0 words; a source of size 0 has target 0; null and repeated doc_ids are ordinary rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, Scratch, fresh

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
GROUP = 512
SEED = 17
_NEAR = 1e-9


def words(text: str) -> Column:
    """The number of words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size is the number of words of the whole text."""
    return docs.select("doc_id", "source", words("text").alias("size"))


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target): words shared by weight, none above most times its source's size.

    The weights repeat over the sources in code point order, null last.  Resharing the excess until none is
    above ends at min(most * size, level * weight) with the largest level that any prefix of the sources in
    order of most * size / weight leaves to the rest.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weighed = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("most", most * F.col("source_size").cast("double"))
    before = W.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = rest / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return leveled.select("source", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def pivotal(p: Sequence[float], rng: np.random.Generator, close: bool = False) -> list[float]:
    """Rounds fractions in order; at most one stays open, and none if close."""
    out = [1.0 if x >= 1 - _NEAR else 0.0 if x <= _NEAR else x for x in p]
    draws = rng.random(len(out) + 1)
    held = -1
    for j, b in enumerate(out):
        if b in (0.0, 1.0):
            continue
        if held < 0:
            held = j
            continue
        a = out[held]
        total = a + b
        if total < 1 + _NEAR:
            win, low, first = min(1.0, total), 0.0, draws[j] < a / total
        else:
            win, low, first = 1.0, total - 1, draws[j] < (1 - b) / (2 - total)
        out[held], out[j] = (win, low) if first else (low, win)
        open_ones = [k for k in (held, j) if _NEAR < out[k] < 1 - _NEAR]
        for k in (held, j):
            if k not in open_ones:
                out[k] = float(round(out[k]))
        held = open_ones[0] if open_ones else -1
    if close and held >= 0:
        out[held] = 1.0 if draws[-1] < out[held] else 0.0
    return out


def copies(spark: SparkSession, sized: DataFrame, scratch: Scratch, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """sized's rows with source_size, target and copies, the number of times the mix takes the document."""
    shares = targets(sized, weights, most)
    joined = sized.alias("d").join(shares.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.doc_id", "d.source", "d.size", "s.source_size", "s.target")
    wanted = F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    whole = F.floor(wanted + _NEAR).cast("int")
    rows = joined.select("doc_id", "source", "size", "source_size", "target", whole.alias("whole"), F.greatest(F.lit(0.0), wanted - whole).alias("p"), F.when(F.col("size") > 0, F.floor(2 * F.log2("size"))).otherwise(-1).cast("int").alias("kind"))
    schema = "doc_id bigint, source string, size bigint, source_size bigint, target double, whole int, p double, kind int"
    rows = rows.select(F.col("doc_id").cast("bigint"), "source", "size", "source_size", "target", "whole", "p", "kind")

    def level(rows: DataFrame, keys: list[str], at: int, close: bool) -> DataFrame:
        """Rounds groups of about GROUP rows that agree in keys."""
        count = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
        salt = F.pmod(F.xxhash64(F.lit(seed + at), "r.doc_id", "r.size", "r.p"), F.col("c.groups"))
        dealt = rows.alias("r").join(count.alias("c"), on=same).select("r.*", salt.alias("salt"))

        def round_off(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["size", "doc_id", "p"], kind="stable")
            first = group.iloc[0]
            key = repr((seed, at, None if pd.isna(first["source"]) else first["source"], int(first["kind"]) if "kind" in keys else 0, int(first["salt"])))
            group["p"] = pivotal(group["p"].tolist(), np.random.default_rng(zlib.crc32(key.encode("utf-8", "surrogatepass"))), close)
            return group.drop(columns="salt")

        return scratch.write(dealt.groupBy(*keys, "salt").applyInPandas(round_off, schema), f"level-{at}")

    decided = []
    keys, at = ["source", "kind"], 0
    while True:
        # One group for each source is left: it closes what remains.
        close = keys == ["source"] and (rows.groupBy("source").count().agg(F.max("count").alias("n")).first()["n"] or 0) <= GROUP
        done = level(rows, keys, at, close)
        decided.append(done.where("p = 0 or p = 1"))
        if close:
            break
        rows, keys, at = done.where("p > 0 and p < 1"), ["source"], at + 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def mix(spark: SparkSession, docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; all columns stay.

    Rows that share a doc_id are told apart by source and size; those that share these too take the copies of their
    group in the order of their texts' hashes.
    """
    sized = sizes(docs)
    taken = scratch.write(copies(spark, sized, scratch, **options).where("copies > 0").select("doc_id", "source", "size", "copies"), "taken")
    keys, kept = ["doc_id"], docs
    if not sized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
        size, place = fresh(docs, "size"), fresh(docs, "place")
        own = W.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text"))
        kept = docs.withColumn(size, words("text")).withColumn(place, F.row_number().over(own))
        taken = taken.withColumn("place", F.row_number().over(W.partitionBy("doc_id", "source", "size").orderBy(F.desc("copies"))))
        taken = taken.withColumnsRenamed({"size": size, "place": place})
        keys = ["doc_id", "source", size, place]
    same = [F.col(f"d.`{k}`").eqNullSafe(F.col(f"t.`{k}`")) for k in keys]
    again = F.explode(F.sequence(F.lit(1), F.col("t.copies"))).alias(fresh(docs, "copy"))
    return kept.alias("d").join(taken.alias("t"), same).select(*[F.col(f"d.`{c}`") for c in docs.columns], again).select(*[F.col(f"`{c}`") for c in docs.columns])
