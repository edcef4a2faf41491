"""Digests over ordered rows of any number, and bounded collections of errors: both from parts that merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.sources.shared import cut

#: Children of a node of a digest tree.
FAN = 1024
#: Details of errors that are kept, and the bytes that each costs beside its texts.  Fixed values.
MOST_DETAILS, DETAIL_COST = 64, 64


def framed(*parts: Column) -> Column:
    """The parts' bytes one after the other, the length of each before it in 8 bytes, so that no two lists of parts are alike."""
    raw = [F.coalesce(p.cast("binary"), F.lit(b"")) for p in parts]
    return F.concat(*[x for p in raw for x in (F.unhex(F.lpad(F.hex(F.octet_length(p).cast("bigint")), 16, "0")), p)])


def tree_digest(records: DataFrame, group: str, order: str, record: str, fan: int = FAN) -> DataFrame:
    """(group, n, digest): a digest of each group's records in their order, whatever the partitions and the sizes of the groups.

    Records are numbered within their group by sorting ranges and counting what lies in the ranges before; fan successive digests
    make one of the level above, until one is left; a group's tree is as high as its own number of records needs.  A node's digest covers its level and the framed digests below it, so no task
    holds more than fan of them.  order is unique within a group.
    """
    spread = records.select(group, order, F.sha2(F.col(record), 256).alias("digest")).repartitionByRange(group, order)
    spread = cut(spread.sortWithinPartitions(group, order).withColumn("part", F.spark_partition_id()), "ordered")
    counts = spread.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(group, "part", F.coalesce(F.sum("n").over(W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = spread.withColumn("at", F.row_number().over(W.partitionBy(group, "part").orderBy(order))).join(F.broadcast(before) if before.count() <= 1 << 16 else before, [group, "part"])
    totals = counts.groupBy(group).agg(F.sum("n").alias("n"))
    level = placed.select(group, (F.col("at") + F.col("before") - 1).alias("at"), "digest").join(totals, group).withColumn("left", F.col("n"))
    most, height = totals.agg(F.max("n")).first()[0] or 1, 0
    while height == 0 or most > 1:
        height += 1
        below = F.array_sort(F.collect_list(F.struct("at", "digest")))
        node = F.aggregate(below, framed(F.lit(height).cast("string")), lambda a, r: F.concat(a, F.unhex(r["digest"])))
        # A tree that has its root waits for higher ones.
        made = F.when((F.col("left") == 1) & F.lit(height > 1), F.first("digest")).otherwise(F.sha2(node, 256))
        level = level.groupBy(group, "n", "left", F.expr(f"at div {fan}").alias("at")).agg(made.alias("digest"))
        level = level.withColumn("left", F.ceil(F.col("left") / fan).cast("bigint"))
        most = -(-most // fan)
    return level.select(group, "n", F.sha2(framed(F.lit("root"), F.col("n").cast("string"), F.col("digest")), 256).alias("digest"))


def collect_errors(errors: DataFrame, group: str, order: str, texts: list[str], budget: int, most: int = MOST_DETAILS) -> DataFrame:
    """(group, total, omitted, kept): how many errors a group has, and in their order the first that fit into most details and a budget of bytes.

    An error is taken if it fits into what is left when its turn comes.  What is left only shrinks, so of errors of one cost the
    first ones are taken; the first `most` of each cost within the budget are all that one task looks at, however many there are.
    """
    cost = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(DETAIL_COST))
    costed = errors.select(F.col(group).alias("of"), F.col(order).alias("at"), cost.alias("cost"), F.struct(order, *texts).alias("detail"))
    totals = costed.groupBy("of").agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(W.partitionBy("of", "cost").orderBy("at"))
    few = costed.where(F.col("cost") <= budget).withColumn("place", place).where(F.col("place") <= most)
    own = F.array_sort(F.collect_list(F.struct("at", "cost", "detail")))

    kind = f"array<{errors.schema[order].dataType.simpleString()}>"

    def take(a: Column, r: Column) -> Column:
        fits = (a["n"] < most) & (r["cost"] <= budget - a["used"])
        return F.when(fits, F.struct((a["n"] + 1).alias("n"), (a["used"] + r["cost"]).alias("used"), F.concat(a["kept"], F.array(r["at"])).cast(kind).alias("kept"))).otherwise(a)

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.array().cast(kind).alias("kept"))
    chosen = few.groupBy("of").agg(own.alias("own")).withColumn("taken", F.aggregate("own", start, take)["kept"])
    kept = chosen.select("of", F.transform(F.filter("own", lambda r: F.array_contains("taken", r["at"])), lambda r: r["detail"]).alias("kept"))
    none = F.array().cast(kept.schema["kept"].dataType)
    return totals.join(kept, "of", "left").select(F.col("of").alias(group), "total", (F.col("total") - F.coalesce(F.size("kept"), F.lit(0))).alias("omitted"), F.coalesce("kept", none).alias("kept"))
