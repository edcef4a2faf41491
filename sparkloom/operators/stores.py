"""Versioned stores and task histories: retention, orphans, latest states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gc_plan(manifests: DataFrame, max_versions: int, cutoff: Column) -> DataFrame:
    """(target, backup_id, created_at): versions to drop, oldest first, never a target's last one.

    manifests: (backup_id, target, created_at, pinned).  Pinned versions count for the floor but are never dropped.
    """
    own = W.partitionBy("target")
    free = manifests.withColumns({"total": F.count(F.lit(1)).over(own), "unpinned": F.count_if(~F.col("pinned")).over(own)}).where(~F.col("pinned"))
    placed = free.withColumn("rn", F.row_number().over(own.orderBy("created_at", "backup_id")))
    chosen = ((F.col("rn") <= F.col("unpinned") - max_versions) | (F.col("created_at") < cutoff)) & (F.col("total") - (F.col("rn") - 1) > 1)
    return placed.where(chosen).select("target", "backup_id", "created_at")


def versions(manifests: DataFrame) -> DataFrame:
    return manifests.groupBy("target").agg(F.count(F.lit(1)).alias("n_versions"), F.count_if("pinned").alias("n_pinned"), F.max("created_at").alias("latest"))


def orphans(objects: DataFrame, manifests: DataFrame, key: str = "digest") -> DataFrame:
    return objects.join(manifests.select(key).distinct(), key, "left_anti")


def latest_state(events: DataFrame) -> DataFrame:
    """(task_id, status, revision): the state of the last revision."""
    return events.groupBy("task_id").agg(F.max_by("status", F.struct("revision", "event_id")).alias("status"), F.max("revision").alias("revision"))


#: States that a task may take after each state.  Fixed values.
TRANSITIONS = {
    "queued": ("starting", "cancelled", "failed"),
    "starting": ("running", "queued", "failed", "interrupted"),
    "running": ("succeeded", "failed", "timed_out", "cancelled", "interrupted"),
}


def invalid_transitions(events: DataFrame) -> DataFrame:
    """(task_id, revision, was, status): states that may not follow the one before; a first state must be queued (was is null then).

    events: (task_id, revision, status), revisions distinct within a task.
    """
    was = F.lag("status").over(W.partitionBy("task_id").orderBy("revision"))
    allowed = F.coalesce((F.col("was").isNull() & (F.col("status") == "queued")), F.lit(False))
    for before, after in TRANSITIONS.items():
        allowed = allowed | F.coalesce((F.col("was") == before) & F.col("status").isin(list(after)), F.lit(False))
    return events.select("task_id", "revision", was.alias("was"), "status").where(~allowed)


def bounded_log(chunks: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """(key, total, head, tail): the first and last bytes of a log of chunks, the middle dropped.

    chunks: (key, order, payload binary).  The head takes a quarter of the limit, at least 1,024 bytes but half of smaller
    limits; the tail the rest.  Only chunks that reach into either are gathered; their number is bounded by the limit's bytes.
    """
    head_limit = max(limit // 4, 1024)
    head_limit = limit // 2 if head_limit >= limit else head_limit
    own = W.partitionBy(key)
    n = F.octet_length("payload").cast("bigint")
    placed = chunks.where(n > 0).withColumns({"end": F.sum(n).over(own.orderBy(order).rowsBetween(W.unboundedPreceding, 0)), "total": F.sum(n).over(own)}).withColumn("start", F.col("end") - n)
    tail_from = F.greatest(F.lit(head_limit).cast("bigint"), F.col("total") - (limit - head_limit))
    head = F.when(F.col("start") < head_limit, F.substring("payload", F.lit(1), (head_limit - F.col("start")).cast("int")))
    skip = F.greatest(tail_from - F.col("start"), F.lit(0))
    tail = F.when(F.col("end") > tail_from, F.substring("payload", (skip + 1).cast("int"), F.octet_length("payload")))
    cut = placed.select(key, F.col(order).alias("at"), "total", head.alias("head"), tail.alias("tail")).where("head is not null or tail is not null")
    whole = lambda c: F.aggregate(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("at", c)))), F.lit(b""), lambda a, r: F.concat(a, r[c]))
    return cut.groupBy(key).agg(F.max("total").alias("total"), whole("head").alias("head"), whole("tail").alias("tail"))


def status(manifests: DataFrame, objects: DataFrame) -> DataFrame:
    """(manifests, pinned, objects, object_bytes) of a whole store."""
    m = manifests.agg(F.count(F.lit(1)).alias("manifests"), F.count_if("pinned").alias("pinned"))
    o = objects.agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("object_bytes"))
    return m.withColumn("one", F.lit(1)).join(o.withColumn("one", F.lit(1)), "one").drop("one")


def history(manifests: DataFrame) -> DataFrame:
    """(target, backup_id, version, change): versions newest first from 1; change against the older neighbour: first, same or changed."""
    own = W.partitionBy("target").orderBy(F.desc("created_at"), F.desc("backup_id"))
    older = F.lead("digest").over(own)
    change = F.when(older.isNull(), "first").when(older == F.col("digest"), "same").otherwise("changed")
    return manifests.select("target", "backup_id", F.row_number().over(own).alias("version"), change.alias("change"))


def newest(manifests: DataFrame, limit: int, before: tuple | None = None) -> DataFrame:
    """The newest backups, or those after the cursor (created_at, backup_id) of the last one shown."""
    rows = manifests
    if before is not None:
        at, backup = F.lit(before[0]).cast(manifests.schema["created_at"].dataType), before[1]
        rows = rows.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("backup_id") < backup)))
    return rows.orderBy(F.desc("created_at"), F.desc("backup_id")).limit(limit)


def audit(manifests: DataFrame, objects: DataFrame) -> DataFrame:
    """(backup_id, digest, problem): objects that manifests name but the store lacks, or holds with other content (actual)."""
    met = manifests.join(objects.select("digest", "actual", F.lit(True).alias("found")), "digest", "left")
    problem = F.when(F.col("found").isNull(), "missing").when(~F.col("actual").eqNullSafe(F.col("digest")), "damaged")
    return met.select("backup_id", "digest", problem.alias("problem")).where("problem is not null")
