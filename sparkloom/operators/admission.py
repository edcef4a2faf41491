"""Admission of queued tasks under locks: what a queue worked off from the oldest would start, found in parallel rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.sources.shared import cut

#: So many earlier starts end a task; tasks running at a time.  Fixed values.
MOST_STARTS, CONCURRENCY = 8, 4


def admit(tasks: DataFrame, held: DataFrame, concurrency: int = CONCURRENCY, most_starts: int = MOST_STARTS, most_rounds: int = 200) -> DataFrame:
    """(task_id, decision): failed, started, locked or waiting, for tasks (task_id, created_at, starts, locks); held: (lock) of what runs.

    From the oldest (then the smallest id) on, a task with most_starts earlier starts fails; one whose locks are all free starts and
    takes them; others are locked out; when concurrency tasks have started the rest wait.

    Each round starts every open task that is the oldest open one of all its locks, and locks out those that share a lock with
    it: the same tasks as one by one.  A round settles at least the oldest task of every connected part of the queue.
    """
    spent = F.col("starts") >= most_starts
    own = W.orderBy("created_at", "task_id")
    ordered = tasks.where(~spent).select("task_id", "created_at", F.array_distinct(F.coalesce("locks", F.array().cast("array<string>"))).alias("locks"))
    taken = held.select("lock").distinct()
    pairs = cut(ordered.select("task_id", "created_at", F.explode("locks").alias("lock")), "pairs")
    blocked = pairs.join(taken, "lock", "left_semi").select("task_id").distinct()
    started = cut(ordered.where(F.size("locks") == 0).select("task_id", "created_at"), "free")
    open_ = cut(pairs.join(blocked, "task_id", "left_anti"), "open")
    age = F.struct("created_at", "task_id")
    for _ in range(most_rounds):
        if open_.isEmpty():
            break
        oldest = open_.groupBy("lock").agg(F.min(age).alias("oldest"))
        judged = open_.join(oldest, "lock").groupBy("task_id", "created_at").agg(F.min(F.col("oldest.task_id") == F.col("task_id")).alias("first"))
        first = cut(judged.where("first").select("task_id", "created_at"), "first")
        theirs = open_.join(first.select("task_id"), "task_id", "left_semi").select("lock").distinct()
        gone = open_.join(theirs, "lock", "left_semi").select("task_id").distinct()
        open_ = cut(open_.join(gone, "task_id", "left_anti"), "open")
        started = cut(started.unionByName(first), "started")
    else:
        raise RuntimeError(f"locks did not settle in {most_rounds} rounds")
    # Only the oldest of those that may start do; what is younger than the last of them was not looked at.
    last = started.orderBy("created_at", "task_id").limit(concurrency).withColumn("place", F.row_number().over(own))
    full = last.where(F.col("place") == concurrency).select(age.alias("limit"))
    free = last.select("task_id", F.lit(True).alias("now"))
    joined = tasks.join(free, "task_id", "left").join(F.broadcast(full), F.lit(True), "left")  # one row at most
    late = F.coalesce(F.struct("created_at", "task_id") > F.col("limit"), F.lit(False))
    decision = F.when(late, "waiting").when(spent, "failed").when(F.col("now"), "started").otherwise("locked")
    return joined.select("task_id", decision.alias("decision"))
