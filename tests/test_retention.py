"""Retention as a stream against the batch form: entries in any order of arrival, late and at equal times."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sparkloom.sources.shared import shared_folder
from sparkloom.streaming import retention, task_events

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def run(spark, tmp_path, batches, late, **limits):
    """What is left of entries (owner, id, minute, bytes) that arrive in batches, and the log of changes."""
    source = tmp_path / "in"
    for k, rows in enumerate(batches):
        rows = [(o, i, START + timedelta(minutes=m), b) for o, i, m, b in rows]
        spark.createDataFrame(rows, "owner bigint, id bigint, ts timestamp, bytes int").coalesce(1).write.mode("append").parquet(f"file://{source}/b{k}")
    stream = spark.readStream.schema("owner bigint, id bigint, ts timestamp, bytes int").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
    log = retention.run_to_end(retention.changes(stream.withWatermark("ts", f"{late} minutes"), **limits), shared_folder(spark, "t")).collect()
    left = {}
    for r in log:
        left[r["owner"], r["id"]] = left.get((r["owner"], r["id"]), 0) + {"retained": 1, "evicted": -1, "expired": -1, "refused": 0}[r["change"]]
    assert set(left.values()) <= {0, 1}
    return {k for k, n in left.items() if n}, log


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(1, 3), i, rng.randint(0, 40), rng.choice([1, 10, 30, 200])) for i in range(60)]
    rng.shuffle(rows)
    limits = {"most_entries": 5, "most_bytes": 70, "lifetime_s": 30 * 60}
    left, log = run(spark, tmp_path, [rows[:20], rows[20:45], rows[45:]], 60, **limits)  # nothing is too late
    table = spark.createDataFrame([(o, i, START + timedelta(minutes=m), b) for o, i, m, b in rows], "owner bigint, id bigint, ts timestamp, bytes int")
    assert left == {(r["owner"], r["id"]) for r in retention.alive(table, late_s=3600, **limits).collect()}
    kinds = {r["change"] for r in log}
    assert {"retained", "evicted", "refused"} <= kinds
    # The rule itself: the longest run of newest entries within both bounds.
    for owner in (1, 2, 3):
        own, kept, total = sorted(((m, i, b) for o, i, m, b in rows if o == owner and b <= 70), reverse=True), set(), 0
        for m, i, b in own:
            total += b
            if len(kept) == 5 or total > 70:
                break
            kept.add((owner, i))
        assert {k for k in left if k[0] == owner} == kept


def test_entries_expire(spark, tmp_path):
    left, log = run(spark, tmp_path, [[(1, 1, 0, 1), (1, 2, 10, 1), (2, 3, 0, 1)], [(3, 4, 45, 1)], [(3, 5, 45, 1), (3, 6, 45, 1)]], 0, most_entries=9, most_bytes=9, lifetime_s=30 * 60)
    assert left == {(3, 4), (3, 5), (3, 6)} and sorted(r["id"] for r in log if r["change"] == "expired") == [1, 2, 3]


def test_streams_of_empty_tables(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    for query in (task_events.stream_counts, retention.retained_entries):
        assert query(spark, str(tmp_path)).agg(F.count(F.lit(1))).first()[0] == 0


def test_a_table_in_a_folder(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for query in (task_events.stream_counts, retention.retained_entries):
        assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(map(tuple, query(spark, "/root/testdata/sf0.001").collect()))


class _Counted:
    """A store of one value and timers, which counts its calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def _call(self, *_):
        self.calls += 1
        return self

    getValueState = getMapState = _call

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def iterator(self):
        return iter(())

    updateValue = removeKey = _call

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class _Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_calls_to_the_store_are_few_for_each_owner():
    import pandas as pd

    store, keeper = _Counted(), retention.Keeper(100, 10_000, 60)
    keeper.init(store)
    second = 1_000_000
    rows = pd.DataFrame({"created": [k * second for k in range(500)], "id": range(500), "bytes": [1] * 500})
    (log,) = keeper.handleInputRows((7,), iter([rows]), _Clock(0))
    assert (log["change"] == "retained").sum() == 500 and (log["change"] == "evicted").sum() == 400
    assert store.calls <= 6 and len(store.timers) == 1
    # The timer of the oldest entry gives way to that of the next one that is left.
    (at,) = store.timers
    store.timers.clear()
    (log,) = keeper.handleExpiredTimer((7,), _Clock(at), _Clock(at))
    assert log["id"].tolist() == [400] and log["change"].tolist() == ["expired"] and store.timers == {at + 1000}
    store.timers.clear()
    (log,) = keeper.handleExpiredTimer((7,), _Clock(at + 10**6), _Clock(at + 1000))
    assert log["id"].tolist() == list(range(401, 500)) and not store.timers
