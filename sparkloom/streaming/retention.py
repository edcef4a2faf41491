"""Bounded retention as a stream: entries live for a time, and the newest of an owner within a number and a size.

An owner keeps the longest run of its newest entries (by time, then id) that has at most so many entries and bytes; an entry that
alone is larger is refused.  Whatever is older than an entry that had to go is not taken back, so the state depends on what was
seen, not on the order of arrival.  An entry expires when the watermark reaches its time plus the lifetime.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparkloom.sources.corpus import table
from sparkloom.sources.shared import remove, shared_folder

#: What a store keeps when nothing else is asked for.  Fixed values.
MOST_ENTRIES, MOST_BYTES, LIFETIME_S = 64, 128 << 20, 3600
_CHANGES = "owner bigint, id bigint, bytes bigint, change string"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Keeper(StatefulProcessor):
    """State of an owner, read and written as one value: at most most_entries entries, and the newest entry that had to go.

    Rows out: each entry as it is retained, refused, evicted or expired.  An owner has one timer, for its oldest entry: calls to
    the store are a few for each owner in a batch, and none for each entry.
    """

    def __init__(self, most_entries: int, most_bytes: int, lifetime_s: int):
        self.most_entries, self.most_bytes, self.lifetime = most_entries, most_bytes, lifetime_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.store = handle.getValueState("store", "created array<bigint>, id array<bigint>, bytes array<bigint>, gone array<bigint>, timer bigint")

    def _read(self) -> tuple[dict, tuple | None, int | None]:
        """Sizes of the entries held by (created, id), the newest that had to go, and the timer in milliseconds."""
        was = self.store.get()
        if was is None:
            return {}, None, None
        created, ids, sizes, gone, timer = was
        return dict(zip(zip(created, ids, strict=True), sizes, strict=True)), tuple(gone) or None, timer

    def _write(self, held: dict, last: tuple | None, timer: int | None) -> None:
        due = (min(held)[0] + self.lifetime) // 1000 + 1 if held else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.store.update(([e[0] for e in held], [e[1] for e in held], list(held.values()), list(last or ()), due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, last, timer = self._read()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        log: list[tuple] = []
        for pdf in rows:
            for at, id, size in sorted(zip(pdf["created"].tolist(), pdf["id"].tolist(), pdf["bytes"].tolist(), strict=True)):
                entry = (at, id)
                if size > self.most_bytes:
                    log.append((*key, id, size, "refused"))
                elif entry not in held:
                    log.append((*key, id, size, "retained"))
                    held[entry] = size
            # The longest run of newest entries stays.
            count = total = 0
            for entry in sorted(held, reverse=True):
                count, total = count + 1, total + held[entry]
                late = last is not None and entry <= last
                if late or count > self.most_entries or total > self.most_bytes:
                    if not late:
                        last = entry
                    log.append((*key, entry[1], held.pop(entry), "evicted"))
        log += self._expired(key, held, now)
        self._write(held, last, timer)
        yield pd.DataFrame(log, columns=["owner", "id", "bytes", "change"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, last, _ = self._read()
        log = self._expired(key, held, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000)
        self._write(held, last, None)  # the timer is spent
        yield pd.DataFrame(log, columns=["owner", "id", "bytes", "change"])

    def _expired(self, key, held: dict, now: int) -> list[tuple]:
        over = sorted(e for e in held if e[0] + self.lifetime <= now)
        return [(*key, entry[1], held.pop(entry), "expired") for entry in over]

    def close(self) -> None:
        pass


def changes(entries: DataFrame, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES, lifetime_s: int = LIFETIME_S) -> DataFrame:
    """(owner, id, bytes, change) of a stream (owner, id, ts, bytes) with a watermark on ts."""
    keyed = entries.select("owner", "id", F.unix_micros("ts").alias("created"), F.col("bytes").cast("bigint").alias("bytes"), "ts")
    return keyed.groupBy("owner").transformWithStateInPandas(Keeper(most_entries, most_bytes, lifetime_s), _CHANGES, "Append", "EventTime")


def alive(entries: DataFrame, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES, lifetime_s: int = LIFETIME_S, late_s: int = 0) -> DataFrame:
    """(owner, id, bytes): what a table's entries (owner, id, ts, bytes) leave when the watermark, late_s behind the newest, is reached."""
    own = W.partitionBy("owner").orderBy(F.desc("ts"), F.desc("id")).rowsBetween(W.unboundedPreceding, 0)
    kept = entries.where(F.col("bytes") <= most_bytes).withColumns({"count": F.count(F.lit(1)).over(own), "held": F.sum("bytes").over(own)}).where((F.col("count") <= most_entries) & (F.col("held") <= most_bytes))
    now = entries.agg(F.date_trunc("millisecond", F.max("ts")).alias("newest"))
    until = F.col("ts") + F.make_dt_interval(secs=F.lit(lifetime_s + late_s))
    return kept.join(F.broadcast(now), until > F.col("newest")).select("owner", "id", F.col("bytes").cast("bigint").alias("bytes"))


@contextmanager
def _state_in_files(spark: SparkSession):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream gives until its sources end: each batch is written once under its number in the shared folder."""
    spark, batches = stream.sparkSession, []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        batches.append(number)

    with _state_in_files(spark):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    remove(spark, f"{folder}/checkpoint")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch bigint"
    # A source without files has no batch.
    return spark.read.schema(schema).parquet(f"{folder}/out") if batches else spark.createDataFrame([], schema)


#: The registered query's store: small, so that every rule takes part.
ENTRIES, BYTES, DAYS, LATE_DAYS = 8, 75, 6, 1


def retained_entries(spark: SparkSession, d: str) -> DataFrame:
    """Events as entries of their users: what a stream's store holds in the end."""
    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/events.parquet*")  # a file or a folder
    entries = stream.select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.octet_length("props").alias("bytes")).withWatermark("ts", f"{LATE_DAYS} days")
    log = run_to_end(changes(entries, ENTRIES, BYTES, DAYS * 86400), shared_folder(spark, "retained"))
    left = log.groupBy("owner", "id").agg(F.max("bytes").alias("bytes"), F.count_if(F.col("change") == "retained").alias("in"), F.count_if(F.col("change").isin("evicted", "expired")).alias("out"))
    return left.where("in > out").select("owner", "id", "bytes")


QUERIES = {"retained_entries": retained_entries}
ORACLE_SQL = {
    "retained_entries": f"with e as (select user_id as owner, event_id as id, ts, strlen(props) as bytes from events), k as (select *, count(*) over w as n, sum(bytes) over w as held from e where bytes <= {BYTES} window w as (partition by owner order by ts desc, id desc rows unbounded preceding)) select owner, id, bytes from k where n <= {ENTRIES} and held <= {BYTES} and ts + interval {DAYS + LATE_DAYS} day > (select max(ts) from e)",
}
