"""Task histories as streams: tumbling counts with a watermark, read to the end of what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.shared import shared_folder
from sparkloom.streaming.retention import run_to_end


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, total): works on streams and on tables alike."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total")).select(F.col("window.start").cast("string").alias("start"), "event_type", "n", "total")


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same through Structured Streaming: file source, available now.

    Each batch gives the windows that it changed; the last batch that has a window counts.  State older than the watermark is
    dropped, and output goes to the shared folder.
    """
    source = spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/events.parquet*")  # a file or a folder
    rows = run_to_end(windowed_counts(stream), shared_folder(spark, "stream"), "update")
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))


QUERIES = {"stream_counts": stream_counts}
ORACLE_SQL = {"stream_counts": "select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, cast(sum(event_id) as bigint) as total from events group by 1, 2"}
