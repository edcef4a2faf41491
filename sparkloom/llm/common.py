"""Helpers that the training-data operators share: shared scratch tables, splits and word splitting."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract of these operators defines it.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Only where that setting is absent and the session is a local one, as in the tests, a temporary folder is made
    and remembered in the session; on a cluster its absence is an error, as a driver's own folder is not shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Written tables in the shared folder, which cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        df.write.option("compression", compression).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more, and lets Spark drop the shuffle files behind them."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            where = jvm.org.apache.hadoop.fs.Path(self.path(name))
            where.getFileSystem(conf).delete(where, True)
        for _ in range(2):  # what the first round frees may hold shuffles that the second one frees
            gc.collect()
            jvm.System.gc()
            time.sleep(0.25)


def strings(column: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The values of an Arrow column, a few at a time, so that a batch is never held twice."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(folds)


def held_out(column: str, folds: int, fold: int) -> Column:
    """True for ids of that fold.  A null id is of no fold: it is not held out, and nothing is learned from it."""
    return F.coalesce(crc_fold(column, folds) == fold, F.lit(False)).alias("held_out")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, compared as Spark compares names."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
