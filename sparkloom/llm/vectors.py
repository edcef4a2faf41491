"""Vectors in blocks: what the two operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

def usable(embedding: str) -> Column:
    """False for vectors that are null, empty, zero, or hold null or non-finite components."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN sorts above infinity
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def as_doubles(embedding: str) -> Column:
    return F.col(embedding).cast("array<double>")


def matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(-1, width)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component is divided out first, so that no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def unpack(packed: bytes, width: int, dtype: type = np.float64) -> np.ndarray:
    return np.frombuffer(packed, dtype=dtype).reshape(-1, width)



#: Bytes after which an Arrow batch to Python is full; Spark's own 64 MB are held twice or more by the executor and by its worker.
BATCH_BYTES = 4 << 20
BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


class BatchRows:
    """with BatchRows(spark, n): jobs started inside send at most n rows at a time to Python."""

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def __init__(self, spark: SparkSession, rows: int):
        self.spark, self.rows = spark, rows

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.key)
        self.spark.conf.set(self.key, str(self.rows))

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self.key, self.before)


class BatchBytes(BatchRows):
    """with BatchBytes(spark, n): jobs started inside send at most n bytes, and the row that exceeds them, at a time to Python."""

    key = BYTES_KEY
