"""Token counts of documents in flat unindexed token files, by a separator scan.

A flat file holds nothing but ids of fixed width; an end-of-document id closes each document.  Files are cut into
blocks at fixed offsets, whatever the documents: each block is searched for separators with numpy, independent of
the others.  A prefix scan over the blocks' few numbers (ids, separators, place of the last one) then tells each
block how many documents began before it and how far back the open one reaches; the lengths found in the blocks
are corrected by that.

The lengths of a block leave it in rows of at most RUN.

Nulls and edge cases: null and empty texts are documents of the end id alone.  An empty file has no documents.
Ids after a file's last separator are an open document (closed = false).  The strings of special tokens within
a text are ordinary text, so only document ends carry the end id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm import byte_tokens, files
from sparkloom.llm.common import Scratch

#: Bytes of a block, and of one read within it; lengths in one row.
BLOCK, READ, RUN = 32 << 20, 4 << 20, 1 << 16


def id_type(tokenizer_file: str) -> str:
    """The width of ids in the flat files that write_flat() makes with this tokenizer."""
    return byte_tokens.encoder(tokenizer_file, special_as_text=True).dtype.str


def write_flat(docs: DataFrame, folder: str, tokenizer_file: str, end: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Each task writes the ids of its documents to one flat file: (file, ordinal, doc_id), the documents' places.

    The rows come from the tasks that write the files, so store them once and read them from there.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_tokens.encoder(tokenizer_file, special_as_text=True)
        name = f"part-{TaskContext.get().partitionId():06d}.ids"
        closing, at = np.array([end], dtype=encoder.dtype).tobytes(), 0
        with files.writing(f"{folder}/{name}") as out:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for part in byte_tokens.groups(texts):
                    for ids in encoder.encode(texts[part]):
                        out.write(ids + closing)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts), pa.string()), pa.array(np.arange(at, at + len(texts))), batch.column(0)], ["file", "ordinal", "doc_id"])
                at += len(texts)

    return docs.select(F.col(id_column).cast("bigint"), text).mapInArrow(write, "file string, ordinal bigint, doc_id bigint")


def _scan(end: int, dtype: np.dtype, block: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.reading(path) as source:
                    source.seek(offset)
                    ends, seen = [], 0
                    while seen * dtype.itemsize < block and (raw := source.read(min(READ, block - seen * dtype.itemsize))):
                        ids = np.frombuffer(raw, dtype=dtype, count=len(raw) // dtype.itemsize)
                        ends.append(np.flatnonzero(ids == end) + seen)
                        seen += len(ids)
                places = np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)
                # The first length still lacks what earlier blocks hold of its document.
                lengths = np.diff(places, prepend=-1).astype(np.int64)
                last = int(places[-1]) if len(places) else None
                for at in range(0, max(1, len(lengths)), RUN):
                    own = lengths[at : at + RUN]
                    run = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([offset]), pa.array([seen]), pa.array([len(places)]), pa.array([last], pa.int64()), pa.array([at]), run],
                        ["path", "offset", "ids", "separators", "last", "at", "lengths"],
                    )

    return scan


def count(spark: SparkSession, folder: str, scratch: Scratch, end: int, dtype: str = "<u2", block: int = BLOCK, name: str = "scan") -> DataFrame:
    """(path, ordinal, n_tokens, closed) of every document in the flat files of folder; n_tokens counts the end id."""
    kind = np.dtype(dtype)
    block -= block % kind.itemsize
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "length").where("length > 0")
    cut = found.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(block).cast("bigint"))).alias("offset"))
    cut = scratch.write(cut, f"{name}-blocks")
    scanned = cut.repartition(max(1, cut.count()), "path", "offset").mapInArrow(
        _scan(end, kind, block), "path string, offset bigint, ids bigint, separators bigint, last bigint, at bigint, lengths array<bigint>"
    )
    scanned = scratch.write(scanned, name)
    before = W.partitionBy("path").orderBy("offset").rowsBetween(W.unboundedPreceding, -1)
    sums = scanned.where("at = 0").select("path", "offset", "ids", "separators", "last").withColumns({"first": F.coalesce(F.sum("ids").over(before), F.lit(0)), "docs_before": F.coalesce(F.sum("separators").over(before), F.lit(0))})
    carried = sums.withColumn("opened", F.coalesce(F.max(F.col("first") + F.col("last")).over(before) + 1, F.lit(0)))
    carried = carried.withColumns({"carry": F.col("first") - F.col("opened"), "is_last": F.lead("offset").over(W.partitionBy("path").orderBy("offset")).isNull()})
    joined = carried.join(scanned.select("path", "offset", "at", "lengths"), ["path", "offset"])
    each = joined.select("path", "opened", "carry", "docs_before", "at", F.posexplode("lengths").alias("k", "length")).withColumn("k", F.col("at") + F.col("k"))
    each = each.withColumn("n_tokens", F.col("length") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).select("path", (F.col("docs_before") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    end_of_file = carried.where("is_last").select("path", (F.col("docs_before") + F.col("separators")).alias("ordinal"), (F.col("first") + F.col("ids") - F.coalesce(F.col("first") + F.col("last") + 1, F.col("opened"))).alias("n_tokens"), F.lit(False).alias("closed"))
    return each.unionByName(end_of_file.where("n_tokens > 0"))
