"""Token files by canonical, length-limited Huffman coding.

One code for the whole corpus comes from the global counts of all ids (summed by Spark; as many numbers as the
vocabulary has reach the driver), by package-merge, so no code is longer than the limit; canonical codes are known
from their lengths alone.  Documents are dealt by ranges of doc_id over files, in ascending order.

A file: magic, limit and vocabulary size, the code length of each id, then blocks.  A block stands alone: the ids
and token counts of its documents (a long document goes on in the next block), a checkpoint (the bit length of
each LANE ids) and the codes.  Decoding walks all lanes of a block at once, one table look-up for each id.

Nulls and edge cases: null and empty texts are documents of the end id alone; null doc_ids come last; documents
that share a doc_id are ordered by the hash of their ids.  An empty table gives no file and no row.
"""

from __future__ import annotations

import contextlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm import byte_tokens, files
from sparkloom.llm.common import Scratch

MAGIC = b"LLHUFF01"
#: Ids of a block and of a lane; the limit of code lengths, and the most that the decoder's windows allow.
BLOCK, LANE, LIMIT, MOST_LIMIT = 1 << 19, 128, 16, 24
#: Raw bytes of a file, and the most files (larger corpora get larger files).
FILE_BYTES, MOST_FILES = 32 << 20, 20_000


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids cannot have codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    n = len(leaves)
    merged, levels = leaves, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        whole = len(merged) // 2 * 2
        both = np.concatenate([leaves, merged[0:whole:2] + merged[1:whole:2]])
        place = np.argsort(both, kind="stable")
        levels.append(place < n)
        merged = both[place]
    taken, of = 2 * n - 2, np.zeros(n, dtype=np.uint8)
    for leaf in reversed(levels):
        k = int(leaf[:taken].sum())
        of[:k] += 1
        taken = 2 * (taken - k)
    lengths[order] = of
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, as an unsigned number: shorter codes first, then smaller ids."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    sizes = lengths[order].astype(np.int64)
    top = int(sizes.max(initial=1))
    # Aligned to the longest code, each code is the sum of the widths of those before it.
    widths = np.left_shift(1, top - sizes)
    codes = np.zeros(len(lengths), dtype=np.uint64)
    codes[order] = ((np.cumsum(widths) - widths) >> (top - sizes)).astype(np.uint64)
    return codes


class Coder:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.wide = lengths.astype(np.int64)
        self.codes = canonical_codes(lengths)
        self.top = int(lengths.max(initial=1))
        self.tables: tuple[np.ndarray, np.ndarray] | None = None

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """(bit length of each lane, the codes)."""
        sizes = self.wide[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        lanes = np.add.reduceat(sizes, np.arange(0, len(ids), LANE)).astype(np.uint16) if len(ids) else np.zeros(0, dtype=np.uint16)
        word = starts >> 5
        # A code lies within the 64 bits from the start of its word: the bits never overlap, so sums are unions.
        value = self.codes[ids] << (64 - (starts & 31) - sizes).astype(np.uint64)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(ids) else np.zeros(0, dtype=np.int64)
        out = np.zeros(int(ends[-1] if len(ids) else 0) // 32 + 2, dtype=np.uint64)
        if len(ids):
            out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
            out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return lanes, out.astype(">u4").tobytes()

    def decode(self, lanes: np.ndarray, payload: bytes, n: int) -> np.ndarray:
        if self.tables is None:
            used = np.flatnonzero(self.lengths)
            order = used[np.argsort(self.lengths[used], kind="stable")]
            repeat = np.left_shift(1, self.top - self.wide[order])
            symbol, size = np.repeat(order, repeat).astype(np.uint32), np.repeat(self.wide[order], repeat)
            rest = (1 << self.top) - len(symbol)
            self.tables = np.append(symbol, np.zeros(rest, dtype=np.uint32)), np.append(size, np.ones(rest, dtype=np.int64))
        symbol, size = self.tables
        raw = np.frombuffer(payload, dtype=np.uint8).astype(np.uint32)
        window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
        at = np.cumsum(lanes.astype(np.int64)) - lanes
        out = np.zeros((LANE, len(lanes)), dtype=np.uint32)
        mask, shift, last = np.uint32((1 << self.top) - 1), 32 - self.top, len(window) - 1
        for k in range(min(LANE, n)):
            if k == n - (len(lanes) - 1) * LANE:
                at = at[:-1]  # the last lane is shorter
            found = (window[np.minimum(at >> 3, last)] >> (shift - (at & 7)).astype(np.uint32)) & mask
            out[k, : len(at)] = symbol[found]
            at = at + size[found]
        return out.T.reshape(-1)[:n]


def _block(coder: Coder, rows: list[tuple[int | None, int, bool]], ids: np.ndarray) -> bytes:
    """rows: doc_id, tokens of it in this block, whether it ends here."""
    lanes, payload = coder.encode(ids)
    doc_ids = np.array([0 if d is None else d for d, _, _ in rows], dtype="<i8")
    sizes = np.array([n for _, n, _ in rows], dtype="<u4")
    flags = np.array([ends + 2 * (d is None) for d, _, ends in rows], dtype=np.uint8)
    head = struct.pack("<IIII", len(rows), len(ids), len(lanes), len(payload))
    return head + doc_ids.tobytes() + sizes.tobytes() + flags.tobytes() + lanes.astype("<u2").tobytes() + payload


def encode_ids(docs: DataFrame, tokenizer_file: str, end: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids of the whole text and the end id, as raw unsigned numbers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_tokens.encoder(tokenizer_file)
        closing, width = np.array([end], dtype=encoder.dtype).tobytes(), encoder.dtype.itemsize
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in byte_tokens.groups(texts):
                ids = [x + closing for x in encoder.encode(texts[part])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, len(ids)), pa.array([len(x) // width for x in ids]), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_column).cast("bigint"), text).mapInArrow(encode, "doc_id bigint, n_tokens bigint, ids binary")


def _count(dtype: np.dtype, vocabulary: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_buffer(), dtype=dtype), minlength=vocabulary) if len(ids.as_buffer()) > 8 * vocabulary else 0
            short = b"".join(x for x in batch.column(0).to_pylist() if len(x) <= 8 * vocabulary)
            total += np.bincount(np.frombuffer(short, dtype=dtype), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return count


def write(spark: SparkSession, docs: DataFrame, folder: str, tokenizer_file: str, end: int, scratch: Scratch, file_bytes: int = FILE_BYTES, limit: int = LIMIT, **columns) -> DataFrame:
    """Writes the corpus to files in folder: (file, path, n_docs, n_tokens), in the files' order."""
    probe = byte_tokens.encoder(tokenizer_file)
    dtype, vocabulary = probe.dtype, probe.library.get_vocab_size()
    limit = min(MOST_LIMIT, max(limit, vocabulary.bit_length()))
    coded = scratch.write(encode_ids(docs, tokenizer_file, end, **columns), "ids")
    tallied = coded.select("ids").mapInArrow(_count(dtype, vocabulary), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocabulary, dtype=np.int64)
    counts[tallied["id"]] = tallied["n"]
    lengths = spark.sparkContext.broadcast(code_lengths(counts, limit))
    number = int(np.clip(-(-int(counts.sum()) * dtype.itemsize // file_bytes), 1, MOST_FILES))
    # Ranges of doc_id with about as many documents each; a manifest has MOST_FILES rows at most, so it may be broadcast.
    cuts = coded.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / number) for k in range(1, number)]), F.lit(max(10_000, 20 * number))).alias("c")).first()["c"] if number > 1 else None
    cuts = sorted(set(cuts or []))
    bounds = spark.sparkContext.broadcast(np.array(cuts, dtype=np.int64))

    @F.pandas_udf("int")
    def file_of(doc_ids: pd.Series) -> pd.Series:
        known = doc_ids.notna()
        out = np.full(len(doc_ids), len(bounds.value), dtype=np.int32)
        out[known.to_numpy()] = np.searchsorted(bounds.value, doc_ids[known].to_numpy().astype(np.int64), side="left")
        return pd.Series(out)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, opened, stream = Coder(lengths.value), contextlib.ExitStack(), None
        rows: list[tuple[int | None, int, bool]] = []
        parts: list[np.ndarray] = []
        room, file, totals = BLOCK, None, []

        def flush() -> None:
            nonlocal rows, parts, room
            if rows:
                stream.write(_block(coder, rows, np.concatenate(parts)))
            rows, parts, room = [], [], BLOCK

        def close() -> None:
            flush()
            opened.close()

        with opened:  # a failure leaves through files.writing(), which drops the file begun
            for batch in batches:
                for number, doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if number != file:
                        close()
                        file = number
                        path = f"{folder}/{file:06d}.huff"
                        stream = opened.enter_context(files.writing(path))
                        stream.write(MAGIC + struct.pack("<II", coder.top, len(coder.lengths)) + coder.lengths.tobytes())
                        totals.append([file, path, 0, 0])
                    ids, at = np.frombuffer(raw, dtype=dtype), 0
                    totals[-1][2] += 1
                    totals[-1][3] += len(ids)
                    while at < len(ids):
                        part = ids[at : at + room]
                        at += len(part)
                        rows.append((doc, len(part), at == len(ids)))
                        parts.append(part)
                        room -= len(part)
                        if not room:
                            flush()
            close()
        if totals:
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*totals, strict=True), kinds, strict=True)], ["file", "path", "n_docs", "n_tokens"])

    dealt = coded.select(file_of("doc_id").alias("file"), "doc_id", "ids").repartition(4 * (len(cuts) + 1), "file")
    ordered = dealt.sortWithinPartitions("file", F.asc_nulls_last("doc_id"), F.xxhash64("ids"), "ids")
    manifest = scratch.write(ordered.mapInArrow(save, "file int, path string, n_docs bigint, n_tokens bigint"), "manifest")
    scratch.drop("ids")
    return manifest


def blocks(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, flags, token counts, ids) of each block of a file."""
    with files.reading(path) as source:
        if source.read(8) != MAGIC:
            raise ValueError(f"{path} is no token file")
        _, vocabulary = struct.unpack("<II", source.read(8))
        coder = Coder(np.frombuffer(source.read(vocabulary), dtype=np.uint8))
        while head := source.read(16):
            n_rows, n_ids, n_lanes, n_bytes = struct.unpack("<IIII", head)
            doc_ids = np.frombuffer(source.read(8 * n_rows), dtype="<i8")
            sizes = np.frombuffer(source.read(4 * n_rows), dtype="<u4")
            flags = np.frombuffer(source.read(n_rows), dtype=np.uint8)
            lanes = np.frombuffer(source.read(2 * n_lanes), dtype="<u2")
            yield doc_ids, flags, sizes, coder.decode(lanes, source.read(n_bytes), n_ids)


def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            before, n, crc = 0, 0, 0
            for doc_ids, flags, sizes, ids in blocks(path):
                wide = memoryview(ids.astype("<u4")).cast("B")
                rows, at = [], 0
                for doc, flag, size in zip(doc_ids.tolist(), flags.tolist(), sizes.tolist(), strict=True):
                    crc = zlib.crc32(wide[4 * at : 4 * (at + size)], crc)
                    at, n = at + size, n + size
                    if flag & 1:
                        rows.append((file, None if flag & 2 else doc, before, n, crc))
                        before, n, crc = before + n, 0, 0
                if rows:
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "doc_id", "before", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files of a manifest."""
    bases = manifest.select("file", F.coalesce(F.sum("n_tokens").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    read = manifest.select("file", "path").repartition(max(1, 4 * manifest.count()), "file").mapInArrow(_crcs, "file int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint")
    return read.join(F.broadcast(bases), "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
