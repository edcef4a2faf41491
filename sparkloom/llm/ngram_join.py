"""N-gram Jaccard join: links of documents whose sets of 5-word shingles have a Jaccard similarity >= 0.75.

1. A bounded sketch counts all shingles of all texts (counters by hash, summed over partitions in slices).  Its
   logarithm, 8 bits a counter, reaches to 2^31; it is broadcast and orders every document's shingles rare first.
2. Each task keeps, of the documents with one and the same set, one: copies are joined by their 128-bit set
   digest and cost nothing afterwards.  The others emit their prefix: any two sets that reach the similarity
   share one of their first n - ceil(0.75 n) + 1 shingles.
3. The prefixes meet by shingle.  Of each list the most central document (the one with the commonest shingles)
   is paired with all others: a star, linear in the list.  Length and positional filters drop pairs there.  Of each
   distinct pair small bitmaps of both sets bound the overlap first; what passes is verified once, after a suffix
   filter (a bound by hash ranges).
4. Lists that still hold more than one component beside their head look for further pairs of different components
   that pass the filters; a list with a few of these for each member yields them, to be verified once.  A list with
   more is gathered with others of its head; such a bundle is cut into blocks by set size and by hash, only blocks
   whose sizes pass the length filter meet, and these are compared exactly, with one matrix product over their
   shingles.  Pairs inside one component are never looked at again.  So no link between different components is
   lost, and no list is expanded into its pairs.

Common shingles are salted: a list's members are dealt by document over as many groups as the sketch counts beyond
a counter's usual load, each with its own head, and the heads meet in a second round.

Nulls and edge cases: a text that is null or has no word has an empty set and links with nothing; one with fewer
than five words is a single shingle.  Rows with a null doc_id take no part and come back with a null component_id.
Rows that share a doc_id are verified each with its own text, under a key of its own, and are of one component, as
they are one document.  An empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sparkloom.llm.common import Scratch, strings
from sparkloom.llm.components import components
from sparkloom.llm.shingles import mix, shingle_sets
from sparkloom.llm.vectors import BATCH_BYTES, BatchBytes, BatchRows

#: Similarity as a fraction.
OVER, UNDER = 75, 100
SKETCH_BITS = 22
#: Slices in which the sketch is summed, parts that one task adds at first, and steps of a counter's logarithm a doubling.
SLICES, PARTS, STEPS = 16, 64, 8
#: Sketched count from which a shingle's list is salted, into groups of about half as many.
HOT = 20_000
#: Sets that a task remembers, and the most rows of two numbers that are broadcast (other tables are shuffled).
SEEN, SMALL = 100_000, 1 << 20
#: A document's size and the position in its prefix, in one long with its centrality and the salt's bits.
FIELD = 26
LARGEST = (1 << FIELD) - 1
#: Shingles in a block of a bundle, about.
BLOCK = 1 << 16
RANGES = 32
#: Rows of numbers that are sent to Python at once; BATCH_BYTES bounds those of texts and sets.
ROWS = 10_000
#: Pairs whose products a task holds at once.
STRIP = 1 << 19
#: Candidates for each member beyond which a list is compared in blocks.
FEW = 8


def prefix_length(n: int) -> int:
    return n - (OVER * n + UNDER - 1) // UNDER + 1


def least_overlap(n: int, m: int) -> int:
    """The fewest common shingles with which sets of n and m reach the similarity."""
    return (OVER * (n + m) + OVER + UNDER - 1) // (OVER + UNDER)


def _linked(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return UNDER * common >= OVER * (n + m - common)


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u8").tobytes(), 1)


def _add_packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, packed in zip(batch["slice"], batch["counts"], strict=True):
            counts = np.frombuffer(zlib.decompress(packed), dtype="<u8")
            if k in sums:
                sums[k] += counts
            else:
                sums[k] = counts.copy()
    for k, total in sums.items():
        yield pd.DataFrame({"slice": [k], "counts": [_packed(total)]})


@dataclasses.dataclass(frozen=True)
class Order:
    """logs: of each sketch counter STEPS * log2(1 + count), at most 255; load: the mean of the counters; hot: the count that is salted."""

    logs: np.ndarray
    load: float
    hot: int = HOT

    def salts(self, tokens: np.ndarray) -> np.ndarray:
        """log2 of the number of groups over which each token's list is dealt.

        What other shingles are likely to add to a counter, and half a step, is taken off, so that rare shingles are
        never dealt out where all counters are high.
        """
        logs = (tokens >> np.uint64(56)).astype(np.float64)
        count = np.exp2((logs - 0.5) / STEPS) - self.load - 4 * np.sqrt(self.load)
        return np.where(count >= self.hot, np.ceil(np.log2(np.maximum(count, 2) / (self.hot / 2))), 0).astype(np.int64)


def frequency_order(docs: DataFrame, hot: int = HOT) -> Order:
    """What orders shingles rare first.

    A partition sends one row of fixed size for each slice of the counters; two levels of tasks add them, and the
    driver gets one row for each slice.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            for _, shingles in shingle_sets(strings(batch.column(0))):
                np.add.at(counts, _buckets(shingles), np.uint32(1))
        for k, part in enumerate(np.split(counts, SLICES)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(part)])], ["slice", "counts"])

    schema = "slice int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema).withColumn("part", F.spark_partition_id())
    parts = parts.repartition(SLICES, "slice", F.floor(F.col("part") / PARTS)).select("slice", "counts").mapInPandas(_add_packed, schema).repartition(SLICES, "slice").mapInPandas(_add_packed, schema)
    total = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES))
    for row in parts.collect():  # one job; an iterator would start one for each shuffle partition
        total[row["slice"]] += np.frombuffer(zlib.decompress(row["counts"]), dtype="<u8")
    return Order(np.minimum(255, np.round(STEPS * np.log2(1 + total))).astype(np.uint8).ravel(), float(total.mean()), hot)


def _tokens(shingles: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """8 bits of frequency above 56 bits of the shingle: their order is rare first."""
    return (frequency.astype(np.uint64) << np.uint64(56)) | (mix(shingles) & np.uint64((1 << 56) - 1))


def _digests(n: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each of some successive sets of n shingles; 0 for empty ones."""
    high, low = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        starts = (np.cumsum(n) - n)[full]
        high[full] = np.bitwise_xor.reduceat(mix(shingles + np.uint64(1)), starts)
        low[full] = np.add.reduceat(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
    return high, low


def _signature(shingles: np.ndarray) -> bytes:
    """A bitmap of 4 to 8 bits for each shingle: a bit for the hash of each, so that halves may be laid over each other."""
    bits = max(64, 1 << (4 * len(shingles) - 1).bit_length())
    flags = np.zeros(bits, dtype=bool)
    flags[(mix(shingles ^ np.uint64(0x5BD1E995)) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _may_link(n: int, m: int, left: bytes, right: bytes) -> bool:
    """False if the bitmaps of two sets show that they lack too much of each other."""
    x, y = np.frombuffer(left, dtype=np.uint8), np.frombuffer(right, dtype=np.uint8)
    width = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(z.reshape(-1, width), axis=0) for z in (x, y))
    most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return most >= least_overlap(n, m)


def _sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = [_may_link(*row) for row in zip(batch["n"].tolist(), batch["m"].tolist(), batch["left"], batch["right"], strict=True)]
        yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]


PROFILE = "doc_id bigint, n_shingles bigint, high bigint, low bigint, tokens binary, salts binary, signature binary, centrality int"


def profiles(spark: SparkSession, docs: DataFrame, order: Order) -> DataFrame:
    """One row per document: its set's size and digest and, for the first of a set in its task, the prefix.

    salts has the logarithm of the number of groups of each of the prefix's tokens.
    """
    shared = spark.sparkContext.broadcast(order)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        for batch in batches:
            ids, at = batch.column(0), 0
            for n, shingles in shingle_sets(strings(batch.column(1))):
                own = ids.slice(at, len(n))
                at += len(n)
                starts = np.cumsum(n) - n
                high, low = _digests(n, shingles)
                frequency = order.logs[_buckets(shingles)]
                tokens = _tokens(shingles, frequency)
                central = np.zeros(len(n), dtype=np.int32)
                full = np.flatnonzero(n)
                if len(full):
                    central[full] = np.add.reduceat(frequency.astype(np.int64), starts[full]) // n[full] // 4
                if len(seen) > SEEN:
                    seen.clear()
                made: list[tuple[bytes | None, ...]] = []  # tokens, salts and signature of each row
                for doc, size, start, key in zip(own.to_pylist(), n.tolist(), starts.tolist(), zip(high.tolist(), low.tolist(), strict=True), strict=True):
                    if not size or doc is None or key in seen:
                        made.append((None, None, None))
                    else:
                        seen.add(key)
                        prefix = np.sort(tokens[start : start + size])[: prefix_length(size)]
                        made.append((prefix.tobytes(), order.salts(prefix).astype(np.uint8).tobytes(), _signature(shingles[start : start + size])))
                columns = [own, pa.array(n), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), *(pa.array(c, pa.binary()) for c in zip(*made, strict=True)), pa.array(central)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "high", "low", "tokens", "salts", "signature", "centrality"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(profile, PROFILE)


#: The key of a row that shares its doc_id with other sets; else the doc_id is the key.
_OWN_KEY = "xxhash64(doc_id, high, low)"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, info): a row per prefix shingle. key is the token, or for salted ones its group."""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(5)]
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0
        for doc, n, packed, salts, central in zip(*columns, strict=True):
            tokens, salt = np.frombuffer(packed, dtype=np.uint64), np.frombuffer(salts, dtype=np.uint8).astype(np.int64)
            group = _salted(tokens, doc, salt)
            info = (salt << 58) | (min(63, central) << 52) | (min(n, LARGEST) << FIELD) | np.minimum(np.arange(len(tokens)), LARGEST)
            parts.append((group.view(np.int64), np.full(len(tokens), doc), info))
            size += len(tokens)
            if size > 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["key", "doc_id", "info"])
                parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["key", "doc_id", "info"])


def _salted(tokens: np.ndarray, doc: int, salt: np.ndarray) -> np.ndarray:
    """The group of each token's list to which doc belongs: an involution, so it undoes itself."""
    if not salt.any():
        return tokens
    own = mix(np.array([doc & (2**64 - 1)], dtype=np.uint64))[0]
    part = own & ((np.uint64(1) << salt.astype(np.uint64)) - np.uint64(1))
    return np.where(salt > 0, tokens ^ mix(part + np.uint64(1)), tokens)


_FIELDS = ("shiftright(info, 52) & 63 as central", f"shiftright(info, {FIELD}) & {LARGEST} as n", f"info & {LARGEST} as pos", "shiftright(info, 58) & 31 as salt")


@F.pandas_udf(LongType())
def _unsalted(key: pd.Series, doc: pd.Series, salt: pd.Series) -> pd.Series:
    tokens, out = key.to_numpy(np.int64).view(np.uint64), key.to_numpy(np.int64).copy()
    for i in np.flatnonzero(salt.to_numpy() > 0):
        out[i] = _salted(tokens[i : i + 1], int(doc.iloc[i]), salt.to_numpy()[i : i + 1])[0].astype(np.int64)
    return pd.Series(out)


def _with_heads(entries: DataFrame, key: str) -> DataFrame:
    """The entries of lists of two and more, each with its list's head: the most central, then the smallest id."""
    rank = "struct(-central as central, doc_id as doc, n as n, pos as pos)"
    return entries.selectExpr("*", f"min({rank}) over (partition by {key}) as head", f"count(1) over (partition by {key}) as members")


def _star(entries: DataFrame) -> DataFrame:
    """(a, b): distinct pairs of a head and another entry that pass the length and positional filters."""
    least = f"({OVER} * (n + head.n) + {OVER + UNDER - 1}) div {OVER + UNDER}"
    bound = "least(pos, head.pos) + 1 + least(n - pos - 1, head.n - head.pos - 1)"
    return (
        entries.where("doc_id <> head.doc")
        .where(f"({UNDER} * least(n, head.n) >= {OVER} * greatest(n, head.n) and {bound} >= {least}) or greatest(n, head.n) = {LARGEST}")
        .selectExpr("least(doc_id, head.doc) as a", "greatest(doc_id, head.doc) as b")
        .distinct()
    )


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids (doc_id, distinct).

    A bitmap of at most 2^26 bits, one for each hash of an id, is filled by Spark and passes over the scan
    first, so most texts never reach the shuffle of the join; the join alone decides.
    """
    n = ids.count()
    bits = 1 << min(26, max(12, (32 * n).bit_length()))
    place = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(bits))
    words = ids.select(place.alias("p")).selectExpr("shiftright(p, 6) as w", "shiftleft(1L, cast(p & 63 as int)) as b").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(bits // 64, dtype=np.int64)
    table[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def maybe(p: pd.Series) -> pd.Series:
        at = p.fillna(0).to_numpy(dtype=np.int64)
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return docs.where(F.col("doc_id").isNotNull()).where(maybe(place)).join(ids, "doc_id", "left_semi")


@dataclasses.dataclass(frozen=True)
class Texts:
    """docs (doc_id, text) and, of rows that share a doc_id with other sets, doc_id and key, distinct; None if there are none.

    unique: no doc_id comes twice.  signatures: (doc_id, n, signature) by key.
    """

    docs: DataFrame
    shared: DataFrame | None
    unique: bool
    signatures: DataFrame

    def once(self, rows: DataFrame) -> DataFrame:
        return rows if self.unique else rows.dropDuplicates(["doc_id"])

    def sets(self, keys: DataFrame) -> DataFrame:
        """(doc_id, shingles): the sorted set of each row whose key is in keys (doc_id, distinct), as raw 64-bit values."""

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for n, shingles in shingle_sets(strings(batch.column(1))):
                    cuts = np.append(0, np.cumsum(n)).tolist()
                    sets = [shingles[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                    high, low = _digests(n, shingles)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(sets, pa.binary())], ["doc_id", "high", "low", "shingles"])
                    at += len(n)

        docs = self.docs.select(F.col("doc_id").cast("bigint"), "text")
        schema = "doc_id bigint, high bigint, low bigint, shingles binary"
        if self.shared is None:
            return self.once(_only(docs, keys).mapInArrow(of, schema).select("doc_id", "shingles"))
        named = keys.withColumnRenamed("doc_id", "key").join(self.shared.select("key", F.col("doc_id").alias("of")), "key", "left")
        wanted = named.select(F.coalesce("of", "key").alias("doc_id"), F.col("of").isNotNull().alias("is_shared")).distinct()
        found = _only(docs, wanted.select("doc_id")).mapInArrow(of, schema).join(wanted, "doc_id")
        by_key = found.select(F.when(F.col("is_shared"), F.expr(_OWN_KEY)).otherwise(F.col("doc_id")).alias("doc_id"), "shingles")
        return by_key.join(keys, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _suffix_bound(x: np.ndarray, y: np.ndarray) -> int:
    """At most so many common values: what each of some equal hash ranges can hold of both."""
    cuts = (np.arange(1, RANGES, dtype=np.uint64) << np.uint64(64 - RANGES.bit_length() + 1)).astype(np.uint64)
    a, b = (np.diff(np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]])) for s in (x, y))
    return int(np.minimum(a, b).sum())


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for left, right in zip(batch["left"], batch["right"], strict=True):
            x, y = np.frombuffer(left, dtype=np.uint64), np.frombuffer(right, dtype=np.uint64)
            least = least_overlap(len(x), len(y))
            ok = min(len(x), len(y)) >= least and _suffix_bound(x, y) >= least
            keep.append(ok and bool(_linked(np.intersect1d(x, y, assume_unique=True).size, len(x), len(y))))
        yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]


def _list_pairs(few: int):
    """Of each list, the pairs of different components that pass the filters: (a, b, null).

    A list with more than few of them for each member is named instead: (null, null, token).  The head has met
    all others already.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray]] = []
            crowded: list[int] = []
            flat = batch.column(2).flatten()
            fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "component", "n", "pos")]
            cuts = np.append(0, np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False)))
            for token, head, start, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                doc, of, n, pos = (x[start:end] for x in fields)
                rest = doc != head
                doc, of, n, pos = doc[rest], of[rest], n[rest], pos[rest]
                found, total = [], 0
                for at in range(0, len(doc), 256):
                    i = slice(at, at + 256)
                    less, more = np.minimum(n[i, None], n[None]), np.maximum(n[i, None], n[None])
                    bound = np.minimum(pos[i, None], pos[None]) + 1 + np.minimum((n - pos)[i, None], (n - pos)[None]) - 1
                    least = (OVER * (n[i, None] + n[None]) + OVER + UNDER - 1) // (OVER + UNDER)
                    near = ((UNDER * less >= OVER * more) & (bound >= least)) | (more == LARGEST)
                    near &= (of[i, None] != of[None]) & (doc[i, None] < doc[None])
                    x, y = np.nonzero(near)
                    found.append((doc[i][x], doc[y]))
                    total += len(x)
                    if total > few * len(doc):
                        break
                if total > few * len(doc):
                    crowded.append(token)
                elif total:
                    out.extend(found)
            if out:
                a, b = np.unique(np.stack([np.concatenate(side) for side in zip(*out, strict=True)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "token"])
            if crowded:
                none = pa.nulls(len(crowded), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(crowded, pa.int64())], ["a", "b", "token"])

    return pairs


def _tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links across components between the documents of two blocks, or within one."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            left, right = row.left, row.right
            sides = [([np.frombuffer(m["shingles"], dtype=np.uint64) for m in side], np.array([m["doc_id"] for m in side]), np.array([m["component"] for m in side])) for side in (left, right)]
            (xs, x_ids, x_of), (ys, y_ids, y_of) = sides
            m = np.array([len(y) for y in ys])[None, :]
            # Blocks of small sets have many of them: their products are made and read in strips.
            height = max(1, STRIP // len(ys))
            for start in range(0, len(xs), height):
                strip = slice(start, start + height)
                n = np.array([len(x) for x in xs[strip]])[:, None]
                i, j = np.nonzero(_linked(_products(xs[strip], ys), n, m) & (x_of[strip, None] != y_of[None, :]))
                if len(i):
                    yield pd.DataFrame({"a": x_ids[strip][i], "b": y_ids[j]})


def _products(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all xs with all ys: incidence matrices over shared shingles, multiplied in strips."""
    flat_x, flat_y = np.concatenate(xs), np.concatenate(ys)
    shared = np.intersect1d(flat_x, flat_y)
    out = np.zeros((len(xs), len(ys)), dtype=np.float32)
    where = []
    for sets, flat in ((xs, flat_x), (ys, flat_y)):
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(shared, flat)
        hit = (at < len(shared)) & (shared[np.minimum(at, max(0, len(shared) - 1))] == flat) if len(shared) else np.zeros(len(flat), dtype=bool)
        where.append((rows[hit], at[hit]))
    for start in range(0, len(shared), width):
        strips = []
        for sets, (rows, at) in zip((xs, ys), where, strict=True):
            own = (at >= start) & (at < start + width)
            strip = np.zeros((len(sets), min(width, len(shared) - start)), dtype=np.float32)
            strip[rows[own], at[own] - start] = 1
            strips.append(strip)
        out += strips[0] @ strips[1].T
    return out.round().astype(np.int64)


def _verified(texts: Texts, pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) that are links."""
    ids = scratch.write(pairs.selectExpr("explode(array(a, b)) as doc_id").distinct(), f"{name}-all-ids")
    known = scratch.write(texts.once(_only(texts.signatures, ids)), f"{name}-signatures")
    left, right = known.selectExpr("doc_id as a", "n", "signature as left"), known.selectExpr("doc_id as b", "n as m", "signature as right")
    pairs = scratch.write(pairs.join(left, "a").join(right, "b").mapInPandas(_sift, "a bigint, b bigint"), f"{name}-sifted")
    ids = scratch.write(pairs.selectExpr("explode(array(a, b)) as doc_id").distinct(), f"{name}-ids")
    sets = scratch.write(texts.sets(ids), f"{name}-sets")
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    with BatchRows(scratch.spark, 128):
        links = scratch.write(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInPandas(_verify, "a bigint, b bigint"), f"{name}-links")
    scratch.drop(*(f"{name}-{x}" for x in ("sets", "ids", "all-ids", "signatures", "sifted")))
    return links


def _small(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def join(spark: SparkSession, docs: DataFrame, scratch: Scratch, hot: int = HOT, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs (doc_id, text)."""
    with BatchBytes(spark, BATCH_BYTES), BatchRows(spark, ROWS):
        return _join(spark, docs, scratch, hot, few, block)


def _join(spark: SparkSession, docs: DataFrame, scratch: Scratch, hot: int, few: int, block: int) -> DataFrame:
    profile = scratch.write(profiles(spark, docs, frequency_order(docs, hot)), "profiles")
    sizes = scratch.write(profile.select("doc_id", "high", "low", "n_shingles"), "sizes")
    again = sizes.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("high", "low")).alias("a"), F.max(F.struct("high", "low")).alias("b")).where("rows > 1")
    again = scratch.write(again.selectExpr("doc_id", "a <> b as differ"), "again")
    shared = scratch.write(sizes.join(again.where("differ"), "doc_id", "left_semi").selectExpr("doc_id", f"{_OWN_KEY} as key").distinct(), "shared")
    several = not shared.isEmpty()

    def keyed(rows: DataFrame) -> DataFrame:
        """Rows with their key as doc_id."""
        if not several:
            return rows
        found = rows.join(shared.select("doc_id").distinct().withColumn("is_shared", F.lit(True)), "doc_id", "left")
        return found.withColumn("doc_id", F.when(F.col("is_shared"), F.expr(_OWN_KEY)).otherwise(F.col("doc_id"))).select(*rows.columns)

    signatures = keyed(profile.where("tokens is not null")).selectExpr("doc_id", "n_shingles as n", "signature")
    texts = Texts(docs, shared if several else None, again.isEmpty(), signatures)

    digest = keyed(sizes.where("n_shingles > 0 and doc_id is not null"))
    first = digest.groupBy("high", "low", "n_shingles").agg(F.min("doc_id").alias("v"))
    copies = digest.join(first, ["high", "low", "n_shingles"]).where("doc_id <> v").select(F.col("doc_id").alias("u"), "v")

    prefixes = keyed(profile.where("tokens is not null")).select("doc_id", "n_shingles", "tokens", "salts", "centrality")
    entries = prefixes.mapInArrow(_entries, "key bigint, doc_id bigint, info bigint")
    lists = _with_heads(entries.selectExpr("key", "doc_id", *_FIELDS), "key").where("members > 1 or salt > 0")
    lists = lists.withColumn("token", F.when(F.col("salt") > 0, _unsalted("key", "doc_id", "salt")).otherwise(F.col("key")))
    lists = scratch.write(lists.select("token", "doc_id", "central", "n", "pos", "salt", "head"), "lists")
    # Heads of the groups of a salted list meet by its token.
    heads = lists.where("salt > 0 and doc_id = head.doc").select("token", "doc_id", "central", "n", "pos", "salt")
    pairs = scratch.write(_star(lists).unionByName(_star(_with_heads(heads, "token"))).distinct(), "pairs")
    links = _verified(texts, pairs, scratch, "star")
    edges = copies.unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    if several:
        edges = edges.unionByName(shared.select(F.col("key").alias("u"), F.col("doc_id").alias("v")))
    stars = scratch.write(components(edges, scratch, "stars"), "components")

    owned = lists.select("token", "doc_id", "central", "n", "pos", "salt", F.col("head.doc").alias("head")).join(_small(stars), F.col("doc_id") == F.col("node"), "left")
    owned = scratch.write(owned.select("token", "doc_id", "central", "n", "pos", "salt", "head", F.coalesce("component", "doc_id").alias("component")), "owned")
    scratch.drop("lists")
    # A list that isn't salted has about hot members at most.
    rest = F.when(F.col("doc_id") != F.col("head"), F.col("component"))
    gathered = owned.where("salt = 0").groupBy("token").agg(F.first("head").alias("head"), F.min(rest).alias("low"), F.max(rest).alias("high"), F.collect_list(F.struct("doc_id", "component", "n", "pos")).alias("members"))
    with BatchRows(spark, 128):
        found = scratch.write(gathered.where("low <> high").select("token", "head", "members").mapInArrow(_list_pairs(few), "a bigint, b bigint, token bigint"), "found")
    unmet = scratch.write(found.where("a is not null").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "unmet")
    more = _verified(texts, unmet, scratch, "more")
    scratch.drop("profiles")
    crowded = scratch.write(found.where("token is not null").select("token").unionByName(owned.where("salt > 0").select("token")).distinct(), "crowded-tokens")
    last = _across(texts, owned.join(_small(crowded), "token", "left_semi"), scratch, block)
    joined = stars.selectExpr("node as u", "component as v").unionByName(more.unionByName(last).select(F.col("a").alias("u"), F.col("b").alias("v")))
    ends = components(joined, scratch, "ends")
    scratch.drop("owned", "found", "pairs", "unmet")
    if several:
        # Keys aren't ids: a component's id is the least doc_id of its rows.
        ends = scratch.write(ends, "ends-by-key")
        least = ends.join(shared.select("key"), ends["node"] == F.col("key"), "left_anti").groupBy("component").agg(F.min("node").alias("least"))
        ends = ends.join(least, "component").select("node", F.col("least").alias("component"))
    return sizes.join(ends, sizes["doc_id"] == ends["node"], "left").select(sizes["doc_id"], "n_shingles", F.coalesce("component", sizes["doc_id"]).alias("component_id"))


def _across(texts: Texts, lists: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """(a, b): all links between documents of different components in each of some lists, however long."""
    lists = scratch.write(lists, "crowded")
    if lists.isEmpty():
        return scratch.spark.createDataFrame([], "a bigint, b bigint")
    open_lists = lists.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.struct("central", (-F.col("doc_id")).alias("doc"))).alias("head")).where("low <> high")
    # A bundle: all documents of the open lists with one head.
    members = lists.join(open_lists.select("token", (-F.col("head.doc")).alias("bundle")), "token").groupBy("bundle", "doc_id").agg(F.first("component").alias("component"), F.first("n").alias("n"))
    members = scratch.write(members, "members")
    main = members.groupBy("bundle", "component").agg(F.sum("n").alias("n")).groupBy("bundle").agg(F.max(F.struct("n", "component")).alias("main"))
    # Documents of the largest component only meet those of the rest.  Sets that link are of the same class or successive ones.
    classes = members.join(main, "bundle").selectExpr("bundle", "doc_id", "component", "n", "component = main.component as is_main", f"cast(floor(ln(n) / ln({UNDER} / {OVER})) as int) as class")
    group = ["bundle", "is_main", "class"]
    parts = classes.groupBy(*group).agg(F.expr(f"cast(ceil(sum(n) / {block}) as bigint)").alias("parts"))
    dealt = classes.join(parts, group).selectExpr(*group, "doc_id", "component", "n", "pmod(xxhash64(doc_id), parts) as part")
    ids = scratch.write(members.select("doc_id").distinct(), "member-ids")
    blocks = dealt.join(scratch.write(texts.sets(ids), "member-sets"), "doc_id").groupBy(*group, "part").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.collect_list(F.struct("doc_id", "component", "shingles")).alias("members"))
    blocks = scratch.write(blocks, "blocks")
    left = blocks.where("not is_main").selectExpr("bundle", "class as i", "part as x", "low as l", "high as h", "members as left")
    right = blocks.selectExpr("bundle", "is_main", "class as j", "part as y", "low", "high", "members as right", "explode(array(class - 1, class, class + 1)) as i")
    near = f"(is_main or struct(j, y) <= struct(i, x)) and ({UNDER} * h >= {OVER} * low and {UNDER} * high >= {OVER} * l or greatest(h, high) = {LARGEST})"
    tiles = left.join(right, ["bundle", "i"]).where(near).select("left", "right")
    with BatchRows(scratch.spark, 4):
        more = scratch.write(tiles.mapInPandas(_tile, "a bigint, b bigint").distinct(), "more")
    scratch.drop("blocks", "member-sets", "member-ids", "members", "crowded")
    return more
