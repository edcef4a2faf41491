"""Spelling variants: words within one edit, found by bands of letter-parity bitmasks.

1. Tasks take the words of whole texts and count them; a task sends each word with its count when it knows MANY of them, and
   partial sums meet by word.
2. A word's mask has a bit for each letter: whether the letter comes an odd number of times.  One inserted or deleted code
   point flips one bit and a replaced one at most two, so of three bands of the mask one is equal in both words.
3. Words meet by (band, its bits, length): of equal length, or longer by one.  A pair counts in the first band that both share, if
   the masks differ in at most two bits and the edit distance is 1.  The join itself decides that, so no candidate leaves it.
4. A list of more than CROWDED words is met by halves too: what one edit leaves equal is the half before it or the half behind it.
   So a list as long as a third of the vocabulary is as many small lists, and no pair is lost.
5. A word's form is its best near word; roots follow forms by pointer doubling: n at least doubles with each form, so chains are
   as short as the logarithm of the largest n.

Nulls and edge cases: a null or empty text has no word, and a null doc_id is written as the empty text in front of the colon.
Texts of any length are read in pieces that end between runs.  Rows that repeat a doc_id and text count each.  No word near a
word: n_near 0, form and form_n null, root the word itself.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, strings

RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Characters read at a time, and the distinct words that a task remembers.
PIECE, MANY = 1 << 20, 100_000
SHORTEST, LEAST, ODD = 5, 3, 97
#: Words in a list of a band from which its pairs meet by halves as well.
CROWDED = 256
#: Bits of a mask, a code point's bit being its remainder; a band is every third bit, so that common letters are spread over the bands.
BITS, BANDS = 90, 3
#: The most lists that are broadcast; more are joined by a shuffle.
SMALL = 1 << 20


def runs(text: str) -> Iterator[list[str]]:
    """The runs of a text, A-Z lower-cased, in pieces."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and RUN.match(text[end].translate(_LOWER)):  # a run isn't cut
            end += 1
        # bytes.lower changes A-Z only.
        yield RUN.findall(text[at:end].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
        at = end


def misspelt(run: str, code: int) -> str:
    """The run as op13 takes it: without one code point if ODD divides its code."""
    if code % ODD:
        return run
    at = code % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return batch

    for batch in batches:
        at = 0
        for text in strings(batch.column(1)):
            doc, at = batch.column(0)[at].as_py(), at + 1
            seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for piece in runs(text or ""):
                for run, n in Counter(piece).items():
                    word = misspelt(run, zlib.crc32(run.encode(), seed))
                    if len(word) >= SHORTEST:
                        total[word] += n
            if len(total) > MANY:
                yield flush()
    yield flush()


def words(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n) of the words that come least times or more."""
    counted = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def band(word: str, k: int) -> Column:
    """Every BANDS-th bit of the word's parity mask, from the k-th on."""
    flipped = f"if(ascii(c) % {BITS} % {BANDS} = {k} and c <> '', shiftleft(1, cast(ascii(c) % {BITS} div {BANDS} as int)), 0)"
    return F.expr(f"aggregate(split({word}, ''), 0, (mask, c) -> mask ^ {flipped})")


_LIST = ["band", "bits", "size", "longer"]


def _listed(known: DataFrame, role: str) -> DataFrame:
    """A row for each list that a word is in.  size is the shorter word's length; longer: how much longer the other is.

    role: "a" for the shorter (or, of equal ones, the smaller) word of a pair, "b" for the other.
    """
    masks = F.array(*[F.struct(F.lit(k).alias("band"), F.col(f"m{k}").alias("bits")) for k in range(BANDS)])
    rows = known.withColumn("at", F.explode(masks)).withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1))))
    size = F.length("word") - (F.col("longer") if role == "b" else 0)
    return rows.select("at.*", size.alias("size"), "longer", "word", "n", *[f"m{k}" for k in range(BANDS)])


def _crowded(known: DataFrame, most: int) -> DataFrame:
    """The lists one side of which has more than so many words."""
    masks = F.array(*[F.struct(F.lit(k).alias("band"), F.col(f"m{k}").alias("bits")) for k in range(BANDS)])
    full = known.select(F.explode(masks).alias("at"), F.length("word").alias("size")).groupBy("at.band", "at.bits", "size").count().where(F.col("count") > most)
    both = full.select("band", "bits", F.explode(F.array(F.struct("size", F.lit(0).alias("longer")), F.struct("size", F.lit(1).alias("longer")), F.struct((F.col("size") - 1).alias("size"), F.lit(1).alias("longer")))).alias("of"))
    return both.select("band", "bits", "of.size", "of.longer").distinct()


def _halves(rows: DataFrame, crowded: DataFrame, role: str) -> DataFrame:
    """half: empty, or in crowded lists what an edit may leave equal: the first half, or the second one."""
    middle, skipped = F.floor(F.col("size") / 2).cast("int"), F.col("longer") if role == "b" else F.lit(0)
    first = F.substring(F.col("word"), F.lit(1), middle)
    second = F.substring(F.col("word"), middle + skipped + 1, F.length("word"))
    halves = F.array(F.concat(F.lit("<"), first), F.concat(F.lit(">"), second))
    rows = rows.join(crowded.withColumn("crowded", F.lit(True)), _LIST, "left")
    return rows.withColumn("half", F.explode(F.when(F.col("crowded"), halves).otherwise(F.array(F.lit(""))))).withColumn("first", first).drop("crowded")


def near_pairs(known: DataFrame, scratch: Scratch, crowded: int = CROWDED) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words (word, n) that differ by one inserted, deleted or replaced code point, once."""
    masked = scratch.write(known.select("word", "n", *[band("word", k).alias(f"m{k}") for k in range(BANDS)]), "masks")
    lists = scratch.write(_crowded(masked, crowded), "crowded")
    lists = F.broadcast(lists) if lists.count() <= SMALL else lists
    key = [*_LIST, "half"]
    left, right = (
        _halves(_listed(masked, role), lists, role).select(*key, *[F.col(c).alias(f"{role}_{c}") for c in ("word", "n", "first", *(f"m{k}" for k in range(BANDS)))]) for role in "ab"
    )
    # An equal band before this one, or an equal first half, has the pair already.
    earlier = " and ".join(f"(band <= {k} or a_m{k} <> b_m{k})" for k in range(BANDS - 1))
    flips = " + ".join(f"bit_count(a_m{k} ^ b_m{k})" for k in range(BANDS))
    near = f"(longer = 1 or a_word < b_word) and {earlier} and (left(half, 1) <> '>' or a_first <> b_first) and {flips} <= 2 and levenshtein(a_word, b_word, 1) = 1"
    return left.join(right.hint("shuffle_merge"), key).where(near).selectExpr("a_word as a", "a_n", "b_word as b", "b_n")


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of words that have a form (word, form): the end of their chain, by pointer doubling."""
    current, at = scratch.write(forms.selectExpr("word", "form as root"), "roots-0"), 0
    while True:
        ahead = current.selectExpr("word as root", "root as next")
        at += 1
        after = scratch.write(current.join(ahead, "root", "left").selectExpr("word", "coalesce(next, root) as root", "next is not null as moved"), f"roots-{at}")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        current = after.select("word", "root")


def variants(spark: SparkSession, docs: DataFrame, scratch: Scratch, crowded: int = CROWDED) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of docs (doc_id, text)."""
    known = scratch.write(words(docs), "words")
    pairs = scratch.write(near_pairs(known, scratch, crowded), "pairs")
    both = pairs.selectExpr("a as word", "b as near", "b_n as n").unionByName(pairs.selectExpr("b as word", "a as near", "a_n as n"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("order"), "near")).alias("best"))
    found = known.join(best, "word", "left").selectExpr("word", "n", "coalesce(n_near, 0L) as n_near", "if(-best.order >= 2 * n, best.near, null) as form", "if(-best.order >= 2 * n, -best.order, null) as form_n")
    found = scratch.write(found, "forms")
    scratch.drop("masks", "crowded", "pairs")
    roots = _roots(found.where("form is not null").select("word", "form"), scratch)
    return found.join(roots, "word", "left").selectExpr("word", "n", "n_near", "form", "form_n", "coalesce(root, word) as root")
