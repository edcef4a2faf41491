"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training is one pass that counts, in numpy inside each task, how often each language uses each hash bucket;
Spark sums the counts by (language, bucket).  The log-probability matrix (buckets x languages) has a bounded
size whatever the corpus, so it is broadcast; scoring multiplies the sparse bucket counts of many texts with it.

Nulls and edge cases: a null text, or one without a letter, gets `und` with score 0; so does every text if no
labelled row exists.  Rows with a null label teach nothing.  Texts of any length are read whole, in pieces
that carry their last characters over, so memory does not grow with the length.  Equal posteriors go to the
smaller language name.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
#: log2 of the most buckets; fewer are used for many languages, so that the matrix has at most MATRIX cells.
BUCKET_BITS, MATRIX = 15, 1 << 22
#: Texts are turned into code points this many characters at a time.
PIECE = 1 << 20
#: Training rows wanted for each language; languages with more are thinned by a hash of the text.
TRAIN_ROWS = 4000

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)


@cache
def _letters() -> np.ndarray:
    """True for code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def gram_buckets(text: str, bits: int) -> Iterator[np.ndarray]:
    """Hash buckets of all n-grams of the whole text, piece by piece; nothing for a text without letters.

    Letters are lower-cased; each run of other characters counts as one space.
    """
    letters, carry = _letters(), np.array([32], dtype=np.uint32)
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = np.where(letters[codes], codes, np.uint32(32)).astype(np.uint32)
        symbols = np.concatenate([carry, codes])
        keep = np.ones(len(symbols), dtype=bool)
        keep[len(carry) :] = (symbols[len(carry) :] != 32) | (symbols[len(carry) - 1 : -1] != 32)
        symbols = symbols[keep]
        if len(symbols) > len(carry) and (symbols != 32).any():
            shift = np.uint32(32 - bits)
            for n in ORDERS:
                first = max(0, len(carry) - n + 1)
                size = len(symbols) - n + 1 - first
                if size > 0:
                    mixed = np.full(size, n, dtype=np.uint32)
                    for k in range(n):
                        mixed = (mixed ^ symbols[first + k : first + k + size]) * _MULTIPLIERS[k]
                        mixed ^= mixed >> np.uint32(15)
                    yield (mixed * _MULTIPLIERS[0]) >> shift
        carry = symbols[-(max(ORDERS) - 1) :]


#: Bucket counts that are scored together.
SCORED = 1 << 17


def sparse_counts(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text in order, and how often each occurs; both empty for a text without letters."""
    counts = _bucket_counts(text, bits) if text else None
    used = np.zeros(0, dtype=np.int64) if counts is None else np.flatnonzero(counts)
    return used, np.zeros(0) if counts is None else counts[used].astype(np.float64)


def _bucket_counts(text: str, bits: int) -> np.ndarray | None:
    counts = None
    for buckets in gram_buckets(text, bits):
        found = np.bincount(buckets, minlength=1 << bits)
        counts = found if counts is None else counts + found
    return counts


@dataclasses.dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    bits: int
    log_prior: np.ndarray
    log_probability: np.ndarray  # buckets x languages

    def score(self, texts: Iterable[str | None]) -> pd.DataFrame:
        """lang_pred and score of each text: sparse rows of counts times the matrix, SCORED counts at a time."""
        names, scores = [], []
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> None:
            nonlocal rows, held
            known = np.flatnonzero([len(used) > 0 for used, _ in rows]) if self.languages else np.zeros(0, dtype=np.int64)
            best, chance = np.full(len(rows), -1), np.zeros(len(rows))
            if len(known):
                sizes = np.array([len(rows[i][0]) for i in known])
                used, counts = (np.concatenate([rows[i][k] for i in known]) for k in (0, 1))
                terms = self.log_probability[used]
                terms *= counts[:, None]
                joint = self.log_prior + np.add.reduceat(terms, np.cumsum(sizes) - sizes, axis=0)
                best[known] = joint.argmax(axis=1)
                chance[known] = 1.0 / np.exp(joint - joint.max(axis=1, keepdims=True)).sum(axis=1)
            names.extend(self.languages[b] if b >= 0 else UNDETERMINED for b in best)
            scores.extend(chance.tolist())
            rows, held = [], 0

        for text in texts:
            rows.append(sparse_counts(text, self.bits))
            held += len(rows[-1][0])
            if held >= SCORED or len(rows) >= SCORED:
                flush()
        flush()
        return pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=np.float64)})


def train(rows: DataFrame, text: str = "text", label: str = "lang", rows_per_language: int = TRAIN_ROWS, smoothing: float = 0.5) -> LanguageModel:
    """Fits on the labelled rows.

    rows_per_language bounds the sample: of a language with more rows, those whose hash falls below
    rows_per_language / rows are used.  The rest is not read into Python.
    """
    usable = rows.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).where("text is not null and label is not null")
    sizes = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel([], BUCKET_BITS, np.zeros(0), np.zeros((1 << BUCKET_BITS, 0)))
    languages = sorted(sizes)
    bits = min(BUCKET_BITS, max(8, (MATRIX // len(languages)).bit_length() - 1))
    scale = 1 << 30
    thinned = {k: round(scale * rows_per_language / n) for k, n in sizes.items() if n > rows_per_language}
    if thinned:
        limits = F.create_map(*[F.lit(x) for pair in thinned.items() for x in pair])
        limit = F.coalesce(F.try_element_at(limits, F.col("label")), F.lit(scale))
        usable = usable.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(scale)) < limit)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, k in zip(batch["text"], batch["label"], strict=True):
                if (counts := _bucket_counts(t, bits)) is not None:
                    sums[k] = sums[k] + counts if k in sums else counts
        for k, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pd.DataFrame({"label": k, "bucket": used.astype(np.int32), "n": counts[used]})

    counted = usable.mapInPandas(count, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.zeros((1 << bits, len(languages)))
    matrix[counted["bucket"], pd.Categorical(counted["label"], languages).codes] = counted["n"]
    log_probability = np.log(matrix + smoothing) - np.log(matrix.sum(axis=0) + smoothing * (1 << bits))
    prior = np.array([sizes[k] for k in languages], dtype=np.float64)
    return LanguageModel(languages, bits, np.log(prior / prior.sum()), log_probability)


def identify(spark: SparkSession, docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "language") -> DataFrame:
    """docs with one more column, a struct (lang_pred string, score double)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            yield own.score(texts)

    return docs.withColumn(into, predict(F.col(text)))
