"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each whole text becomes a few statistics, computed once in numpy and written as a small table.  Random Fourier
features of the standardised statistics approximate a Gaussian kernel; every partition sums its part of the
normal equations, a two-level reduction adds the parts, and the driver solves one system of fixed size.  The
calibration is a pool-adjacent-violators fit over a fixed number of score bins, so nothing that reaches the
driver grows with the corpus.

Nulls and edge cases: a null text has the statistics of an empty one and gets a score too.  Labels that are
null or not 0 or 1 are ignored; repeated labels of one document are averaged.  Without labelled rows every
score is 0.5; with labels of one class only, the score is that class.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch

FEATURES, SEED, RIDGE, KERNEL_WIDTH, BINS, CLIP = 192, 20240607, 1e-3, 3.0, 1024, 6.0
_WHITE = np.array([9, 10, 11, 12, 13, 32])
_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_SENTENCE = np.array([ord(c) for c in ".,;:?'\"-()"])
_SYMBOL = np.array([ord(c) for c in "$%&*#@^~<>{}[]=+\\/_`"])
_PIPE, _BANG, _NEWLINE = ord("|"), ord("!"), 10
STATISTICS = 17


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text; no label, language, source or id takes part."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    seen = np.bincount(raw, minlength=256) if len(raw) else np.zeros(256, dtype=np.int64)
    size = max(1, len(raw))
    words = text.split()
    lines = [line for line in text.split("\n") if line]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    distinct = len(set(words))
    upper, lower = int(seen[_UPPER].sum()), int(seen[_LOWER].sum())
    return [
        np.log1p(len(words)),
        (size - int(seen[_WHITE].sum())) / n_words,
        upper / max(1, upper + lower),
        int(seen[_DIGIT].sum()) / size,
        int(seen[_SENTENCE].sum()) / size,
        np.log1p(1000.0 * int(seen[_SYMBOL].sum()) / size),
        np.log1p(1000.0 * int(seen[_PIPE]) / size),
        np.log1p(1000.0 * int(seen[_BANG]) / size),
        int(seen[_NEWLINE]) / n_words,
        int(seen[128:].sum()) / size,
        distinct / n_words,
        np.log1p(distinct) / np.log1p(n_words),
        len(set(lines)) / n_lines,
        np.log1p(n_words / n_lines),
        int(seen[ord(".")]) / n_words,
        int(seen[:9].sum() + seen[14:32].sum()) / size,
        (upper + lower) / size,
    ]


@dataclasses.dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # statistics x features
    phase: np.ndarray
    ridge: np.ndarray | None  # features + 1
    edges: np.ndarray  # raw scores
    values: np.ndarray  # their calibrated scores, not decreasing

    def features(self, stats: np.ndarray) -> np.ndarray:
        standard = np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)
        waves = np.sqrt(2.0 / self.weights.shape[1]) * np.cos(standard @ self.weights + self.phase)
        return np.hstack([waves, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.zeros(len(stats)) if self.ridge is None else self.features(stats) @ self.ridge

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.edges, self.values)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing weighted least squares fit: pool adjacent violators."""
    blocks: list[list[float]] = []
    for value, w in zip(y, weight, strict=True):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), value) for value, _, n in blocks]) if blocks else np.zeros(0)


def with_statistics(docs: DataFrame, text: str, into: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    return docs.withColumn(into, measure(F.col(text)))


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(-1, STATISTICS)


def _summed(parts: DataFrame, schema: str) -> tuple[np.ndarray, ...] | None:
    """Adds rows of raw double arrays: in 32 tasks, then 4, then on the driver. A row has a fixed size."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                arrays = [np.frombuffer(x, dtype=np.float64) for x in row]
                total = arrays if total is None else [a + b for a, b in zip(total, arrays, strict=True)]
        if total is not None:
            yield pd.DataFrame([[x.tobytes() for x in total]], columns=batch.columns)

    rows = parts.repartition(32).mapInPandas(add, schema).repartition(4).mapInPandas(add, schema).collect()
    return tuple(sum(np.frombuffer(r[i], dtype=np.float64) for r in rows) for i in range(len(rows[0]))) if rows else None


def fit(spark: SparkSession, labelled: DataFrame, stats: str = "stats", label: str = "label") -> QualityModel:
    """labelled: one row per labelled document, with its statistics and a label from 0 to 1."""
    rng = np.random.default_rng(SEED)
    labelled = labelled.select(F.col(stats).alias("stats"), F.col(label).cast("double").alias("label"))
    one = [f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(STATISTICS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    base = labelled.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("y"), *one).first()
    mean = np.array([base[f"m{i}"] or 0.0 for i in range(STATISTICS)])
    scale = np.array([base[f"s{i}"] if base[f"s{i}"] and base[f"s{i}"] > 1e-9 else 1.0 for i in range(STATISTICS)])
    weights = rng.standard_normal((STATISTICS, FEATURES)) / KERNEL_WIDTH
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    blank = QualityModel(mean, scale, weights, phase, None, np.array([0.0]), np.array([0.5 if base["y"] is None else base["y"]]))
    if not base["n"] or base["y"] in (0.0, 1.0):
        return blank
    shared = spark.sparkContext.broadcast(blank)

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            x, y = shared.value.features(_stack(batch["stats"])), batch["label"].to_numpy()
            gram += x.T @ x
            right += x.T @ y
        yield pd.DataFrame([[gram.tobytes(), right.tobytes()]], columns=["gram", "right"])

    gram, right = _summed(labelled.mapInPandas(normal, "gram binary, right binary"), "gram binary, right binary")
    system = gram.reshape(FEATURES + 1, -1) + RIDGE * base["n"] / FEATURES * np.diag([1.0] * FEATURES + [0.0])
    raw = dataclasses.replace(blank, ridge=np.linalg.solve(system, right))
    raw_shared = spark.sparkContext.broadcast(raw)

    @F.pandas_udf("int")
    def bin_of(s: pd.Series) -> pd.Series:
        return pd.Series(np.clip((raw_shared.value.raw(_stack(s)) + 0.5) * (BINS / 2), 0, BINS - 1).astype(np.int32))

    bins = labelled.select(bin_of("stats").alias("bin"), "label").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("y")).orderBy("bin").toPandas()
    edges = (bins["bin"].to_numpy() + 0.5) / (BINS / 2) - 0.5
    return dataclasses.replace(raw, edges=edges, values=np.clip(isotonic(bins["y"].to_numpy(), bins["n"].to_numpy()), 0.0, 1.0))


def score(spark: SparkSession, measured: DataFrame, model: QualityModel, stats: str = "stats", into: str = "score") -> DataFrame:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def apply(s: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(_stack(s)))

    return measured.withColumn(into, apply(F.col(stats)))


def clean_labels(labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, label): one row per labelled document."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.avg(label).alias("label"))


def measure_and_fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch, train: Column | None = None) -> tuple[DataFrame, QualityModel]:
    """Writes (doc_id, stats) of all docs once; fits on those of them that have a label and satisfy train."""
    measured = scratch.write(with_statistics(docs.select("doc_id", "text"), "text", "stats").select("doc_id", "stats"), "statistics")
    labelled = measured if train is None else measured.where(train)
    return measured, fit(spark, labelled.join(clean_labels(labels), "doc_id"))
