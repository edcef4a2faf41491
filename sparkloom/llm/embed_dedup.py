"""Embedding near-duplicates by PCA-ordered tiled comparison.

1. Rows with the same label and exactly the same vector become one row with a multiplicity; so the copies of one
   vector, however many, cost one comparison.
2. The principal axes of all unit vectors come from a summed dim x dim matrix.  Within a label, rows are cut by
   quantiles of their leading coordinate, and what is still too large is dealt by hash, into blocks of about
   BLOCK rows.  A block knows the range of its leading coordinates.
3. Two blocks meet only if their boxes are near enough for the threshold.  In such a tile the leading dimensions
   are multiplied first; a pair is dropped once its partial product plus the product of its two suffix norms
   stays below the threshold.  Survivors are decided by the cosine of the original vectors in double precision.
4. A tile returns how many links each row has, and links between the components that its blocks had inside, not
   the pairs themselves; components of these links are found by Spark joins.

Every row meets every other of its label unless a bound proves the pair too far apart, so no link is lost.

Nulls and edge cases: a null label, a null vec_id and vectors that are null, empty, zero, or hold null or
non-finite components link with nothing; such rows come back with n_links 0 and themselves as component (a null
vec_id with a null component and kept false).  Vectors of different lengths link with nothing.  Repeated vec_ids
are rows of their own in n_links and one node in the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch
from sparkloom.llm.components import components
from sparkloom.llm.vectors import BatchRows, as_doubles, matrix, unit, unpack, usable

THRESHOLD = 0.93
BLOCK = 1024
#: Quantile cuts within a label, and leading coordinates whose ranges a block keeps.
CUTS, BOX = 64, 8
#: Dimensions multiplied before each bound; pairs decided at a time.
STEP, PAIRS = 16, 1 << 15
_SLACK = 1e-9


def _gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, own in batch.groupby("dim"):
            x = unit(matrix(own["vec"], dim))
            sums[dim] = sums.get(dim, 0) + x.T @ x
    for dim, total in sums.items():
        yield pd.DataFrame({"dim": [dim], "gram": [total.tobytes()]})


def _add_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, gram in zip(batch["dim"], batch["gram"], strict=True):
            sums[dim] = sums.get(dim, 0) + np.frombuffer(gram)
    for dim, total in sums.items():
        yield pd.DataFrame({"dim": [dim], "gram": [total.tobytes()]})


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, the axes as columns, the one with most of the sum of squares first."""
    schema = "dim int, gram binary"
    parts = vectors.select("dim", "vec").mapInPandas(_gram, schema).repartition(8, "dim").mapInPandas(_add_grams, schema).toPandas()
    axes = {}
    for dim, own in parts.groupby("dim"):
        total = sum(np.frombuffer(g) for g in own["gram"]).reshape(dim, dim)
        axes[int(dim)] = np.linalg.eigh(total)[1][:, ::-1]
    return axes


class Tile:
    """Pairs of rows of x and y with a cosine of threshold or more; both are unit vectors."""

    def __init__(self, axes: np.ndarray, threshold: float):
        self.axes, self.threshold = axes, threshold

    def side(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        turned = x @ self.axes
        squares = np.cumsum((turned * turned)[:, ::-1], axis=1)[:, ::-1]
        return x, turned, np.sqrt(np.hstack([squares, np.zeros((len(x), 1))]))

    def pairs(self, left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
        (x, px, sx), (y, py, sy) = left, right
        least, dim = self.threshold - _SLACK, x.shape[1]
        first = min(STEP, dim)
        partial = px[:, :first] @ py[:, :first].T
        i, j = np.nonzero(partial + sx[:, first, None] * sy[None, :, first] >= least)
        if len(i) > partial.size // 8:
            # A dense tile: no bound saves work there.
            return np.nonzero(x @ y.T >= self.threshold)
        partial = partial[i, j]
        for start in range(first, dim, STEP):
            end = min(start + STEP, dim)
            partial = np.concatenate([partial[:0]] + [partial[k : k + PAIRS] + np.einsum("ij,ij->i", px[i[k : k + PAIRS], start:end], py[j[k : k + PAIRS], start:end]) for k in range(0, len(i), PAIRS)])
            near = partial + sx[i, end] * sy[j, end] >= least
            i, j, partial = i[near], j[near], partial[near]
        keep = [np.einsum("ij,ij->i", x[i[k : k + PAIRS]], y[j[k : k + PAIRS]]) >= self.threshold for k in range(0, len(i), PAIRS)]
        keep = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
        return i[keep], j[keep]


def _least_ids(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each row the smallest id of its component under the links i-j."""
    label = ids.copy()
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (before == label).all():
            return label


_COUNTS = "d1 bigint, d2 bigint, label string, links bigint"


def link(spark: SparkSession, rows: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, id_column: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of rows."""
    vec = F.col("vec")
    keyed = rows.select(
        F.col(id_column).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"),
        F.when(usable(embedding) & F.col(label).isNotNull() & F.col(id_column).isNotNull(), as_doubles(embedding)).alias("vec"),
    ).withColumns({"d1": F.when(vec.isNotNull(), F.xxhash64(vec)), "d2": F.when(vec.isNotNull(), F.xxhash64(F.lit(7), vec))})
    reps = scratch.write(
        keyed.where("vec is not null").groupBy("label", "d1", "d2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")).withColumn("dim", F.size("vec")),
        "reps",
    )
    axes = spark.sparkContext.broadcast(principal_axes(reps))

    @F.pandas_udf("array<double>")
    def leading(vecs: pd.Series) -> pd.Series:
        return pd.Series([(unit(np.array([v]))[0] @ axes.value[len(v)][:, :BOX]).tolist() for v in vecs])

    placed = scratch.write(reps.withColumn("lead", leading("vec")), "placed")
    scratch.drop("reps")
    group = ["label", "dim"]
    cuts = placed.groupBy(*group).agg(F.percentile_approx(F.col("lead")[0], F.array(*[F.lit(k / CUTS) for k in range(1, CUTS)]), F.lit(2000)).alias("cuts"), F.least(F.lit(CUTS), F.ceil(F.count(F.lit(1)) / BLOCK)).alias("cells"))
    cut = F.size(F.filter("cuts", lambda c: c < F.col("lead")[0]))
    celled = placed.join(cuts, group).withColumn("cell", F.floor(cut * F.col("cells") / CUTS).cast("int")).drop("cuts", "cells")
    celled = scratch.write(celled, "celled")
    scratch.drop("placed")
    salts = celled.groupBy(*group, "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("salts"))
    dealt = celled.join(salts, [*group, "cell"]).withColumn("salt", F.pmod(F.xxhash64("d1", F.lit(3)), F.col("salts")).cast("int")).drop("salts")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        first, lead = pdf.iloc[0], np.array(pdf["lead"].tolist())
        x, ids, copies = unit(matrix(pdf["vec"], first["dim"])), pdf["id"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        tile = Tile(axes.value[int(first["dim"])], threshold)
        side = tile.side(x)
        i, j = tile.pairs(side, side)
        i, j = i[i != j], j[i != j]
        counts = np.bincount(i, weights=copies[j], minlength=len(x)).astype(np.int64) + copies - 1
        row = [first["label"], first["dim"], first["cell"] * (1 << 20) + first["salt"], lead.min(axis=0).tolist(), lead.max(axis=0).tolist()]
        packed = [pdf["d1"].to_numpy(np.int64), pdf["d2"].to_numpy(np.int64), ids, copies, _least_ids(ids, i, j), counts, x]
        return pd.DataFrame([[*row, *(a.tobytes() for a in packed)]], columns=["label", "dim", "block", "lo", "hi", "d1", "d2", "ids", "copies", "inner", "counts", "x"])

    schema = "label string, dim int, block bigint, lo array<double>, hi array<double>, d1 binary, d2 binary, ids binary, copies binary, inner binary, counts binary, x binary"
    blocks = scratch.write(dealt.groupBy(*group, "cell", "salt").applyInPandas(build, schema), "blocks")
    scratch.drop("celled")

    # The squared distance of two unit vectors with that cosine is at most 2 - 2 threshold.
    box = blocks.select(*group, "block", "lo", "hi")
    a, b = box.alias("a"), box.alias("b")
    gaps = F.zip_with(F.zip_with("a.lo", "b.hi", lambda p, q: p - q), F.zip_with("b.lo", "a.hi", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= 2 - 2 * threshold + 1e-6
    tiles = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim")) & (F.col("a.block") < F.col("b.block")) & near)
    tiles = scratch.write(tiles.select("a.label", "a.dim", F.col("a.block").alias("i"), F.col("b.block").alias("j")), "tiles")
    side = ["d1", "d2", "copies", "inner", "x"]
    left = blocks.select(*group, F.col("block").alias("i"), *[F.col(c).alias(f"l_{c}") for c in side])
    right = blocks.select(*group, F.col("block").alias("j"), *[F.col(c).alias(f"r_{c}") for c in side])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts of links by row (d1, d2, label, links), then links between inner components (d1, d2, null, null)."""
        for batch in batches:
            for row in batch.itertuples(index=False):
                tile = Tile(axes.value[row.dim], threshold)
                i, j = tile.pairs(tile.side(unpack(row.l_x, row.dim)), tile.side(unpack(row.r_x, row.dim)))
                if not len(i):
                    continue
                of = lambda packed: np.frombuffer(packed, dtype=np.int64)
                inner = np.unique(np.stack([of(row.l_inner)[i], of(row.r_inner)[j]]), axis=1)
                yield pd.DataFrame({"d1": inner[0], "d2": inner[1], "label": None, "links": None}).astype({"links": "Int64"})
                for own, k, other in (("l", i, of(row.r_copies)[j]), ("r", j, of(row.l_copies)[i])):
                    d1 = of(getattr(row, f"{own}_d1"))
                    counts = np.bincount(k, weights=other, minlength=len(d1)).astype(np.int64)
                    hit = np.flatnonzero(counts)
                    yield pd.DataFrame({"d1": d1[hit], "d2": of(getattr(row, f"{own}_d2"))[hit], "label": row.label, "links": counts[hit]}).astype({"links": "Int64"})

    with BatchRows(spark, 8):
        found = scratch.write(tiles.join(left, [*group, "i"]).join(right, [*group, "j"]).mapInPandas(compare, _COUNTS), "found")

        def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    d1, d2, ids, inner, counts = (np.frombuffer(x, dtype=np.int64) for x in (row.d1, row.d2, row.ids, row.inner, row.counts))
                    yield pd.DataFrame({"d1": d1, "d2": d2, "label": row.label, "links": counts, "id": ids, "inner": inner})

        own = scratch.write(blocks.select("label", "d1", "d2", "ids", "inner", "counts").mapInPandas(inside, f"{_COUNTS}, id bigint, inner bigint"), "inside")
    scratch.drop("blocks", "tiles")
    edges = found.where("links is null").select(F.col("d1").alias("u"), F.col("d2").alias("v")).unionByName(own.where("id <> inner").select(F.col("id").alias("u"), F.col("inner").alias("v")))
    ends = components(edges, scratch, "ends")
    links = found.where("links is not null").unionByName(own.select("d1", "d2", "label", "links")).groupBy("label", "d1", "d2").agg(F.sum("links").alias("links"))
    classes = links.join(own.select("label", "d1", "d2", "id"), ["label", "d1", "d2"]).join(ends, F.col("id") == F.col("node"), "left")
    classes = scratch.write(classes.select("label", "d1", "d2", "links", F.coalesce("component", "id").alias("component")), "classes")
    out = keyed.drop("vec").join(classes, ["label", "d1", "d2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
