"""Hard negatives of anchors by a pivot table.

1. Components become integers floor(SCALE * x); a score is an integer inner product.  Each vector gets one more component,
   sqrt(M - |x|^2) with M the largest |x|^2, and an anchor a zero, so that d^2 = |q|^2 + M - 2 score: a larger inner product is a
   smaller Euclidean distance.
2. Some rows of a bounded sample (FEWEST to MOST, by the root of all rows), each far from those before, are the pivots.  Every row stores its distances to all of them,
   lies in the cell of its nearest pivot, and is packed into blocks by cell and by hash of its label.  A directory (cells x
   LABELS rows) keeps the range of each pivot distance in a cell.
3. By the triangle inequality |d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p): stored distances bracket a score from both sides,
   first for a whole cell in the directory, then for each row.  What the bracket leaves is decided by the exact integer score.
4. Positives: an anchor meets the rows of its label in its own cell first; the k-th score found is what all other cells must
   reach.  Negatives: each (anchor, positive) asks for the best scores of other labels inside its window, again in the own
   cell first; other cells and rows must reach what is found there.  Blocks of anchors meet blocks of rows, dealt by both
   numbers, so a hot cell is many tasks; a block returns a few rows for each anchor or window.

Nulls and edge cases: rows whose vec_id or label is null, whose vector is null, or whose vector holds a component that is null or not
finite (once scaled) take no part; zero and empty vectors do, and their scores are 0.  Vectors are compared with those of their own
length.  An anchor never meets rows of its own vec_id; other rows that repeat an id count each.  Anchors that share a vec_id are
asked each for itself.  Equal scores go to the smaller vec_id.  A score outside a long counts as the nearest long.  An empty table
gives no rows; other columns of any name are not read.  Vectors of other lengths than the commonest are one cell without pivots,
which is compared whole.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch
from sparkloom.llm.vectors import BatchRows, matrix, unpack

SCALE, POSITIVES, NEGATIVES = 256.0, 5, 3
#: A negative's score lies between these percentages of the positive's.
FROM, TO = 50, 95
#: The bound of the sample from which pivots are taken, rows for a pivot in roots of all rows, fewest and most pivots, and the
#: hashes of labels.
SAMPLE, ROOT, FEWEST, MOST, LABELS, SEED = 4096, 16, 4, 64, 8, 11
#: Rows and anchors of a packed block, and how many anchor blocks meet a block in one group.
BLOCK, ANCHORS, TOGETHER = 2048, 256, 16
_SLACK = 1e-9
_LONG = np.iinfo(np.int64)


def scaled(embedding: str) -> Column:
    """The whole-numbered components as doubles; null if the vector or a component is null or not finite."""
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)  # noqa: E731  larger doubles are whole
    v = F.transform(F.col(embedding), lambda x: whole(x.cast("double") * SCALE))
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN sorts above infinity
    return F.when(F.coalesce(fine, F.lit(False)), v)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exactly: int64, or Python integers where these don't suffice."""
    most = np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * q.shape[1]
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = lambda a: np.array([[int(v) for v in row] for row in a], dtype=object).reshape(a.shape)
    return np.clip(whole(q) @ whole(x).T, _LONG.min, _LONG.max).astype(np.int64)


def norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


@dataclasses.dataclass(frozen=True)
class Pivots:
    """points: augmented pivots of one vector length; most: the largest squared norm M."""

    points: np.ndarray
    most: float

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.most - norms(x)))[:, None]])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of augmented rows to all pivots."""
        d2 = norms(x)[:, None] + norms(self.points)[None, :] - 2 * (x @ self.points.T)
        return np.sqrt(np.maximum(0.0, d2))


def choose_pivots(x: np.ndarray, most: float, count: int) -> Pivots:
    """Rows of x that are far from each other, the first being that farthest from the mean."""
    x = Pivots(np.zeros((0, x.shape[1] + 1)), most).augmented(x)
    far, chosen = norms(x - x.mean(axis=0)), []
    for _ in range(min(count, len(x))):
        k = int(far.argmax())
        if chosen and far[k] <= 0:
            break
        chosen.append(k)
        apart = norms(x - x[k])
        far = apart if len(chosen) == 1 else np.minimum(far, apart)
    return Pivots(x[chosen], most)


@dataclasses.dataclass(frozen=True)
class Table:
    """The pivots and the directory: of each part (cell * hashes + hash of the label) the ranges of distances and labels."""

    dim: int
    hashes: int
    pivots: Pivots
    parts: np.ndarray
    near: np.ndarray  # parts x pivots: smallest distance
    far: np.ndarray
    labels: np.ndarray  # parts x 2: smallest and largest label

    def radii(self, q2: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Between which distances rows lie whose scores lie between low and high; what distances lack in exactness is allowed for."""
        slack = 1e-6 * np.sqrt(2 * self.pivots.most) + 1e-6
        outer = np.sqrt(np.maximum(0.0, q2 + self.pivots.most - 2 * low)) + 2 * slack
        return np.sqrt(np.maximum(0.0, q2 + self.pivots.most - 2 * high)) - 2 * slack, outer

    def visits(self, dist: np.ndarray, q2: np.ndarray, label: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> list[list[int]]:
        """The parts of other cells than its own that may hold a score between low and high, for each anchor."""
        inner, outer = self.radii(q2, low, high)
        gap = np.maximum(0, np.maximum(self.near[None] - dist[:, None], dist[:, None] - self.far[None])).max(axis=2, initial=0.0)
        reach = (dist[:, None] + self.far[None]).min(axis=2, initial=np.inf)
        may = (gap <= outer[:, None]) & (reach >= inner[:, None]) & (self.parts[None] // self.hashes != own[:, None])
        if same:
            may &= (self.labels[None, :, 0] <= label[:, None]) & (label[:, None] <= self.labels[None, :, 1])
        else:
            may &= (self.labels[None, :, 0] != label[:, None]) | (label[:, None] != self.labels[None, :, 1])
        return [self.parts[m].tolist() for m in may]


def _packed(column: pd.Series, dtype: type) -> bytes:
    return column.to_numpy(dtype).tobytes()


def _pack_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    first = pdf.iloc[0]
    x, dist = matrix(pdf["vec"], first["width"]), matrix(pdf["dist"], len(first["dist"])) if len(first["dist"]) else np.zeros((len(pdf), 0))
    return pd.DataFrame({"width": [first["width"]], "part": [first["part"]], "block": [first["block"]], "ids": [_packed(pdf["vec_id"], np.int64)], "labels": [_packed(pdf["label"], np.int64)], "x": [x.tobytes()], "dist": [dist.tobytes()]})


def _pack_requests(pdf: pd.DataFrame) -> pd.DataFrame:
    """The anchors of a block once each, and their requests."""
    anchors = pdf.drop_duplicates("row").sort_values("row")
    out = _pack_rows(anchors)
    out["rows"], out["of"] = [_packed(anchors["row"], np.int64)], [np.searchsorted(anchors["row"].to_numpy(), pdf["row"].to_numpy()).astype(np.int64).tobytes()]
    for name in ("no", "low", "high"):
        out[name] = [_packed(pdf[name], np.int64)]
    return out


_BLOCK = "width int, part int, block bigint, ids binary, labels binary, x binary, dist binary"
_ASKED = f"{_BLOCK}, rows binary, of binary, no binary, low binary, high binary"
_FOUND = "row bigint, no bigint, vec_id bigint, score bigint"


def tile(table: Table, q, x, same: bool, k: int) -> Iterator[pd.DataFrame]:
    """Of each request its k best of a block, ties to the smaller id.  q and x: a packed block of requests and of rows."""
    of = lambda packed: np.frombuffer(packed, dtype=np.int64)
    a, rows = unpack(q.x, q.width), unpack(x.x, x.width)
    ids, low, high, owner = of(x.ids), of(q.low), of(q.high), of(q.of)
    may = of(q.ids)[:, None] != ids[None, :]
    may &= (of(q.labels)[:, None] == of(x.labels)[None, :]) == same
    if x.width == table.dim:
        least, most = np.full(len(a), _LONG.max), np.full(len(a), _LONG.min)
        np.minimum.at(least, owner, low)
        np.maximum.at(most, owner, high)
        inner, outer = table.radii(norms(a), least.astype(np.float64), most.astype(np.float64))
        count = len(table.pivots.points)
        for dq, dx in zip(unpack(q.dist, count).T, unpack(x.dist, count).T, strict=True):
            may &= (np.abs(dq[:, None] - dx[None, :]) <= outer[:, None]) & (dq[:, None] + dx[None, :] >= inner[:, None])
    left = np.flatnonzero(may.any(axis=0))
    if not len(left):
        return
    scores, may, ids = products(a, rows[left]), may[:, left], ids[left]
    order = np.argsort(ids, kind="stable")
    scores, may, ids = scores[:, order], may[:, order], ids[order]
    out = []
    for request, i in enumerate(owner.tolist()):
        hit = np.flatnonzero(may[i] & (scores[i] >= low[request]) & (scores[i] <= high[request]))
        best = hit[np.argsort(-scores[i][hit].astype(object) if scores[i][hit].min(initial=0) == _LONG.min else -scores[i][hit], kind="stable")[:k]]
        out.append((np.full(len(best), request), ids[best], scores[i][best]))
    request, found, score = (np.concatenate(c) for c in zip(*out, strict=True))
    yield pd.DataFrame({"row": of(q.rows)[owner[request]], "no": of(q.no)[request], "vec_id": found, "score": score})


class Index:
    """Rows placed by pivots and packed into blocks; asks for requests."""

    def __init__(self, spark: SparkSession, rows: DataFrame, scratch: Scratch):
        """rows: (vec_id, label, vec, dim, is_anchor), without nulls."""
        self.spark, self.scratch = spark, scratch
        squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
        lengths = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("most"))
        common = lengths.agg(F.max_by(F.struct("dim", "most", "n"), F.struct("n", -F.col("dim"))).alias("of")).first()["of"]
        self.empty = common is None
        if self.empty:
            return
        dim, most = max(1, common["dim"]), common["most"]
        mixed = F.xxhash64("vec_id", F.lit(SEED))
        bound = -(2**63) + int(2**64 * min(1.0, 2 * SAMPLE / common["n"])) - 1
        sample = rows.where(F.col("dim") == common["dim"]).where(mixed <= F.lit(bound)).orderBy(mixed, "vec").limit(SAMPLE).select("vec").toPandas()
        # Squares that overflow leave no brackets: then all rows are one cell.
        sound = np.isfinite(most) and len(sample) > 0
        pivots = choose_pivots(matrix(sample["vec"], dim), most, int(np.clip(round(common["n"] ** 0.5 / ROOT), FEWEST, MOST))) if sound else Pivots(np.zeros((0, dim + 1)), 0.0)
        count = len(pivots.points)
        shared = spark.sparkContext.broadcast(pivots)

        def distances_of(lifted):
            @F.pandas_udf("array<double>")
            def distances(vecs: pd.Series) -> pd.Series:
                own, out = (vecs.map(len) == dim).to_numpy() & (count > 0), pd.Series([[] for _ in vecs], dtype=object)
                if own.any():
                    found = shared.value.distances(lifted(shared.value, matrix(vecs[own], dim)))
                    out[own] = pd.Series(found.tolist(), index=out.index[own], dtype=object)
                return out

            return distances

        distances = distances_of(lambda p, x: p.augmented(x))
        asked = distances_of(lambda p, x: np.hstack([x, np.zeros((len(x), 1))]))
        placed = rows.select("vec_id", "label", "vec", F.size("vec").alias("width"), "is_anchor", distances("vec").alias("dist"), F.monotonically_increasing_id().alias("row"))
        cell = F.when(F.size("dist") > 0, F.array_position("dist", F.array_min("dist")).cast("int") - 1).otherwise(F.lit(count))
        placed = placed.withColumn("part", (cell * LABELS + F.pmod(F.xxhash64("label", F.lit(SEED)), F.lit(LABELS))).cast("int"))
        self.rows = scratch.write(placed, "placed")
        #: Anchors have a zero as their last component.
        self.anchors = self.rows.where("is_anchor").withColumn("dist", asked("vec"))
        self.sizes = scratch.write(self.rows.groupBy("width", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "sizes")
        ranges = [f(F.col("dist")[k]).alias(f"{name}{k}") for k in range(count) for name, f in (("near", F.min), ("far", F.max))]
        parts = self.rows.where(F.size("dist") > 0).groupBy("part").agg(F.min("label").alias("low"), F.max("label").alias("high"), *ranges).orderBy("part").toPandas()
        column = lambda name: parts[[f"{name}{k}" for k in range(count)]].to_numpy(np.float64)
        self.table = Table(dim if count else -1, LABELS, pivots, parts["part"].to_numpy(np.int64), column("near"), column("far"), parts[["low", "high"]].to_numpy(np.int64))
        self.shared = spark.sparkContext.broadcast(self.table)
        dealt = self.rows.join(F.broadcast(self.sizes), ["width", "part"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
        self.blocks = scratch.write(dealt.groupBy("width", "part", "block").applyInPandas(_pack_rows, _BLOCK), "blocks")

    def own(self, same: bool) -> Column:
        """The parts of an anchor's own cell that it meets."""
        if same:
            return F.array("part")
        first = F.col("part") - F.pmod(F.col("part"), F.lit(LABELS))
        return F.sequence(first, first + LABELS - 1)

    def others(self, same: bool) -> Column:
        """The parts of other cells that it meets."""
        shared = self.shared

        @F.pandas_udf("array<int>")
        def visits(vec: pd.Series, dist: pd.Series, label: pd.Series, part: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
            table, out = shared.value, pd.Series([[] for _ in vec], dtype=object)
            own = (vec.map(len) == table.dim).to_numpy()
            if own.any():
                x, d = matrix(vec[own], table.dim), matrix(dist[own], len(table.pivots.points))
                number = lambda s: s[own].to_numpy(np.float64)
                found = table.visits(d, norms(x), label[own].to_numpy(np.int64), part[own].to_numpy(np.int64) // table.hashes, number(low), number(high), same)
                out[own] = pd.Series(found, index=out.index[own], dtype=object)
            return out

        return visits("vec", "dist", "label", "part", "low", "high")

    def ask(self, requests: DataFrame, parts: Column, same: bool, k: int, name: str) -> DataFrame:
        """requests: rows of self.rows with no, low and high.  (row, no, vec_id, score): at least the k best in the given parts."""
        routed = self.scratch.write(requests.withColumn("part", F.explode(parts)), f"{name}-routed")
        counted = routed.groupBy("width", "part").agg(F.ceil(F.approx_count_distinct("row") / ANCHORS).alias("groups"))
        sizes = self.scratch.write(counted.join(self.sizes, ["width", "part"]), f"{name}-sizes")
        sizes = F.broadcast(sizes)  # a row for each part, or vector length and hash of a label
        cut = routed.join(sizes, ["width", "part"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("groups")))
        asked = self.scratch.write(cut.groupBy("width", "part", "block").applyInPandas(_pack_requests, _ASKED), f"{name}-asked")
        key = ["width", "part", "group", "block"]
        # A block is copied once for each group of TOGETHER blocks of anchors of its part, those once for each block.
        q = F.struct("width", "ids", "labels", "x", "dist", "rows", "of", "no", "low", "high").alias("q")
        left = asked.join(sizes, ["width", "part"]).select("width", "part", F.floor(F.col("block") / TOGETHER).alias("group"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), q)
        groups = F.floor((F.col("groups") - 1) / TOGETHER)
        right = self.blocks.join(sizes, ["width", "part"]).select("width", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), groups)).alias("group"), "block", F.struct("width", "ids", "labels", "x", "dist").alias("x"))
        shared = self.shared

        def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for q, x in zip(batch["q"], batch["x"], strict=True):
                    yield from tile(shared.value, pd.Series(q), pd.Series(x), same, k)

        with BatchRows(self.spark, 4):
            found = self.scratch.write(left.join(right.hint("shuffle_merge"), key).select("q", "x").mapInPandas(rerank, _FOUND), f"{name}-found")
        self.scratch.drop(f"{name}-routed", f"{name}-asked")
        return found

    def best(self, requests: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """(row, no, vec_id, score, rank): the k best of each request, from its own cell, then from what others may add."""
        near = self.ask(requests, self.own(same), same, k, f"{name}-near")
        least = _ranked(near, k).where(F.col("rank") == k).select("row", "no", F.col("score").alias("least"))
        raised = requests.join(least, ["row", "no"], "left").withColumn("low", F.greatest("low", F.coalesce("least", "low"))).drop("least")
        return _ranked(near.unionByName(self.ask(raised, self.others(same), same, k, f"{name}-far")), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("row", "no").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(spark: SparkSession, rows: DataFrame, is_anchor: Column, scratch: Scratch, id_column: str = "vec_id", embedding: str = "embedding", label: str | Column = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that is_anchor selects."""
    label = F.col(label) if isinstance(label, str) else label
    known = rows.select(F.col(id_column).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), scaled(embedding).alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")).dropna()
    known = known.select("vec_id", "label", F.when(F.size("vec") > 0, F.col("vec")).otherwise(F.array(F.lit(0.0))).alias("vec"), F.size("vec").alias("dim"), "is_anchor")
    index = Index(spark, known, scratch)
    if index.empty:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    anchors = scratch.write(index.anchors, "anchors").withColumns({"no": F.lit(0).cast("bigint"), "low": F.lit(_LONG.min), "high": F.lit(_LONG.max)})
    positives = scratch.write(index.best(anchors, True, POSITIVES, "positives"), "positives")
    share = lambda f, percent: f(F.col("score").cast("decimal(38,0)") * percent / 100).cast("bigint")
    windows = positives.select("row", F.col("rank").cast("bigint").alias("no"), share(F.ceil, FROM).alias("low"), share(F.floor, TO).alias("high")).where("low <= high")
    asked = scratch.write(anchors.drop("no", "low", "high").join(windows, "row"), "windows")
    negatives = index.best(asked, False, NEGATIVES, "negatives")
    named = positives.select("row", F.col("rank").cast("bigint").alias("no"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.join(named, ["row", "no"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
