"""Approximate nearest neighbours by learned partitions.

1. A bounded sample (SAMPLE rows, those with the smallest hash of their id) gives a graph of nearest neighbours.
   The graph is halved again and again: a diffusion over its edges finds a smooth direction, the median splits it
   into equal halves, and swaps of the vertices that gain most cut the number of edges between the halves.
2. A small classifier (softmax regression) learns from a vector how its neighbours spread over the partitions.
3. Every row is indexed in its most probable partition; partitions are stored as packed blocks of bounded size, so
   a partition that holds a third of all rows is many blocks.
4. A query visits its several most probable partitions; how much probability they must cover is calibrated on the
   sample for TARGET recall.  Every block of a visited partition meets every block of its queries; pairs of blocks
   are dealt by both numbers, so a hot partition is many tasks.  Each pair keeps a query's k best by the exact cosine
   in double precision, and the best of all are ranked.

Partitions hold about ROOT times the root of the number of rows, so queries are routed on small tables too.

Nulls and edge cases: rows whose id is null and vectors that are null, empty, zero, or hold null or non-finite
components take no part.  Vectors are compared with those of their own length; the index is fitted on the commonest
length, and the vectors of each other length are one partition, which is searched whole.  A query is no candidate for
itself (rows with the query's own id are left out); a candidate id comes once, with its best score, however many rows repeat it.
Query rows that share an id are one query: a candidate's best score with any of them counts.  Fewer candidates than k are
all returned: a query that finds fewer than k ids visits all partitions.  Equal scores go to the smaller
id; an empty table gives no rows.  target=1 visits every partition, which is an exact search.
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
from sparkloom.llm.vectors import BatchRows, as_doubles, matrix, unit, unpack, usable

#: The bound of the sample that the index is fitted on.
SAMPLE = 8192
NEIGHBOURS, TARGET, SEED = 10, 0.97, 29
#: Rows wanted in a partition in roots of all rows, the most partitions that the sample supports, rows and queries of
#: a packed block, and how many query blocks meet a block in one group.
ROOT, MOST_PARTITIONS, BLOCK, QUERY_BLOCK, TOGETHER = 4, 256, 2048, 512, 16
_TIE = 1e-12


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row, nearest first."""
    out = np.zeros((len(x), k), dtype=np.int64)
    for start in range(0, len(x), 1024):
        scores = x[start : start + 1024] @ x.T
        rows = np.arange(len(scores))
        scores[rows, rows + start] = -np.inf
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        out[start : start + 1024] = np.take_along_axis(best, np.argsort(-np.take_along_axis(scores, best, axis=1), axis=1, kind="stable"), axis=1)
    return out


def _halve(members: np.ndarray, edges: tuple[np.ndarray, np.ndarray], x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """True for one half of the members: equal sizes, few edges between."""
    n, (u, v) = len(members), edges
    degree = np.maximum(1, np.bincount(u, minlength=n))
    own = x[members] - x[members].mean(axis=0)
    direction = own @ np.linalg.svd(own.T @ own)[0][:, 0] + 1e-9 * rng.standard_normal(n)
    for _ in range(30):
        direction = 0.5 * direction + 0.5 * np.bincount(u, weights=direction[v], minlength=n) / degree
        direction -= (direction * degree).sum() / degree.sum()
        direction /= np.abs(direction).max() + 1e-300
    side = np.zeros(n, dtype=bool)
    side[np.argsort(direction, kind="stable")[n // 2 :]] = True
    cut = int((side[u] != side[v]).sum())
    for _ in range(20):
        # What moving a vertex to the other half would save; the best of both halves change places.
        gain = np.bincount(u, weights=np.where(side[u] != side[v], 1.0, -1.0), minlength=n)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        swaps = int((gain[a[:m]] + gain[b[:m]] > 0).sum()) // 2
        if not swaps:
            break
        tried = side.copy()
        tried[a[:swaps]], tried[b[:swaps]] = False, True
        now = int((tried[u] != tried[v]).sum())
        if now >= cut:
            break
        side, cut = tried, now
    return side


def balanced_partitions(x: np.ndarray, near: np.ndarray, levels: int, seed: int = SEED) -> np.ndarray:
    """2^levels parts of about equal size of the neighbour graph, by halving."""
    rng, n = np.random.default_rng(seed), len(x)
    part = np.zeros(n, dtype=np.int64)
    u, v = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    for _ in range(levels):
        after = part * 2
        for p in range(part.max() + 1):
            members = np.flatnonzero(part == p)
            if len(members) > 1:
                place = np.full(n, -1)
                place[members] = np.arange(len(members))
                inside = (place[u] >= 0) & (place[v] >= 0)
                after[members] += _halve(members, (place[u[inside]], place[v[inside]]), x, rng)
        part = after
    return part


def fit_classifier(x: np.ndarray, wanted: np.ndarray, rounds: int = 250, rate: float = 0.1) -> np.ndarray:
    """Softmax regression (with a constant) onto distributions, by Adam on all rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weights = np.zeros((x.shape[1], wanted.shape[1]))
    m, s = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        gradient = x.T @ (_softmax(x @ weights) - wanted) / len(x) + 1e-6 * weights
        m, s = 0.9 * m + 0.1 * gradient, 0.99 * s + 0.01 * gradient**2
        weights -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-12)
    return weights


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclasses.dataclass(frozen=True)
class Router:
    dim: int
    weights: np.ndarray  # (dim + 1) x partitions
    mass: float  # probability that the visited partitions cover
    sizes: np.ndarray | None = None

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(x @ self.weights[:-1] + self.weights[-1])

    def partition(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x).argmax(axis=1)

    def visits(self, x: np.ndarray, least: int) -> list[list[int]]:
        """The partitions each row visits, most probable first, with at least that many rows."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        covered = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
        rows = np.cumsum(self.sizes[order], axis=1)
        count = np.minimum(p.shape[1], 1 + np.maximum((covered < self.mass).sum(axis=1), (rows < least).sum(axis=1)))
        return [o[:c].tolist() for o, c in zip(order, count, strict=True)]


def fit_router(x: np.ndarray, rows: int, target: float = TARGET) -> Router:
    """x: the sample's unit vectors; rows: how many rows will be indexed."""
    levels = int(np.clip(np.log2(max(1, rows**0.5 / ROOT)).round(), 0, np.log2(MOST_PARTITIONS)))
    levels = min(levels, int(np.log2(max(1, len(x) // (4 * NEIGHBOURS)))))
    if levels == 0:
        return Router(x.shape[1], np.zeros((x.shape[1] + 1, 1)), 1.0)
    near = neighbour_graph(x, NEIGHBOURS)
    part = balanced_partitions(x, near, levels)
    wanted = (np.eye(1 << levels)[part] + np.eye(1 << levels)[part[near]].sum(axis=1)) / (NEIGHBOURS + 1)
    # Rows of one fold calibrate what a classifier of the other rows covers; the last classifier learns from all.
    fold = np.arange(len(x)) % 4 == 0
    trial = Router(x.shape[1], fit_classifier(x[~fold], wanted[~fold]), 1.0)
    p, where = trial.probabilities(x[fold]), trial.partition(x)
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
    rank = np.argsort(order, axis=1, kind="stable")
    needed = np.take_along_axis(before, np.take_along_axis(rank, where[near[fold][:, :5]], axis=1), axis=1)
    mass = float(np.quantile(needed, target)) + 1e-9 if target < 1 else 2.0
    return Router(x.shape[1], fit_classifier(x, wanted), mass)


def _best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """Each query's k best ids of a block, each with its best row, by exact score, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    scores = q @ x.T
    scores[q_ids[:, None] == ids[None, :]] = -np.inf
    by_id = scores if len(first) == len(ids) else np.maximum.reduceat(scores, first, axis=1)
    m = min(k, len(first))
    least = np.partition(by_id, len(first) - m, axis=1)[:, len(first) - m]
    i, j = np.nonzero((scores >= least[:, None] - _TIE) & (scores > -np.inf))
    exact = np.concatenate([np.zeros(0)] + [(q[i[s : s + 65536]] * x[j[s : s + 65536]]).sum(axis=1) for s in range(0, len(i), 65536)])
    for keys in ((-exact, ids[j], i), None):
        order = np.lexsort(keys if keys else (ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        if keys:
            # The best row of each id.
            one = np.append(True, (i[1:] != i[:-1]) | (ids[j][1:] != ids[j][:-1]))[: len(i)]
            i, j, exact = i[one], j[one], exact[one]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    yield pd.DataFrame({"query_id": q_ids[i[keep]], "vec_id": ids[j[keep]], "score": exact[keep]})


def _dealt(rows: DataFrame, parts: int, others: int, most: int) -> tuple[np.ndarray, Column]:
    """Rows of each of the router's partitions, and over how many blocks of most rows those of column part are dealt.

    One row for each partition comes to the driver, MOST_PARTITIONS at most; others counts the rows of other lengths.
    """
    counted = rows.where("part >= 0").groupBy("part").agg(F.count(F.lit(1)).alias("n")).toPandas()
    sizes = np.zeros(parts, dtype=np.int64)
    sizes[counted["part"]] = counted["n"]
    blocks = F.element_at(F.array(*[F.lit(int(-(-s // most)) or 1) for s in sizes]), F.greatest(F.col("part"), F.lit(0)) + 1)
    return sizes, F.when(F.col("part") < 0, F.lit(-(-others // most) or 1)).otherwise(blocks).cast("bigint")


def search(spark: SparkSession, rows: DataFrame, is_query: Column, scratch: Scratch, k: int = 5, id_column: str = "vec_id", embedding: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of rows that is_query selects."""
    usable_rows = rows.where(F.col(id_column).isNotNull()).where(usable(embedding))
    vectors = usable_rows.select(F.col(id_column).cast("bigint").alias("vec_id"), as_doubles(embedding).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    lengths = vectors.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.agg(F.max_by("dim", F.struct("n", -F.col("dim"))).alias("dim"), F.max("n").alias("n"), F.sum("n").alias("rows")).first()
    if common["dim"] is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, n = common["dim"], common["n"]
    mixed = F.xxhash64("vec_id", F.lit(SEED))
    bound = -(2**63) + int(2**64 * min(1.0, 2 * SAMPLE / n)) - 1
    sample = vectors.where(F.size("vec") == dim).where(mixed <= F.lit(bound)).orderBy(mixed, "vec").limit(SAMPLE).select("vec").toPandas()
    router = fit_router(unit(matrix(sample["vec"], dim)), n, target)
    shared = spark.sparkContext.broadcast(router)

    @F.pandas_udf("int")
    def partition(vecs: pd.Series) -> pd.Series:
        width = vecs.map(len).to_numpy(dtype=np.int32)
        own, out = width == dim, -width
        if own.any():
            out[own] = shared.value.partition(unit(matrix(vecs[own], dim)))
        return pd.Series(out)

    placed = scratch.write(vectors.withColumn("part", partition("vec")), "placed")
    sizes, blocks_of = _dealt(placed, router.weights.shape[1], common["rows"] - n, BLOCK)
    final = spark.sparkContext.broadcast(dataclasses.replace(router, sizes=sizes))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[~pd.DataFrame({"id": pdf["vec_id"], "x": [np.asarray(v).tobytes() for v in pdf["vec"]]}).duplicated()]
        width = len(pdf["vec"].iloc[0])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "block": [pdf["block"].iloc[0]], "width": [width], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "x": [unit(matrix(pdf["vec"], width)).tobytes()]})

    schema = "part int, block bigint, width int, ids binary, x binary"
    cut = placed.select("part", "vec_id", "vec", F.pmod(F.xxhash64("vec_id", "vec"), blocks_of).alias("block"))
    blocks = scratch.write(cut.groupBy("part", "block").applyInPandas(pack, schema), "blocks")

    @F.pandas_udf("array<int>")
    def visits(vecs: pd.Series) -> pd.Series:
        width = vecs.map(len).to_numpy(dtype=np.int32)
        own, out = width == dim, pd.Series([[-w] for w in width.tolist()], dtype=object)
        if own.any():
            out[own] = pd.Series(final.value.visits(unit(matrix(vecs[own], dim)), k + 1), index=out.index[own], dtype=object)
        return out

    def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield from _best(unpack(row.q, row.width), np.frombuffer(row.q_ids, dtype=np.int64), unpack(row.x, row.width), np.frombuffer(row.ids, dtype=np.int64), k)

    def ask(queries: DataFrame, name: str) -> DataFrame:
        """queries (vec_id, vec, parts): (query_id, vec_id, score), the k best ids of each block of the parts."""
        routed = scratch.write(queries, f"routed-{name}").select("vec_id", "vec", F.explode("parts").alias("part"))
        others = routed.where("part < 0").count()
        _, query_blocks_of = _dealt(routed, router.weights.shape[1], others, QUERY_BLOCK)
        cut = routed.select("part", "vec_id", "vec", F.pmod(F.xxhash64("vec_id"), query_blocks_of).alias("block"))
        asked = scratch.write(cut.groupBy("part", "block").applyInPandas(pack, schema), f"asked-{name}")
        # A block is copied once for each group of TOGETHER query blocks of its partition, a query block once for each block.
        groups = F.ceil(query_blocks_of / F.lit(TOGETHER))
        left = asked.select("part", F.floor(F.col("block") / F.lit(TOGETHER)).alias("group"), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks_of - 1)).alias("block"), F.col("ids").alias("q_ids"), F.col("x").alias("q"))
        right = blocks.select("part", F.explode(F.sequence(F.lit(0).cast("bigint"), groups - 1)).alias("group"), "block", "width", "ids", "x")
        pairs = left.join(right.hint("shuffle_merge"), ["part", "group", "block"]).select("width", "q_ids", "q", "ids", "x")
        with BatchRows(spark, 8):
            found = scratch.write(pairs.mapInPandas(rerank, "query_id bigint, vec_id bigint, score double"), f"found-{name}")
        scratch.drop(f"asked-{name}", f"routed-{name}")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    queries = placed.where("is_query").select("vec_id", "vec", visits("vec").alias("parts"))
    found = ask(queries, "near")
    # Rows that repeat ids can leave a query short of k ids: it visits all partitions then.
    full = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = scratch.write(queries.where(F.size("vec") == dim).select("vec_id", "vec").join(full, "vec_id", "left_anti"), "short")
    if router.weights.shape[1] > 1 and not short.isEmpty():
        every = F.array(*map(F.lit, range(router.weights.shape[1])))
        found = found.unionByName(ask(short.withColumn("parts", every), "all")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    scratch.drop("blocks", "placed")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
