"""Connected components: tasks contract bounded shares of the edges, then alternate large-star and small-star steps.

Each step is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch


#: Edges that a task contracts at once.
LOCAL = 1 << 18


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that some edges name, and the smallest node that they lead to."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            return nodes, nodes[root]
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]


def _contract(local: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges that connect what those of the task connect: from each node to the smallest one, by shares of about local edges."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            size += len(batch)
            if size > 2 * local:
                held = [forest(*(np.concatenate(side) for side in zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > local:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["u", "v"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*(np.concatenate(side) for side in zip(*held, strict=True)))], ["u", "v"])

    return contract


def components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60, local: int = LOCAL) -> DataFrame:
    """(node, component): the smallest node reachable from each node that edges (u, v) name.

    Nodes without an edge do not appear; a self-loop makes a node its own component.  Tasks first contract local
    edges each, whichever these are, as long as that halves the table; if they fit into one task, it has found all.
    In the steps after that minima are aggregated before they are joined back, so the many edges of one hub are split
    like any skewed join.
    """
    at = 0
    current = scratch.write(edges.where("u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), f"{name}-{at}")
    n = current.count()
    while True:
        tasks = max(1, -(-n // local))
        at += 1
        after = scratch.write(current.coalesce(tasks).mapInArrow(_contract(local), current.schema), f"{name}-{at}")
        scratch.drop(f"{name}-{at - 1}")
        if tasks == 1:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        current, before, n = after, n, after.count()
        if 2 * n > before:
            break
    seen = None
    for _ in range(most_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(current.where("u = v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        both = small.select("u", F.col("m").alias("v")).unionByName(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        at += 1
        after = scratch.write(both.distinct(), f"{name}-{at}")
        # A step changes the edges unless every edge leads to a root; equal sums of mixed rows mean equal sets.
        now = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(f"{name}-{at - 1}")
        current = after
        if (now["n"], now["h"]) == seen:
            ends = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return ends.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
        seen = (now["n"], now["h"])
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
