"""Dependency graphs: one hop, shortest traces, impact, cycles; and the joins that resolve names to targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.sources.shared import cut as _cut


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(node, depth, parent): breadth first from starts (node) along edges (src, tgt), the first discovery of each node.

    Reaching the bound with nodes still to visit is an error, never a shorter answer.
    """
    frontier = _cut(starts.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(starts.schema["node"].dataType).alias("parent")))
    levels = [frontier]
    for level in range(1, depth + 2):
        seen = reduce(DataFrame.unionByName, levels).select("node")
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").groupBy(F.col("tgt").alias("node")).agg(F.min("src").alias("parent"))
        # A level is written once and never again: what was seen is the levels so far.
        frontier = _cut(step.join(seen, "node", "left_anti").select("node", F.lit(level).alias("depth"), "parent"))
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        if level > depth:
            raise ValueError(f"the graph goes on beyond depth {depth}")
        levels.append(frontier)
    return reduce(DataFrame.unionByName, levels)


def impact(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """What depends on starts, directly or not: reach() along reversed edges."""
    return reach(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")), starts, depth).where("depth > 0")


def trace(edges: DataFrame, source: object, target: object, depth: int) -> DataFrame:
    """(step, node): a shortest path; empty if there is none or both ends are the same."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    found = reach(edges, spark.createDataFrame([(source,)], f"node {kind}"), depth)
    at = found.where(F.col("node") == F.lit(target)).first()
    if at is None or source == target:
        return spark.createDataFrame([], f"step int, node {kind}")
    path = [at["node"]]
    while at["parent"] is not None:  # as many steps as the depth, at most
        at = found.where(F.col("node") == F.lit(at["parent"])).first()
        path.append(at["node"])
    return spark.createDataFrame(list(enumerate(reversed(path))), f"step int, node {kind}")


def _peel(edges: DataFrame) -> DataFrame:
    """Edges without those at nodes with no way in or no way out, again and again: such nodes are on no cycle."""
    n = edges.count()
    while n:
        edges = _cut(edges.join(edges.select(F.col("tgt").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("tgt")).distinct(), "tgt", "left_semi").select("src", "tgt"))
        was, n = n, edges.count()
        if n == was:
            break
    return edges


def _colours(edges: DataFrame, depth: int) -> DataFrame:
    """(node, colour): the least node that reaches it, itself included."""
    now = _cut(edges.select(F.explode(F.array("src", "tgt")).alias("node")).distinct().select("node", F.col("node").alias("colour"), F.lit(True).alias("fresh")))
    for _ in range(depth + 1):
        step = edges.join(now.where("fresh").select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("tgt").alias("node")).agg(F.min("colour").alias("offered"))
        less = F.coalesce(F.col("offered") < F.col("colour"), F.lit(False))
        now = _cut(now.join(step, "node", "left").select("node", F.when(less, F.col("offered")).otherwise(F.col("colour")).alias("colour"), less.alias("fresh")))
        if now.where("fresh").isEmpty():
            return now.select("node", "colour")
    raise ValueError(f"cycles go on beyond depth {depth}")


def cycle_edges(edges: DataFrame, depth: int) -> DataFrame:
    """(src, tgt): edges whose ends reach each other, self-loops included.

    Nodes without a way in or out are peeled off. In the rest a node's colour is the least node that reaches it; the nodes
    of a colour that reach that node are its component. Components leave the graph, with all edges between colours, until
    no edge is left: what is held grows with the edges, not with the pairs of nodes.
    """
    edges = _cut(edges.select("src", "tgt").distinct())
    found, rest = edges.where("src = tgt"), _peel(edges.where("src <> tgt"))
    while not rest.isEmpty():
        colours = _colours(rest, depth)
        ends = rest.join(colours.select(F.col("node").alias("src"), "colour"), "src").join(colours.select(F.col("node").alias("tgt"), F.col("colour").alias("other")), "tgt")
        inside = _cut(ends.where("colour = other").select("src", "tgt", "colour"))
        backwards = inside.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))
        own = reach(backwards, inside.select(F.col("colour").alias("node")), depth).select("node")
        found = _cut(found.unionByName(inside.join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "tgt"), "tgt", "left_semi").select("src", "tgt")))
        rest = _peel(inside.join(own.withColumnRenamed("node", "src"), "src", "left_anti").join(own.withColumnRenamed("node", "tgt"), "tgt", "left_anti").select("src", "tgt"))
    return found


def resolve_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_id, value, path, how): files by exact path, else by path without extension, else by an index file of that folder.

    wanted: (ref_id, value); files: (path).  The first way that finds anything counts; several targets stay several rows,
    none is one row with null.
    """
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    keyed = files.select("path", stem.alias("stem"))
    ways = [
        wanted.join(keyed.select("path", F.col("path").alias("value")), "value").withColumn("rank", F.lit(1)),
        wanted.join(keyed.select("path", F.col("stem").alias("value")), "value").withColumn("rank", F.lit(2)),
        wanted.join(keyed.where(F.col("stem").endswith("/index")).select("path", F.regexp_replace("stem", "/index$", "").alias("value")), "value").withColumn("rank", F.lit(3)),
    ]
    every = ways[0].unionByName(ways[1]).unionByName(ways[2])
    best = every.withColumn("best", F.min("rank").over(W.partitionBy("ref_id"))).where("rank = best").select("ref_id", "path", F.element_at(F.array(F.lit("exact"), F.lit("stem"), F.lit("index")), F.col("rank")).alias("how"))
    return wanted.join(best, "ref_id", "left").select("ref_id", "value", "path", "how")


def resolve_cascade(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(ref_id, stage, n_targets, target, resolution): same file, same module, explicit import, export of a file that is imported, whole project.

    refs: (ref_id, path, module, name); symbols: (symbol_id, path, module, name); imports: (src, tgt, bound, leaf), the name that
    the file src gives to leaf of the file tgt, both null where it takes the whole file.  The first stage that is not empty counts;
    one target is resolved, more are ambiguous, none is unresolved.

    Symbols are counted by each stage's key first, so a reference meets one row a stage, however many share its name.  Imports
    meet the names that their own file uses, and then those counts: neither an imported file's symbols nor its importers are spread.
    """
    found = [F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("first")]
    totals = [F.sum("n").alias("n"), F.min("first").alias("first")]
    by_path = symbols.groupBy("name", "path").agg(*found)
    held = by_path.select(F.col("path").alias("tgt"), F.col("name").alias("leaf"), "n", "first")
    bound = imports.where("bound is not null").select(F.col("src").alias("path"), F.col("bound").alias("name"), "tgt", "leaf").distinct()
    used = refs.select("path", "name").distinct().join(imports.select(F.col("src").alias("path"), "tgt").distinct(), "path").withColumn("leaf", F.col("name"))
    stages = [
        (["name", "path"], by_path),
        (["name", "module"], symbols.groupBy("name", "module").agg(*found)),
        (["name", "path"], bound.join(held, ["tgt", "leaf"]).groupBy("name", "path").agg(*totals)),
        (["name", "path"], used.join(held, ["tgt", "leaf"]).groupBy("name", "path").agg(*totals)),
        (["name"], by_path.groupBy("name").agg(*totals)),
    ]
    met, hits = refs.select("ref_id", "path", "module", "name"), []
    for k, (keys, own) in enumerate(stages, 1):
        hit = F.struct(F.lit(k).alias("stage"), F.col("n"), F.col("first"))
        counted = own.select(*keys, hit.alias(f"hit{k}"))
        met = met.join(counted, keys, "left")
        hits.append(F.col(f"hit{k}"))
    best = met.select("ref_id", F.coalesce(*hits).alias("b")).groupBy("ref_id").agg(F.min("b").alias("b"))
    n = F.coalesce(F.col("b.n"), F.lit(0))
    state = F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved")
    return best.select("ref_id", F.col("b.stage").alias("stage"), n.alias("n_targets"), F.when(n == 1, F.col("b.first")).alias("target"), state.alias("resolution"))


#: Positions to a bucket of innermost().
BUCKET = 64


def innermost(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(point_id, symbol_id): of the half-open ranges that hold a point in its file, the one that starts last, then the shortest.

    One row for each row of points that is in a range, also where rows share a point_id. Equal positions are settled once,
    and equal ranges count as the one with the least symbol_id. A range is in each bucket of positions that it overlaps.
    """
    own = ranges.where("start < end").groupBy("path", "start", "end").agg(F.min("symbol_id").alias("symbol_id"))
    own = own.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("end") - 1) / BUCKET))))
    places = points.select("path", "pos").distinct().withColumn("bucket", F.floor(F.col("pos") / BUCKET))
    met = places.join(own, ["path", "bucket"]).where("start <= pos and pos < end")
    best = met.groupBy("path", "pos").agg(F.max_by("symbol_id", F.struct("start", -F.col("end"), -F.col("symbol_id"))).alias("symbol_id"))
    return points.join(best, ["path", "pos"]).select("point_id", "symbol_id")
