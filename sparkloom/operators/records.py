"""Symbol and relation records: searches, orders, parents, merged edges, budgeted context."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.sources.shared import cut

#: The order of search hits.  Fixed values.
SEARCH_ORDER = ("path", "start", "end", "symbol_id", "evidence", "language", "name", "kind", "qualified", "fingerprint")
#: The order of relations.  Fixed values.
RELATION_ORDER = ("src_path", "tgt_path", "src_symbol", "tgt_symbol", "src_qualified", "tgt_qualified", "kind")
#: The order of symbols within a file.  Fixed values.
SOURCE_ORDER = ("start", "end", "name_start", "name_end", "symbol_id")
#: Evidence of a relation, weakest first.  Fixed values.
EVIDENCE = ("structural", "scope-resolved", "project-resolved")
#: More candidates than this are an error, not a shorter list.  Fixed value.
MOST_CANDIDATES = 64
#: Rows that a task sorts or groups at once; more rows make more tasks.  Fixed value.
TASK_ROWS = 1 << 20


def spread(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """About n rows dealt by keys over as many tasks as hold TASK_ROWS each; few rows are left to Spark."""
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(-(-n // TASK_ROWS), *keys) if n > most * TASK_ROWS else rows


def symbol_matches(name: Column, qualified: Column, query: str, mode: str = "exact") -> Column:
    """exact: the name; prefix: of the name or the qualified one; qualified: the whole qualified name."""
    if mode == "prefix":
        return name.startswith(query) | qualified.startswith(query)
    return (qualified if mode == "qualified" else name) == query


def text_matches(value: Column, query: str, mode: str = "exact") -> Column:
    """An empty value never matches, not even an empty query."""
    hit = {"exact": value == query, "prefix": value.startswith(query), "contains": value.contains(query)}[mode]
    return (value != "") & hit


def of_kinds(kind: Column, kinds: Sequence[str]) -> Column:
    """No kinds asked for: all.  Case and blanks around do not count."""
    return F.lower(F.trim(kind)).isin([k.strip().lower() for k in kinds]) if kinds else F.lit(True)


def with_evidence(evidence: Column, allowed: Sequence[str]) -> Column:
    if unknown := set(allowed) - set(EVIDENCE):
        raise ValueError(f"unknown evidence: {sorted(unknown)}")
    return evidence.isin(list(allowed)) if allowed else F.lit(True)


def top(rows: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """The first rows, with place, truncated (there are more) and occurrence (number among rows of equal keys: a cursor that copies do not confuse).

    Each task keeps limit + 1 rows, so the window that numbers them sees no more than that.
    """
    first = rows.orderBy(*order).limit(limit + 1)
    own = W.orderBy(*order)
    placed = first.withColumns({"place": F.row_number().over(own), "of": F.count(F.lit(1)).over(W.partitionBy()), "occurrence": F.row_number().over(W.partitionBy(*order).orderBy(*order))})
    return placed.where(F.col("place") <= limit).withColumn("truncated", F.col("of") > limit).drop("of")


def structural_search(symbols: DataFrame, query: str, mode: str, kinds: Sequence[str], allowed: Sequence[str], limit: int) -> DataFrame:
    hit = text_matches(F.col("name"), query, mode) & of_kinds(F.col("kind"), kinds) & with_evidence(F.col("evidence"), allowed)
    return top(symbols.where(hit), SEARCH_ORDER, limit)


def with_parents(symbols: DataFrame) -> DataFrame:
    """(path, symbol_id, name, parent): the name of the parent in the same file; null for roots and for parents that are absent."""
    parents = symbols.select("path", F.col("symbol_id").alias("parent_id"), F.col("name").alias("parent"))
    return symbols.join(parents, ["path", "parent_id"], "left").select("path", "symbol_id", "name", "parent")


def candidates(refs: DataFrame, symbols: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(ref_id, n, first): distinct targets of the kinds asked for in other files than the reference's; too many of them are an error.

    A reference meets one row of its name (how many targets, the least one and the least in another file than that one's) and one
    of its own file, which is taken off: however common a name is, it is never expanded.
    """
    targets = symbols.where(of_kinds(F.col("kind"), kinds)).groupBy("name", F.col("path").alias("tgt_path")).agg(F.count_distinct("symbol_id").alias("k"), F.min("symbol_id").alias("least"))
    totals = targets.groupBy("name").agg(F.sum("k").alias("total"))
    placed = targets.withColumn("place", F.row_number().over(W.partitionBy("name").orderBy("least", "tgt_path"))).where(F.col("place") <= 2)
    ends = placed.groupBy("name").agg(*[F.max(F.when(F.col("place") == i, F.struct("least", "tgt_path"))).alias(c) for i, c in ((1, "one"), (2, "two"))])
    own = targets.select("name", F.col("tgt_path").alias("path"), F.col("k").alias("own"))
    met = refs.select("ref_id", "name", "path").join(totals.join(ends, "name"), "name").join(own, ["name", "path"], "left")
    n = F.col("total") - F.coalesce("own", F.lit(0))
    first = F.when(F.col("one.tgt_path") != F.col("path"), F.col("one.least")).otherwise(F.col("two.least"))
    # A reference that comes in several rows counts the targets of all.
    found = met.select("ref_id", n.alias("n"), first.alias("first")).where("n > 0").groupBy("ref_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    checked = F.when(F.col("n") > MOST_CANDIDATES, F.raise_error(F.concat(F.lit("too many candidates: "), F.col("ref_id").cast("string"))).cast("bigint")).otherwise(F.col("n"))
    return found.select("ref_id", checked.alias("n"), "first")


def paired_definitions(headers: DataFrame, definitions: DataFrame, key: str) -> DataFrame:
    """(key, header_id, definition_id, resolution): resolved where exactly one header meets exactly one definition, else ambiguous without ids.

    Both sides are (key, symbol_id), counted by key before they meet: no hot key is joined with itself.
    """
    counted = lambda side, name: side.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min("symbol_id").alias(f"{name}_id"))
    met = counted(headers, "header").join(counted(definitions, "definition"), key)
    one = (F.col("n_header") == 1) & (F.col("n_definition") == 1)
    return met.select(key, F.when(one, F.col("header_id")).alias("header_id"), F.when(one, F.col("definition_id")).alias("definition_id"), F.when(one, "resolved").otherwise("ambiguous").alias("resolution"))


def merge_parallel(edges: DataFrame) -> DataFrame:
    """(src, tgt, evidence, resolution): parallel edges as one, by the weakest evidence; differing resolutions make it ambiguous."""
    rank = F.array_position(F.array(*map(F.lit, EVIDENCE)), F.col("evidence"))
    same = F.min("resolution") == F.max("resolution")
    return edges.groupBy("src", "tgt").agg(F.min_by("evidence", rank).alias("evidence"), F.when(same, F.min("resolution")).otherwise("ambiguous").alias("resolution"))


def fit_budget(items: DataFrame, key: str, order: Sequence[str], budget: int, most: int, rows: int = 0) -> DataFrame:
    """items (body, signature: costs or null) with part: body, signature or null (left out), and used: the budget spent so far.

    In order within a key: the body if it fits into what remains, else the signature, else the item is left out and spends
    nothing, so a later smaller one may fit; after `most` items all are left out.  That is sequential by definition: rows
    stream through one task a key with three numbers of state, so a hot key costs time, not memory.  rows: about how many items
    there are, for the number of tasks; 0 leaves it to Spark.
    """
    out = T.StructType([*items.schema.fields, T.StructField("part", T.StringType()), T.StructField("used", T.LongType())])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, n = object(), 0, 0
        for batch in batches:
            parts, spent = [], []
            for k, body, signature in zip(*(batch.column(c).to_pylist() for c in (key, "body", "signature")), strict=True):
                if k != now:
                    now, used, n = k, 0, 0
                part = None
                if n < most:
                    for name, cost in (("body", body), ("signature", signature)):
                        if cost is not None and cost <= budget - used:
                            part, used, n = name, used + cost, n + 1
                            break
                parts.append(part)
                spent.append(used)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.string()), pa.array(spent, pa.int64())], names=[*batch.schema.names, "part", "used"])

    dealt = spread(items, rows, key)
    return (items.repartition(F.col(key)) if dealt is items else dealt).sortWithinPartitions(key, *order).mapInArrow(fit, out)


def plan_context(targets: DataFrame, edges: DataFrame, sizes: DataFrame, budget: int, most: int, depth: int = 1) -> DataFrame:
    """(request_id, symbol_id, priority, part, used, truncated): a request's target, then what it needs, what needs it, and what its needs need.

    targets: (request_id, symbol_id); edges: (src, tgt), distinct; sizes: (symbol_id, body, signature).  priority is 0 for the
    target, 1 for direct dependencies, 2 for dependents, 2 + k for dependencies at depth 1 + k; a symbol is taken at its first.
    truncated: the body was asked for and did not fit, or the item was left out.
    """
    at = lambda rows, p: rows.select("request_id", "symbol_id", F.lit(p).alias("priority"))
    edges = cut(edges, "edges")  # read once for each direction, and counted
    n = edges.count()
    ahead = targets.join(edges, F.col("symbol_id") == F.col("src")).select("request_id", F.col("tgt").alias("symbol_id"))
    behind = targets.join(edges, F.col("symbol_id") == F.col("tgt")).select("request_id", F.col("src").alias("symbol_id"))
    tiers, level = at(targets, 0).union(at(ahead, 1)).union(at(behind, 2)), ahead
    for k in range(1, depth):
        level = level.distinct().join(edges, F.col("symbol_id") == F.col("src")).select("request_id", F.col("tgt").alias("symbol_id"))
        tiers = tiers.union(at(level, 2 + k))
    # The tiers are at least the edges in both directions, where each symbol is a target; further depths only estimate.
    rows = n * (1 + depth)
    first = spread(tiers, rows, "request_id", "symbol_id").groupBy("request_id", "symbol_id").agg(F.min("priority").alias("priority"))
    sized = spread(first, rows, "symbol_id").join(sizes.hint("shuffle_hash"), "symbol_id")
    planned = fit_budget(sized, "request_id", ["priority", "symbol_id"], budget, most, rows)
    short = F.col("part").isNull() | ((F.col("part") == "signature") & F.col("body").isNotNull())
    return planned.select("request_id", "symbol_id", "priority", "part", "used", short.alias("truncated"))


def relations(edges: DataFrame, kinds: Sequence[str], limit: int) -> DataFrame:
    """Relations of the structural kinds asked for, in their order."""
    return top(edges.where(of_kinds(F.col("kind"), kinds)), RELATION_ORDER, limit)
