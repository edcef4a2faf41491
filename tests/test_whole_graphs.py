"""The graph queries cover every edge; the SQL, which is of a few nodes, holds on its part of the rows."""

import duckdb
import pytest

from sparkloom import catalog
from sparkloom.operators import graph

FOLDER = "/root/testdata/sf0.001"


def all_edges() -> set[tuple[int, int]]:
    items = duckdb.execute(f"select l_partkey, l_suppkey from read_parquet('{FOLDER}/lineitem.parquet')").fetchall()
    return {(p, p // 3 + s % 2) for p, s in items if p > 1}


def on_cycles(edges: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """Each edge whose end leads back to its start, searched for one start at a time."""
    after: dict[int, set[int]] = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reached(start: int) -> set[int]:
        seen, todo = {start}, [start]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    far = {b: reached(b) for _, b in edges}
    return {(a, b) for a, b in edges if a in far[b]}


def sql_rows(name: str) -> set[tuple]:
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{FOLDER}/lineitem.parquet')")
    return set(con.execute(catalog.ORACLE_SQL[name]).fetchall())


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()))


def test_deps_of_every_node(spark):
    got = rows(catalog.QUERIES["deps"](spark, FOLDER).select("src", "tgt"))
    assert got == sorted(all_edges())
    assert set(got) == sql_rows("deps")


def test_dependents_of_every_node(spark):
    into: dict[int, list[int]] = {}
    for a, b in all_edges():
        into.setdefault(b, []).append(a)
    got = rows(catalog.QUERIES["dependents"](spark, FOLDER).select("tgt", "n", "first", "last"))
    assert got == sorted((t, len(s), min(s), max(s)) for t, s in into.items())
    assert set(got) == sql_rows("dependents")


def test_cycles_of_the_whole_graph(spark):
    e = all_edges()
    got = rows(catalog.QUERIES["cycles"](spark, FOLDER).select("src", "tgt"))
    assert got == sorted(on_cycles(e | {(b, a) for a, b in e if a % 4 == 0}))
    assert max(a for a, _ in got) > 60


@pytest.mark.parametrize("edges", [
    {(9, 1), (1, 9), (1, 5), (5, 6), (6, 5), (6, 7), (7, 7), (7, 8), (8, 10), (10, 8), (8, 11)},  # components one after another, a self-loop between
    {(3, 2), (2, 3), (3, 4), (4, 5), (5, 4), (4, 1), (1, 12)},
    {(i, (i + 1) % 20) for i in range(20)} | {(30, 0), (19, 31), (31, 32)},
    {(1, 2), (2, 3)},
])
def test_cycles_by_brute_force(spark, edges):
    found = graph.cycle_edges(spark.createDataFrame(sorted(edges), "src bigint, tgt bigint"), 64)
    assert rows(found) == sorted(on_cycles(edges))


def test_cycles_beyond_the_depth_are_an_error(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 12) for i in range(12)], "src bigint, tgt bigint")
    with pytest.raises(ValueError):
        graph.cycle_edges(ring, 4).count()
