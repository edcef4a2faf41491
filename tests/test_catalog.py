"""Every registered query with SQL gives the rows that DuckDB gives."""

from decimal import Decimal

import duckdb
import pytest

from sparkloom import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows by sorted column names; values as the engines give them, so that null integers stay integers."""

    def value(v):
        if v is None:
            return "null"
        return repr(round(float(v), 6)) if isinstance(v, (float, Decimal)) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, FOLDER), duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert plain(ours.columns, ours.collect()) == plain(columns, theirs.fetchall())


def test_trace_is_a_path(spark):
    from sparkloom.operators import graph

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (4, 1)], "src bigint, tgt bigint")
    assert [r["node"] for r in graph.trace(edges, 1, 4, 8).orderBy("step").collect()] == [1, 5, 4]
    assert graph.trace(edges, 1, 1, 8).count() == 0
    assert graph.trace(edges, 4, 9, 8).count() == 0


def test_depth_is_an_error(spark):
    from sparkloom.operators import graph

    edges = spark.createDataFrame([(i, i + 1) for i in range(10)], "src bigint, tgt bigint")
    with pytest.raises(ValueError):
        graph.reach(edges, spark.createDataFrame([(0,)], "node bigint"), 3)


def test_encodings_round_trip(spark):
    rows = catalog.QUERIES["decode_legacy"](spark, FOLDER).where("error is null")
    assert rows.count() and rows.where("not same").count() == 0


def test_patterns_without_linear_time_are_refused():
    from sparkloom.operators.search import any_of

    for p in (r"(?=a)", r"(a)\1", r"(?<!x)y"):
        with pytest.raises(ValueError):
            any_of([p])


def test_globs():
    import re

    from sparkloom.functions.text import glob_regex

    assert re.match(glob_regex("**/*.py"), "a/b/c.py") and re.match(glob_regex("**/*.py"), "c.py")
    assert not re.match(glob_regex("*.py"), "a/c.py") and re.match(glob_regex("[!a]?.md"), "bc.md")
