"""Every line item is a point; the SQL, which takes line 1 of each order, holds on its own points."""

from collections import Counter, defaultdict

import duckdb
import pytest

from sparkloom import catalog
from sparkloom.operators import graph

FOLDER = "/root/testdata/sf0.001"


def by_hand(points: list[tuple], ranges: list[tuple]) -> Counter:
    """Every point against every range of its file; rows are counted, since point ids repeat."""
    of = defaultdict(list)
    for symbol, path, start, end in ranges:
        of[path].append((-start, end, symbol))
    out = Counter()
    for point, path, pos in points:
        held = [r for r in of[path] if -r[0] <= pos < r[1]]
        if held:
            out[point, min(held)[2]] += 1
    return out


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def ranges_of(tables) -> list[tuple]:
    return [(o, c % 100, o % 1000, o % 1000 + c % 50 + 1) for o, c in tables.execute("select o_orderkey, o_custkey from orders").fetchall()]


def test_every_line_item_is_a_point(spark, tables):
    items = tables.execute("select l_orderkey, l_linenumber, l_suppkey, l_partkey from lineitem").fetchall()
    want = by_hand([(o * 10 + n, s % 100, p % 1000) for o, n, s, p in items], ranges_of(tables))
    got = Counter((r["point_id"], r["symbol_id"]) for r in catalog.QUERIES["point_in_range"](spark, FOLDER).collect())
    assert got == want
    assert len({p % 10 for p, _ in got}) == 7 and len({p for p, _ in got}) < sum(got.values())


def test_same_as_sql(spark, tables):
    got = Counter((r["point_id"], r["symbol_id"]) for r in catalog.QUERIES["point_in_range"](spark, FOLDER).collect())
    assert got == Counter(tables.execute(catalog.ORACLE_SQL["point_in_range"]).fetchall())


def test_ranges_over_many_buckets(spark):
    ranges = [(1, 0, -70, 1000), (2, 0, 60, 130), (3, 0, 64, 128), (4, 0, 64, 128), (5, 0, 64, 100), (6, 0, 90, 90), (7, 1, 5, 3), (8, 1, 128, 129)]
    points = [(i, path, pos) for i, (path, pos) in enumerate((path, pos) for path in (0, 1, 2) for pos in (-71, -70, -1, 0, 59, 60, 63, 64, 90, 100, 127, 128, 129, 999, 1000))]
    found = graph.innermost(spark.createDataFrame(points, "point_id bigint, path bigint, pos bigint"), spark.createDataFrame(ranges, "symbol_id bigint, path bigint, start bigint, end bigint"))
    assert Counter(map(tuple, found.collect())) == by_hand(points, ranges)
