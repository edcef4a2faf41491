"""Components by contraction within tasks and by the steps after it."""

import numpy as np

from sparkloom.llm.common import Scratch
from sparkloom.llm.components import components


def plain(edges):
    of = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            if of[u] != of[v]:
                of[u] = of[v] = min(of[u], of[v])
                changed = True
    return of


def graph():
    rng = np.random.default_rng(12)
    chain = [(int(a), int(b)) for a, b in zip(rng.permutation(60)[:-1], range(1, 60), strict=True)]
    star = [(500, int(k)) for k in range(400, 440)]
    line = [(k, k + 1) for k in range(1000, 1080)]
    return [*chain, *star, *line, (700, 700), (-5, 2000), (2000, -5), (2000, -5)]


def test_components_in_one_task_and_in_many(spark):
    edges = graph()
    rows = spark.createDataFrame(edges, "u bigint, v bigint").union(spark.createDataFrame([(None, 1), (1, None)], "u bigint, v bigint")).repartition(5)
    want = plain(edges)
    for local in (1 << 18, 20, 3):
        got = components(rows, Scratch(spark, "t"), "c", local=local).collect()
        assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want


def test_few_edges_take_no_steps(spark, monkeypatch):
    """Each step writes a table through several shuffles, whatever its size."""
    names = []
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, **k: names.append(name) or write(self, df, name, **k))
    components(spark.createDataFrame(graph(), "u bigint, v bigint"), Scratch(spark, "t"), "c")
    assert names == ["c-0", "c-1"]
    names.clear()
    assert components(spark.createDataFrame([], "u bigint, v bigint"), Scratch(spark, "t"), "c").count() == 0
