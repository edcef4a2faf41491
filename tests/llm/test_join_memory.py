"""What the join holds at once: batches, lists and products of blocks."""

import numpy as np
import pandas as pd
import pyarrow as pa

from sparkloom.llm import ngram_join
from sparkloom.llm.common import Scratch

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_the_join_bounds_the_bytes_of_its_batches(spark, monkeypatch):
    """Lists of thousands of members, many at once, don't make one batch; the session's own bound comes back."""
    seen = []
    order = ngram_join.frequency_order
    monkeypatch.setattr(ngram_join, "frequency_order", lambda *a: seen.append(spark.conf.get(KEY)) or order(*a))
    before = spark.conf.get(KEY)
    ngram_join.join(spark, spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id bigint, text string"), Scratch(spark, "t")).count()
    assert seen == [str(ngram_join.BATCH_BYTES)] and spark.conf.get(KEY) == before


def test_lists_are_read_as_columns():
    """Members of lists are not made Python objects one by one; a slice of a batch starts anywhere."""
    member = pa.struct([(k, pa.int64()) for k in ("doc_id", "component", "n", "pos")])
    lists = [[(9, 9, 10, 0)], [(1, 1, 10, 0), (2, 2, 10, 0), (3, 2, 10, 1)], [(4, 4, 10, 0), (5, 5, 4, 0), (6, 6, 10, 0)]]
    members = pa.array([[dict(zip(("doc_id", "component", "n", "pos"), m, strict=True)) for m in x] for x in lists], pa.list_(member))
    batch = pa.RecordBatch.from_arrays([pa.array([70, 71, 72]), pa.array([9, -1, 5]), members], ["token", "head", "members"])
    got = pd.concat([b.to_pandas() for b in ngram_join._list_pairs(8)(iter([batch.slice(1)]))])
    assert sorted(zip(got["a"], got["b"], strict=True)) == [(1, 2), (1, 3), (4, 6)]
    crowded = pd.concat([b.to_pandas() for b in ngram_join._list_pairs(0)(iter([batch]))])
    assert sorted(crowded["token"]) == [71, 72]


def test_products_of_blocks_are_made_in_strips(monkeypatch):
    sizes = []
    products = ngram_join._products
    monkeypatch.setattr(ngram_join, "_products", lambda xs, ys: sizes.append(len(xs) * len(ys)) or products(xs, ys))
    monkeypatch.setattr(ngram_join, "STRIP", 30)
    side = [{"doc_id": k, "component": k, "shingles": np.arange(k // 2, k // 2 + 8, dtype=np.uint64).tobytes()} for k in range(10)]
    got = pd.concat(ngram_join._tile(iter([pd.DataFrame({"left": [side], "right": [side]})])))
    want = [(i, j) for i in range(10) for j in range(10) if i != j and abs(i // 2 - j // 2) <= 1]
    assert max(sizes) <= 30 and sorted(zip(got["a"], got["b"], strict=True)) == want
