"""Queries on whole texts send few rows at a time to Python: Arrow would gather 10,000 texts, whatever their sizes."""

import pytest

from sparkloom import catalog


@pytest.mark.parametrize("query", ["detect_encoding", "decode_legacy", "patch_round_trip", "detect_chunks"])
def test_texts_go_to_python_in_small_batches(spark, query):
    plan = catalog.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan and "InArrow" not in plan
