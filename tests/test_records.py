"""Budgets, patches, paths and logs against plain versions; cases at the edges."""

import posixpath
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import edits, records, stores
from sparkloom.plans import record_queries


def test_patches_round_trip(spark):
    rows = record_queries.patch_round_trip(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["same"] and r["error"] is None and r["n_hunks"] > 0 for r in rows)


def test_random_patches(spark):
    rng = random.Random(5)
    text = lambda: "\n".join(rng.choice(["", "a", "b", "-c", "+d", "@@ -1 +1 @@", "--- x", "é"]) for _ in range(rng.randint(0, 14)))
    pairs = [(i, text(), text()) for i in range(400)] + [(400, None, "a"), (401, "", "a"), (402, "a", ""), (403, "a", "a")]
    df = spark.createDataFrame(pairs, "id int, old string, new string").withColumn("diff", edits.unified_diff("old", "new", F.lit("p")))
    got = {r["id"]: r for r in edits.apply_patches(df, "old", "diff").collect()}
    for i, old, new in pairs:
        if old is None:
            assert got[i]["diff"] is None and got[i]["got"]["text"] is None
        elif old == new:
            assert got[i]["diff"] == "" and got[i]["got"]["error"] == "no file header"
        else:
            assert got[i]["got"]["text"] == new and got[i]["got"]["error"] is None


def test_wrong_patches_apply_nothing(spark):
    head = "--- a/p\n+++ b/p\n"
    bad = ["", "x", head, head + "@@ -1 +1 @@\n-b\n+c\n", head + "@@ -1 +2 @@\n-a\n+c\n", head + "@@ -9 +9 @@\n-a\n+c\n", head + "@@ -1,2 +1 @@\n-a\n", head + "@@ -1 +1 @@\n-a\n+c\n+d\n", head + "@@ -1 +1 @@\n-a\n+c\n@@ -1 +1 @@\n-a\n+c\n"]
    one = "@@ -1 +1 @@\n-a\n+c\n"
    bad += [head + one + head + one, "--- a/q\n+++ b/p\n" + one, "--- a/p\n+++ /dev/null\n" + one, head + "words\n" + one, head + one + "\\ No newline at end of file\n", head + "@@ -1 +1 @@\n-a\n\n+c\n", head + "@@ -0,0 +2 @@\n+c\n", head + "@@ -999999999999 +1 @@\n"]
    rows = edits.apply_patches(spark.createDataFrame([("a", b, "x/p") for b in bad], "got_text string, p string, path string"), "got_text", "p", "path", "r").select("r.*").collect()
    assert all(r["text"] is None and r["error"] for r in rows)
    good = [("a", head + one, "c"), ("a", "--- a/p\r\n+++ b/p\r\n\r\n" + one.replace("\n", "\r\n"), "c"), ("a\r\nb\r\n", head + one, "c\r\nb\r\n"), ("a\r\nb\n", head + one, "c\nb\n"), ("a", head + "@@ -0,0 +1 @@\n+c\n", "c\na"), ("a", head + "@@ -1 +0,0 @@\n-a\n", ""), (None, head + one, None), ("a", None, None)]
    rows = edits.apply_patches(spark.createDataFrame(good, "t string, p string, want string"), "t", "p").collect()
    assert [(r["got"]["text"], r["got"]["error"]) for r in rows] == [(w, None) for *_, w in good]


def test_path_keys_and_stems(spark):
    rng = random.Random(3)
    paths = ["", " ", "/", "a", "../..", "/..", "a/..", "./a//b/", ".x", "a/.x"] + ["/".join(rng.choice(["", ".", "..", "a", "b.py"]) for _ in range(rng.randint(1, 7))) for _ in range(300)]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", edits.path_key(F.col("p")).alias("k")).collect()
    for r in rows:
        want = posixpath.normpath(r["p"].strip(" "))
        assert r["k"] == ("/" + want.lstrip("/") if want.startswith("/") else want), r["p"]
    stems = {"a/b.tar.gz": "a/b.tar", "a": "a", ".x": ".", "a/.x": "a", "/.x": "/", "a.b/c": "a.b/c", "..": "..", ".": "."}
    got = spark.createDataFrame([(p,) for p in stems], "p string").select("p", edits.path_stem(F.col("p")).alias("s")).collect()
    assert {r["p"]: r["s"] for r in got} == stems


def test_budget_in_order(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), i, rng.choice([None, 0, 5, 30, 80]), rng.choice([None, 1, 20])) for i in range(500)]
    got = records.fit_budget(spark.createDataFrame(rows, "k int, i int, body long, signature long"), "k", ["i"], 200, 9).collect()
    want, state = {}, {}
    for k, i, body, signature in rows:
        used, n = state.get(k, (0, 0))
        part = next((p for p, c in (("body", body), ("signature", signature)) if n < 9 and c is not None and used + c <= 200), None)
        if part:
            used, n = used + (body if part == "body" else signature), n + 1
        state[k] = used, n
        want[i] = part, used
    assert {r["i"]: (r["part"], r["used"]) for r in got} == want


def test_deeper_context(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 1), (2, 1)], "src long, tgt long")
    sizes = spark.createDataFrame([(i, 10, 1) for i in range(1, 6)], "symbol_id long, body long, signature long")
    target = spark.createDataFrame([(9, 1)], "request_id long, symbol_id long")
    plan = {r["symbol_id"]: (r["priority"], r["part"], r["truncated"]) for r in records.plan_context(target, edges, sizes, 32, 9, depth=3).collect()}
    assert plan == {1: (0, "body", False), 2: (1, "body", False), 5: (2, "body", False), 3: (3, "signature", True), 4: (4, "signature", True)}


def test_too_many_candidates_are_an_error(spark):
    symbols = spark.createDataFrame([(i, f"f{i}", "n", "class") for i in range(66)], "symbol_id long, path string, name string, kind string")
    refs = spark.createDataFrame([(1, "f0", "n")], "ref_id long, path string, name string")
    with pytest.raises(Exception, match="too many candidates"):
        records.candidates(refs, symbols, ["class"]).collect()
    assert records.candidates(refs, symbols.where("symbol_id < 65"), ["Class "]).first()["n"] == 64


def test_text_matches_and_occurrences(spark):
    df = spark.createDataFrame([("",), ("ab",), ("ab",), ("b",), (None,)], "v string")
    assert df.where(records.text_matches(F.col("v"), "", "contains")).count() == 3
    found = records.top(df.where("v is not null"), ["v"], 3).orderBy("place").collect()
    assert [(r["v"], r["occurrence"], r["truncated"]) for r in found] == [("", 1, True), ("ab", 1, True), ("ab", 2, True)]
    with pytest.raises(ValueError):
        records.with_evidence(F.col("v"), ["guess"])


@pytest.mark.parametrize("limit", [10, 1000, 1500, 5000])
def test_bounded_logs(spark, limit):
    rng = random.Random(limit)
    rows = [(k, i, bytes(rng.choices(range(256), k=rng.choice([0, 1, 40, 900])))) for k in (1, 2, 3) for i in range(2 * k)]
    got = {r["k"]: r for r in stores.bounded_log(spark.createDataFrame(rows, "k int, i int, payload binary"), "k", "i", limit).collect()}
    head = max(limit // 4, 1024)
    head = limit // 2 if head >= limit else head
    for k in (1, 2, 3):
        whole = b"".join(p for key, _, p in rows if key == k)
        if whole:
            assert (got[k]["total"], bytes(got[k]["head"]), bytes(got[k]["tail"])) == (len(whole), whole[:head], whole[head:][-(limit - head) :])


def test_positions_and_lacking_characters(spark):
    text = "aé\r\n😀b\n"
    rows = spark.createDataFrame([(i, text) for i in range(-1, len(text.encode()) + 2)], "i int, text string").select("i", edits.position(F.col("text"), F.col("i")).alias("p")).collect()
    for r in rows:
        data = text.encode()[: max(r["i"], 0)]
        try:
            head = data.decode() if 0 <= r["i"] <= len(text.encode()) else None
        except UnicodeDecodeError:
            head = None
        assert (None if head is None else (head.count("\n") + 1, len(head.rsplit("\n", 1)[-1]) + 1)) == (r["p"] and tuple(r["p"]))
    many = spark.createDataFrame([(1, text), (2, "é" * 100), (3, None), (4, "")], "id int, text string")
    found = [tuple(r) for r in edits.unrepresentable(many, "ascii", "id").where("id = 1").orderBy("line").collect()]
    assert found == [(1, 2, 1, 2, "é", "U+00E9"), (1, 2, 2, 1, "😀", "U+1F600")]
    assert edits.unrepresentable(many, "ascii", "id").where("id = 2 and total = 100").count() == 64
    assert [r["char"] for r in edits.unrepresentable(many, "iso-8859-1", "id").collect()] == ["😀"]


def test_markdown_edges(spark):
    from sparkloom.operators import markdown

    texts = spark.createDataFrame([("a", "# A\r\n#no\n####### no\n   ## B #\n~~~\n# in\n"), ("b", ""), ("c", None), ("d", "#\n# \n# A\n# A"), ("e", "[x](a#a) [y](#z) [z](mailto:q)\n```\n[in](none)\n```\n[n](none)")], "path string, text string")
    got = [tuple(r) for r in markdown.sections(texts).orderBy("path", "ln").collect()]
    assert got == [("a", 1, 7, 1, "A", None, "a"), ("a", 4, 7, 2, "B", 1, "b"), ("d", 1, 1, 1, "", None, ""), ("d", 2, 2, 1, "", None, "-1"), ("d", 3, 3, 1, "A", None, "a"), ("d", 4, 4, 1, "A", None, "a-1")]
    assert sorted(tuple(r) for r in markdown.links(texts).collect()) == [("e", 1, "a", "a"), ("e", 1, "e", "z"), ("e", 5, "none", "")]
    assert {(r["path"], r["kind"], r["detail"]) for r in markdown.diagnostics(texts, ["b"]).collect()} == {("e", "missing_document", "none"), ("e", "missing_fragment", "e#z"), ("c", "orphan", ""), ("d", "orphan", ""), ("e", "orphan", "")}


def test_more_rows_make_more_tasks(spark, monkeypatch):
    n = 400
    symbols = spark.range(n).selectExpr("id as symbol_id", "id % 7 * 20 as body", "id % 3 as signature")
    edges = spark.range(n * 5).selectExpr("id % 400 as src", "id * id % 397 as tgt").distinct()
    plan = lambda: records.plan_context(symbols.selectExpr("symbol_id as request_id", "symbol_id"), edges, symbols, 200, 6)
    small = sorted(map(tuple, plan().collect()), key=str)
    monkeypatch.setattr(records, "TASK_ROWS", 100)
    large = plan()
    assert large.rdd.getNumPartitions() >= 2 * edges.count() // 100 > 8
    assert sorted(map(tuple, large.collect()), key=str) == small and len(small) > n
