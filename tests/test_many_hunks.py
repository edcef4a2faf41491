"""Patches of any number of hunks apply, and are told wrong where they are first wrong."""

import random

from pyspark.sql import functions as F

from sparkloom.operators import edits
from sparkloom.plans import record_queries

HEAD = "--- a/p\n+++ b/p\n"


def changed(k: int, shift: dict[int, int]) -> tuple[str, str, str]:
    """A text of k pairs of lines, its patch of k hunks that put one, two or no lines for each first line, and the new text.

    shift: what is added to the new start of a hunk, by its number.
    """
    old, new, hunks = [], [], []
    for i in range(k):
        put = [f"new {i}"] * (i % 3)
        start = len(new) + (1 if put else 0) + shift.get(i, 0)
        hunks.append(f"@@ -{2 * i + 1} +{start},{len(put)} @@\n-a {i}\n" + "".join(f"+{x}\n" for x in put))
        old += [f"a {i}", f"b {i}"]
        new += [*put, f"b {i}"]
    return "\n".join(old), HEAD + "".join(hunks), "\n".join(new)


def test_all_hunks_of_a_document(spark, tmp_path):
    text = "\n".join(f"{'e' if i % 8 == 0 else 'x'} {i}" for i in range(8 * 1100))
    spark.createDataFrame([(1, text), (2, "e"), (3, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = record_queries.patch_round_trip(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_hunks"], r["same"], r["error"]) for r in rows) == [(1, 1100, True, None), (2, 1, True, None)]


def test_as_many_hunks_as_there_are(spark):
    made = [(k, *changed(k, {})) for k in (1, 2, 1000, 1001, 20000)]
    got = edits.apply_patches(spark.createDataFrame(made, "k int, old string, patch string, new string"), "old", "patch")
    rows = got.select("k", (F.col("got.text") == F.col("new")).alias("same"), "got.error").collect()
    assert sorted((r["k"], r["same"], r["error"]) for r in rows) == [(k, True, None) for k, *_ in made]


def test_the_first_wrong_new_start(spark):
    rng, made, want = random.Random(11), [], {}
    for n in range(60):
        k = 1300 if n == 0 else rng.randint(1, 40)
        first = 1200 if n == 0 else rng.randrange(k)
        # All hunks from the first wrong one, it alone, or some of the later ones too.
        later = [range(first, k), [first], [first, *rng.sample(range(first, k), rng.randint(0, k - first))]][n % 3]
        old, patch, _ = changed(k, dict.fromkeys(later, rng.choice([1, 2, 7])))
        made.append((n, old, patch))
        line = patch.split("\n").index(next(x for x in patch.split("\n") if x.startswith(f"@@ -{2 * first + 1} "))) + 1
        want[n] = (None, f"hunk at line {line}: another new start")
    got = edits.apply_patches(spark.createDataFrame(made, "n int, old string, patch string"), "old", "patch").collect()
    assert {r["n"]: tuple(r["got"]) for r in got} == want
