"""Admission against a queue worked off one by one; digests and error collections against plain versions."""

import hashlib
import random

import pytest

from sparkloom.operators import admission, digests


def serial(tasks, held, concurrency):
    out, taken, started = {}, set(held), 0
    for task, _, starts, locks in sorted(tasks, key=lambda t: (t[1], t[0])):
        if started >= concurrency:
            out[task] = "waiting"
        elif starts >= 8:
            out[task] = "failed"
        elif taken & set(locks or []):
            out[task] = "locked"
        else:
            taken |= set(locks or [])
            out[task], started = "started", started + 1
    return out


@pytest.mark.parametrize(("n", "keys", "concurrency"), [(60, 8, 1000), (120, 60, 1000), (80, 30, 7), (40, 1, 3), (0, 1, 3)])
def test_admission(spark, n, keys, concurrency):
    rng = random.Random(n + keys)
    tasks = [(i, rng.randint(0, 20), rng.choice([0, 1, 7, 8, 9]), rng.choice([None, [], *[[f"k{rng.randrange(keys)}" for _ in range(rng.randint(1, 3))] for _ in range(5)]])) for i in range(n)]
    held = ["k0", "k0"] if keys > 1 else []
    got = admission.admit(spark.createDataFrame(tasks, "task_id int, created_at int, starts int, locks array<string>"), spark.createDataFrame([(k,) for k in held], "lock string"), concurrency)
    assert {r["task_id"]: r["decision"] for r in got.collect()} == serial(tasks, held, concurrency)


def test_a_chain_of_locks(spark):
    tasks = [(i, i, 0, [f"k{i}", f"k{i + 1}"]) for i in range(12)]
    got = admission.admit(spark.createDataFrame(tasks, "task_id int, created_at int, starts int, locks array<string>"), spark.createDataFrame([], "lock string"), 100)
    assert {r["task_id"]: r["decision"] for r in got.collect()} == serial(tasks, [], 100)


def plain_digest(records, fan):
    level, height = [hashlib.sha256(r).hexdigest() for _, r in sorted(records)], 0
    frame = lambda *parts: b"".join(len(p).to_bytes(8, "big") + p for p in parts)
    n = len(level)
    while True:
        height += 1
        level = [hashlib.sha256(frame(str(height).encode()) + b"".join(map(bytes.fromhex, level[i : i + fan]))).hexdigest() for i in range(0, len(level), fan)]
        if len(level) == 1:
            return hashlib.sha256(frame(b"root", str(n).encode(), level[0].encode())).hexdigest()


@pytest.mark.parametrize("parts", [1, 7])
def test_tree_digest(spark, parts):
    rows = [(g, f"p{i:04d}", f"{g}/{i}".encode()) for g, n in (("a", 1), ("b", 4), ("c", 5), ("d", 90)) for i in range(n)]
    random.Random(1).shuffle(rows)
    for fan in (4, 1024):
        got = {r["g"]: (r["n"], r["digest"]) for r in digests.tree_digest(spark.createDataFrame(rows, "g string, path string, record binary").repartition(parts), "g", "path", "record", fan).collect()}
        own = {g: [(p, r) for k, p, r in rows if k == g] for g in "abcd"}
        assert got == {g: (len(o), plain_digest(o, fan)) for g, o in own.items()}


def test_framing(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc")], "x string, y string").select(digests.framed(F.col("x"), F.col("y")).alias("f")).collect()
    assert len({bytes(r["f"]) for r in rows}) == 3


def test_collected_errors(spark):
    rng = random.Random(4)
    rows = [(g, i, "p" * rng.choice([1, 5, 90]), rng.choice(["E", "LONGER", None])) for g in (1, 2) for i in range(200)] + [(3, 0, "x" * 5000, "E")]
    for budget, most in ((700, 64), (100_000, 5), (10, 64), (3000, 64)):
        got = {r["g"]: r for r in digests.collect_errors(spark.createDataFrame(rows, "g int, at int, path string, code string"), "g", "at", ["path", "code"], budget, most).collect()}
        for g in (1, 2, 3):
            used, kept = 0, []
            own = [r for r in rows if r[0] == g]
            for _, i, path, code in own:
                cost = digests.DETAIL_COST + len(path) + len(code or "")
                if len(kept) < most and cost <= budget - used:
                    used, kept = used + cost, [*kept, i]
            assert [d["at"] for d in got[g]["kept"]] == kept and got[g]["total"] == len(own) and got[g]["omitted"] == len(own) - len(kept)
