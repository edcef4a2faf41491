"""Hard negatives, exact deduplication and spelling variants against brute-force versions."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, hard_negatives, spelling
from sparkloom.llm.common import Scratch

# --- hard negatives


def brute_negatives(rows, every=50):
    """rows: (vec_id, label, vector)."""
    own = []
    for i, k, v in rows:
        if i is None or k is None or v is None or any(x is None or not np.isfinite(x * 256.0) for x in v):
            continue
        own.append((i, k, [int(np.floor(256.0 * x)) for x in v]))
    out = []
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))
    for i, k, v in own:
        if i % every:
            continue
        others = [(-dot(v, w), j, m == k) for j, m, w in own if j != i and len(w) == len(v)]
        for s, j, _ in sorted(o for o in others if o[2])[:5]:
            fit = sorted((t, n) for t, n, same in others if not same and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows):
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumns({"row": F.lit("x"), "part": F.lit(1), "no": F.lit(2)})
    got = hard_negatives.mine(spark, table, F.col("vec_id") % 50 == 0, Scratch(spark, "t"))
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("small_blocks", [False, True])
def test_hard_negatives(spark, monkeypatch, small_blocks):
    if small_blocks:
        for name, value in (("BLOCK", 32), ("ANCHORS", 3), ("TOGETHER", 2), ("LABELS", 3), ("FEWEST", 7)):
            monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((12, 9))[rng.integers(0, 12, 700)] * 0.3 + 0.1 * rng.standard_normal((700, 9))
    x[200:420] = x[200] + 0.004 * rng.standard_normal((220, 9))  # a third alike, with many equal scores
    rows = [(i, int(rng.integers(0, 4)), v.tolist()) for i, v in enumerate(x)]
    rows += [(50, 1, x[3].tolist()), (50, 2, x[4].tolist()), (61, 2, x[4].tolist()), (61, 2, x[4].tolist())]  # repeated ids
    rows += [(800, None, x[0].tolist()), (850, 1, None), (900, 1, [float("nan")] * 9), (950, 1, [None] * 9), (None, 1, x[1].tolist())]
    rows += [(1000, 1, [0.0] * 9), (1050, 1, []), (1051, 1, []), (1052, 2, []), (1100, 0, [0.5, 0.5]), (1101, 0, [0.5, 0.25]), (1102, 1, [0.25, 0.5]), (1103, 3, [0.3, 0.2])]
    assert mined(spark, rows) == brute_negatives(rows)


def test_hard_negatives_of_large_numbers_and_few_rows(spark):
    rng = np.random.default_rng(9)
    for scale in (1e9, 1e160):
        rows = [(i, i % 2, (scale * rng.standard_normal(3)).tolist()) for i in range(60)]
        assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, []) == [] and mined(spark, [(0, 1, [1.0])]) == [] and mined(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 0, [0.9])]) == [(0, 1, 1, 2, 65536, 58880)]


def test_brackets_hold():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.standard_normal((300, 8)))
    pivots = hard_negatives.choose_pivots(x, hard_negatives.norms(x).max(), 6)
    d = pivots.distances(pivots.augmented(x))
    q = x[:20]
    dq = pivots.distances(np.hstack([q, np.zeros((20, 1))]))
    scores, table = q @ x.T, hard_negatives.Table(8, 1, pivots, np.zeros(0), np.zeros((0, 6)), np.zeros((0, 6)), np.zeros((0, 2)))
    for low, high in ((0.0, 4e5), (1e5, 1.1e5), (-1e6, 0.0)):
        inner, outer = table.radii(hard_negatives.norms(q), np.full(20, low), np.full(20, high))
        may = (np.abs(dq[:, None] - d[None]) <= outer[:, None, None]).all(2) & (dq[:, None] + d[None] >= inner[:, None, None]).all(2)
        assert not ((scores >= low) & (scores <= high) & ~may).any()
    assert ((np.abs(dq[:, None] - d[None]) <= table.radii(hard_negatives.norms(q), np.full(20, 4e5), np.full(20, 1e9))[1][:, None, None]).all(2)).mean() < 1  # they do leave rows out


# --- exact deduplication

TEXTS = [None, "", " ", "\t\n", "a b", "a  b", "a\r\n\x0b\x0cb", "a b", "A b", "x" * 100_000, "x" * 100_000, "é", "é", "a b ", "a\x00b"]


def brute_groups(rows):
    of = {}
    for n, (i, t) in enumerate(rows):
        of.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((i is None, i or 0, n))
    out = []
    for body, own in of.items():
        first = min(own)
        for missing, i, n in own:
            out.append((None if missing else i, None if first[0] else first[1], len(own), (missing, i, n) == first, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    rows = list(enumerate(TEXTS)) + [(3, "a b"), (3, "a b"), (None, "a b"), (None, "only here"), (None, "only here"), (20, "q"), (20, "q"), (20, "r")] + [(100 + i, f"t {i % 7}") for i in range(90)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"row": F.lit(1), "hash": F.lit("x"), "first": F.lit(None).cast("int")}).repartition(5)
    hashed = lambda t: F.pmod(F.xxhash64(t), F.lit(3)).cast("string").cast("binary")  # noqa: E731  nearly all texts collide
    got = exact_dedup.dedup(spark, table, Scratch(spark, "t"), **({"hashed": hashed} if weak else {}))
    assert dict(got.dtypes) == {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"}
    assert sorted(map(tuple, got.collect()), key=repr) == brute_groups(rows)
    assert exact_dedup.dedup(spark, table.limit(0), Scratch(spark, "t")).count() == 0


def test_exact_dedup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SMALL", 0)
    rows = [(i, f"t {i % 5}") for i in range(40)] + [(90, "once")]
    assert sorted(map(tuple, exact_dedup.dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), Scratch(spark, "t")).collect()), key=repr) == brute_groups(rows)


# --- spelling variants


def brute_variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    of = {w: [v for v in known if near(w, v)] for w in known}
    best = {w: min(vs, key=lambda v: (-known[v], v)) for w, vs in of.items() if vs}
    form = {w: v for w, v in best.items() if known[v] >= 2 * known[w]}
    out = []
    for w, n in known.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(of[w]), form.get(w), known[form[w]] if w in form else None, root))
    return sorted(out)


def found(spark, rows, **options):
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"word": F.lit("x"), "n": F.lit(1)})
    got = spelling.variants(spark, table, Scratch(spark, "t"), **options).select("word", "n", "n_near", "form", "form_n", "root")
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("crowded", [1, 4, 1000])
def test_spelling(spark, monkeypatch, crowded):
    monkeypatch.setattr(spelling, "PIECE", 500)
    monkeypatch.setattr(spelling, "MANY", 20)
    rng = np.random.default_rng(4)
    base = ["colour", "theatre", "élève", "straße", "aaaaa", "bananas", "Àÿþðø", "international"]
    letters = list("abeorstéÿ")

    def edit(w):
        k, c = int(rng.integers(0, len(w))), str(rng.choice(letters))
        return (w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :])[int(rng.integers(0, 3))]

    pool = base * 40 + [edit(w) for w in base for _ in range(60)] + [edit(edit(w)) for w in base for _ in range(60)]
    rows = [(int(i), " ".join(rng.choice(pool, 60))) for i in range(120)]
    rows += [(None, "colour COLOUR Colour"), (5, None), (6, ""), (7, "x" * 3000 + " theatre"), (5, "colour"), (5, "colour"), (8, "İstanbul Ünïcode naïve-colour_colour9theatre ıſK"), (9, "×÷×÷× ×÷×÷× ×÷×÷÷ ×÷×÷× ×÷×÷÷ ×÷×÷÷")]
    assert found(spark, rows, crowded=crowded) == brute_variants(rows)


def test_spelling_of_nothing_and_long_chains(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, "ab cd")]) == []
    # Each word is one edit from the next, which is twice as common.
    chain = ["aaaaaaaaaaaa"[: 12 - k] + "b" * k for k in range(12)]
    rows = [(1000 + k, f"{w} " * (3 * 2**k)) for k, w in enumerate(chain)]
    got = found(spark, rows)
    assert got == brute_variants(rows) and {r[5] for r in got if r[0] in chain} <= {chain[-1], *chain} and sum(r[5] == chain[-1] for r in got) >= 8


def test_one_edit_leaves_a_band(spark):
    """Two words within one edit share a band: a check of the bound itself."""
    words = ["abcde", "abcd", "abxde", "zabcde", "éabcd", "ÿabcd", "aabbc", "abbc"]
    rows = spark.createDataFrame([(w,) for w in words], "word string").select("word", *[spelling.band("word", k).alias(f"m{k}") for k in range(3)]).collect()
    mask = {r["word"]: (r["m0"], r["m1"], r["m2"]) for r in rows}
    for a, b in itertools.combinations(words, 2):
        if abs(len(a) - len(b)) <= 1 and spark.range(1).select(F.levenshtein(F.lit(a), F.lit(b))).first()[0] == 1:
            assert any(x == y for x, y in zip(mask[a], mask[b], strict=True))
            assert sum(bin(x ^ y).count("1") for x, y in zip(mask[a], mask[b], strict=True)) <= 2
