"""The stages of the pipeline against plain Python versions, on odd rows, and the whole on a small corpus."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as p
from sparkloom.llm import lang_id
from sparkloom.llm.queries import PIECE_BPE

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(p.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with odd rows, repeated ids and columns named as the stages name theirs."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [(None, None, None, None, None), (10**9, "", "en", None, 0), (0, "the same id again", "en", "src0", 17), (10**9 + 1, "x", None, "src1", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    return docs.withColumns({c: F.lit(i) for i, c in enumerate("gone copy rows place again size copies stats score language taken target n key count component_id".split())}).cache()


def words(text):
    return (text or "").replace("\x0b", " ").split() if text else []


def test_stages_keep_columns(spark, docs):
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert 0 < out.select("doc_id").distinct().count() <= docs.count(), name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name


def test_language(spark, docs):
    """Naive Bayes by loops over the same n-gram buckets."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    counts, n = defaultdict(Counter), Counter()
    grams = lambda t: Counter(b for part in lang_id.gram_buckets(t or "", lang_id.BUCKET_BITS) for b in part.tolist())
    for _, t, k in rows:
        if t is not None and k is not None:
            n[k] += 1
            counts[k].update(grams(t))
    total = {k: sum(c.values()) for k, c in counts.items()}
    kept = []
    for i, t, _ in rows:
        own = grams(t)
        if own:
            joint = {k: np.log(n[k] / sum(n.values())) + sum(m * (np.log(counts[k][b] + 0.5) - np.log(total[k] + 0.5 * 2**lang_id.BUCKET_BITS)) for b, m in own.items()) for k in n}
            top = max(joint.values())
            if 1 / sum(np.exp(v - top) for v in joint.values()) >= p.LANGUAGE_SCORE:
                kept.append((i, t))
    got = [(r["doc_id"], r["text"]) for r in STAGES["language_id"](spark, docs, FOLDER).select("doc_id", "text").collect()]
    assert Counter(got) == Counter(kept)


def test_quality(spark, docs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in STAGES["quality"](spark, docs, FOLDER).select("doc_id").collect()}
    good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
    assert len(kept & set(good)) >= 0.95 * len(good) and len(kept & set(bad)) <= 0.3 * len(bad)


def test_near_duplicates(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = []
    for _, t in rows:
        w = [x.lower() for x in words(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    of = {i: i for i, _ in rows if i is not None}
    root = lambda i: i if of[i] == i else root(of[i])
    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            if i is not None and j is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(i), root(j)))
                of[y] = x
    want = sorted(str(i) for i in [*(i for i in of if root(i) == i), *(i for i, _ in rows if i is None)])
    got = STAGES["near_duplicates"](spark, docs, FOLDER).select("doc_id", "text").collect()
    assert sorted(str(r["doc_id"]) for r in got) == want
    assert {(r["doc_id"], r["text"]) for r in got} <= set(rows)


def targets(size):
    """Shares by weight 5, 2, 1, the excess over 3 times a source's size reshared until there is none."""
    order = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    fixed = {}
    while True:
        rest = sum(size.values()) - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * size[s] for s in over}


def test_mixing(spark, docs):
    rows = docs.select("doc_id", "source", "text").collect()
    size, most = Counter(), Counter()
    for r in rows:
        size[r["source"]] += len(words(r["text"]))
        most[r["source"]] = max(most[r["source"]], len(words(r["text"])))
    got = STAGES["mixing"](spark, docs, FOLDER).select("doc_id", "source", "text").collect()
    taken = Counter()
    for r in got:
        taken[r["source"]] += len(words(r["text"]))
    for s, target in targets(size).items():
        assert abs(taken[s] - target) <= 3 * most[s], s
    had = Counter(map(tuple, rows))
    assert all(n <= 3 * had[r] for r, n in Counter(map(tuple, got)).items())


def test_run(spark):
    rows = p.run(spark, FOLDER).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) > 50 and max(Counter(r["doc_id"] for r in rows).values()) <= 3
    for r in rows:
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(r["ids"]).encode()).hexdigest()


def test_near_duplicates_with_columns_without_an_order(spark):
    """Rows that share a doc_id, and columns of any type: one row of each id stays, with all its columns."""
    rows = [(1, "one two three four five six"), (1, "other words stand here in this row"), (2, "a b c d e f g"), (2, "a b c d e f g"), (None, "x"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1), "Rows": F.create_map(F.lit("a"), F.lit(1)), "place": F.parse_json(F.lit("[1]"))})
    got = p.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 0, 1, 2]
