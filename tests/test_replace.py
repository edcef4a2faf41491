"""Replacements against plain Python: which way, where, and what the text becomes."""

import random
import re

import pytest

from sparkloom.operators import replace


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def indent(line):
    return re.match(r"[ \t]*", line)[0]


def rebase(new, old, base):
    out = []
    for k, line in enumerate(new):
        bare = line.lstrip(" \t")
        if k == 0:
            out.append(base + bare)
        elif k >= len(old):
            out.append(line)
        else:
            more = len(indent(line)) - len(indent(old[k]))
            out.append((base + " " * more if more >= 0 else base[: max(0, len(base) + more)]) + bare)
    return out


def plain(text, old, new, similarity):
    if not old:
        return None, "nothing sought"
    if old in text:
        return text.replace(old, new, 1), "exact"
    lines, sought, put = text.split("\n"), old.split("\n"), new.split("\n")
    n = len(sought)
    windows = range(max(0, len(lines) - n + 1))
    for i in windows:
        if [x.strip() for x in lines[i : i + n]] == [x.strip() for x in sought]:
            return "\n".join(lines[:i] + rebase(put, sought, indent(lines[i])) + lines[i + n :]), "trimmed"
    if similarity is None:
        return None, "not found"
    flat = lambda rows: "\n".join(" ".join(r.split()) for r in rows)
    scores = []
    for i in windows:
        a, b = flat(sought), flat(lines[i : i + n])
        longest = max(len(a), len(b))
        if longest and distance(a, b) <= int((1 - similarity) * longest):
            scores.append((1 - distance(a, b) / longest, i))
    if not scores:
        return None, "not found"
    best = max(scores)[0]
    hits = [i for s, i in scores if s >= best - 1e-12]
    if len(hits) > 1:
        return None, "several windows are equally alike"
    i = hits[0]
    made = rebase(put, sought, indent(lines[i]))
    if not put[0]:
        made[0] = ""
    return "\n".join(lines[:i] + made + lines[i + n :]), "similar"


@pytest.mark.parametrize("similarity", [None, 0.5, 0.75, 1.0])
def test_cascade(spark, similarity):
    rng = random.Random(6)
    word = lambda: rng.choice(["alpha", "beta  x", "gamma", "", "délta", "ep silon", "the same line", "the sane line"])
    line = lambda: rng.choice(["", "  ", "\t", "    "]) + word() + rng.choice(["", " ", "\t"])
    rows = []
    for k in range(250):
        lines = [line() for _ in range(rng.randint(0, 9))]
        at = rng.randint(0, max(0, len(lines) - 1))
        old = lines[at : at + rng.randint(1, 3)]
        if k % 3 == 1:
            old = ["  " + x.strip() for x in old]
        if k % 3 == 2:
            old = ["".join(c if rng.random() < 0.85 else rng.choice("xyé") for c in x) for x in old]
        rows.append((k, "\n".join(lines), "\n".join(old), "\n".join(line() for _ in range(rng.randint(1, 4)))))
    got = replace.replace_text(spark.createDataFrame(rows, "k int, text string, old string, new string"), "text", "old", "new", similarity).collect()
    ways = set()
    for r in got:
        text, how = plain(r["text"], r["old"], r["new"], similarity)
        assert (r["got"]["text"], r["got"]["error"] or r["got"]["how"]) == (text, how), r
        ways.add(how)
    assert {"exact", "trimmed", "not found"} <= ways and (similarity != 0.75 or "similar" in ways and "several windows are equally alike" in ways)


def test_edges(spark):
    rows = [("a\r\nb\r\n", "a\nb", "c\nd"), ("a\r\nb\n", "b", "c"), (None, "a", "b"), ("a", None, "b"), ("a", "", "b"), ("x", "x\ny", "z"), ("a.b a.b", "a.b", "$1\\"), ("z\n" * 10_001, "qq", "r"), ("y\n" * 3 + "y", "w" * 4097, "r"), ("abcdefgh" * 60 + "\n" + "abcdefg\n" * 3000, "abcdefgx" * 60, "r")]
    got = [r["got"] for r in replace.replace_text(spark.createDataFrame(rows, "text string, old string, got_new string"), "text", "old", "got_new", 0.6).collect()]
    assert [g["text"] for g in got] == ["c\r\nd\r\n", "a\nc\n", None, None, None, None, "$1\\ a.b", None, None, None]
    assert [g["error"] for g in got] == [None, None, None, None, "nothing sought", "not found", None, "too many windows", "too long a passage", "too many comparisons"]
    with pytest.raises(ValueError):
        replace.replace_text(spark.createDataFrame(rows, "text string, old string, n string"), "text", "old", "n", 0.4)
