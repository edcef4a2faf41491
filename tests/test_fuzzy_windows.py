"""The first line of a text against all its other lines, whole; the SQL, of two shortened lines, holds where nothing is shortened."""

import random
import re

import duckdb

from sparkloom import catalog
from sparkloom.operators import search

FOLDER = "/root/testdata/sf0.001"


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def by_hand(text: str, sought: str) -> list[tuple]:
    own, wanted = re.sub(r"\r(\n|\Z)", r"\1", text).split("\n"), re.sub(r"\r(\n|\Z)", r"\1", sought).split("\n")
    plain = lambda lines: "\n".join(" ".join(x.split()) for x in lines)
    out = []
    for i in range(len(own) - len(wanted) + 1):
        window = own[i : i + len(wanted)]
        x, y = plain(window), plain(wanted)
        out.append((i + 1, edits("\n".join(window), "\n".join(wanted)), round(1 - edits(x, y) / max(len(x), len(y), 1), 6)))
    return out


def test_windows_by_brute_force(spark):
    far = "a" * 230
    texts = {
        1: ("città\ncitta\nCittà del Vaticano\n\n  città", "città"),
        2: (f"{far}xyz\n{far}\nx", f"{far}zyx"),  # differ after 200 characters only
        3: ("one\r\ntwo\tthree\r\nfour\r\none\r\ntwo  three", "one\ntwo three"),
        4: ("only", "two\nlines"),
        5: ("Привет\nпривет 🌍\n中文", "привет 🌍"),
    }
    found = search.fuzzy_windows(spark.createDataFrame([(k, *v) for k, v in texts.items()], "doc_id bigint, text string, sought string"), "doc_id")
    got = sorted((r["doc_id"], r["ln"], r["distance"], round(r["similarity"], 6)) for r in found.collect())
    assert got == sorted((k, *w) for k, v in texts.items() for w in by_hand(*v))


def test_all_lines_of_every_document(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{FOLDER}/documents.parquet')")
    docs = con.execute("select doc_id, text from documents").fetchall()
    got = {(r["doc_id"], r["ln"]): (r["distance"], r["similarity"]) for r in catalog.QUERIES["fuzzy_match"](spark, FOLDER).collect()}
    assert set(got) == {(k, n) for k, t in docs for n in range(2, t.count("\n") + 2)}
    checked = 0
    for k, t in docs:
        first, *others = t.split("\n")
        for n, line in enumerate(others, 2):
            if len(first) * len(line) < 20_000 or n == 2 and 200 < len(line) and len(first) * len(line) < 60_000:
                assert got[k, n] == by_hand(line, first)[0][1:]
                checked += 1
    assert checked > 200


def test_edits_by_brute_force():
    draw = random.Random(5)
    for n in [*range(12), 40, 70, 130] * 8:
        a = "".join(draw.choice("abé🌍 ") for _ in range(n))
        b = "".join(c for c in a if draw.random() < 0.8) + draw.choice(["", "b", "🌍a"])
        assert search.edits(a, b) == search.edits(b, a) == edits(a, b)
    assert search.edits(None, "a") is search.edits("a", None) is None


def test_no_table_of_two_lines_is_filled_cell_by_cell(spark):
    plan = catalog.QUERIES["fuzzy_match"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "levenshtein" not in plan and "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
