"""Markdown against a plain reader, line by line."""

import posixpath
import random
import re

from sparkloom.operators import markdown
from sparkloom.plans import record_queries

LINK = re.compile(r"""\[[^\]]*\]\(\s*(?:<([^<>]*)>|([^)\s]+))(?:\s+(?:"[^"]*"|'[^']*'|\([^()]*\)))?\s*\)""")


def read(path, text):
    """(sections, links) of a text."""
    lines, mark, heads, links = [x.removesuffix("\r") for x in text.split("\n")], "", [], []
    for ln, line in enumerate(lines, 1):
        fence = re.match(r"( {0,3})(`{3,}|~{3,})(.*)$", line, re.S)
        if fence and fence[2][0] == "`" and "`" in fence[3]:
            fence = None
        if fence:
            if not mark:
                mark = fence[2]
            elif fence[2].startswith(mark) and not fence[3].strip(" \t"):
                mark = ""
            continue
        if mark:
            continue
        if re.match(r" {0,3}#{1,6}(?:[ \t]|$)", line):
            hashes = re.match(r" {0,3}(#+)[ \t]*(.*)$", line, re.S)
            title = re.sub(r"(?:^|[ \t]+)#*[ \t]*$", "", hashes[2])
            heads.append((ln, len(hashes[1]), title, "".join(c for c in title.lower() if c.isalnum() or c in "_- ").replace(" ", "-")))
        bare = re.sub(r"!\[[^\]]*\]\([^()]*\)", "", re.sub(r"(?<!`)(`+)(?!`).*?(?<!`)\1(?!`)", "", line))
        for m in LINK.finditer(bare):
            href = (m[1] or "") + (m[2] or "")
            if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:|//", href):
                continue
            target, _, name = href.partition("#")
            where = path if not target else posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(posixpath.dirname(path), target))
            links.append((path, ln, where, name))
    names, used = [], set()
    for *_, slug in heads:
        name, n = slug, 0
        while name in used:
            n += 1
            name = f"{slug}-{n}"
        used.add(name)
        names.append(name)
    out = []
    for k, (ln, level, title, _) in enumerate(heads):
        end = next((h[0] - 1 for h in heads[k + 1 :] if h[1] <= level), len(lines))
        up = next((h[0] for h in reversed(heads[:k]) if h[1] < level), None)
        out.append((path, ln, end, level, title, up, names[k]))
    return out, links


def check(spark, rows):
    table = spark.createDataFrame(rows, "path string, text string")
    want = [read(p, t) for p, t in rows if t is not None]
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(tuple, markdown.sections(table).collect()), key=key) == sorted((s for ss, _ in want for s in ss), key=key)
    assert sorted(map(tuple, markdown.links(table).collect())) == sorted(link for _, ls in want for link in ls)


def test_random_texts(spark):
    rng = random.Random(2)
    lines = ["# a", "# a", "## a-1", "# A-1 #", "### b c ##", "#", "#x", "####### no", "   ## in", "    # no", "```", "````", "~~~", "~~~ py", "``` `x", "```  ", " ~~~~", "text", "", "[l](b.md)", "[l](../c.md#a 't')", '![i](x.png) [k](<a b.md> "q")', "`[c](no)` [d](#a) ``[e](`no`)``", "[w](http://x/y) [v](/top.md) [u](./d/../e.md)", "[![i](p.png)](z.md)", "# é Ö!\r", "## c d\t#"]
    check(spark, [(f"d{k % 3}/f{k}.md", "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 25)))) for k in range(150)] + [("n", None), ("e", "")])


def test_review_cases(spark):
    got = [r["title"] for r in markdown.sections(spark.createDataFrame([("a", "```\n# in\n~~~\n# x\n```\n# out")], "path string, text string")).collect()]
    assert got == ["out"]
    got = [r["fragment"] for r in markdown.sections(spark.createDataFrame([("a", "# foo\n# foo\n# foo-1")], "path string, text string")).orderBy("ln").collect()]
    assert got == ["foo", "foo-1", "foo-1-1"]
    assert markdown.number_until_free(["a-1", "a", "a", "a"]) == ["a-1", "a", "a-2", "a-3"]


def test_documents_as_a_workspace(spark):
    rows = [(r["path"], r["text"]) for r in record_queries._workspace(spark, "/root/testdata/sf0.001").collect()]
    assert sum(len(read(p, t)[0]) for p, t in rows) > 300
    check(spark, rows)
