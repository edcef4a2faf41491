"""Scopes and regions against a plain stack."""

import random
import re

from sparkloom.operators import regions


def stack_pairs(events):
    stack, partner = [], {}
    for at, label, opens in events:
        if not label or not label.strip():
            continue
        if opens:
            stack.append((at, label))
        elif stack and stack[-1][1] == label:
            partner[at], partner[stack[-1][0]] = stack[-1][0], at
            stack.pop()
    return partner


def parents(events, partner):
    out, inside = {}, []
    for at, _, opens in events:
        if at in partner and not opens:
            inside.pop()
        out[at] = inside[-1] if inside else None
        if at in partner and opens:
            inside.append(at)
    return out


def test_pairs_and_parents(spark):
    rng, rows = random.Random(5), []
    for key in range(60):
        n = rng.randint(0, 60)
        rows += [(key, 3 * i, rng.choice(["a", "b", "c", " ", None]) if key % 2 else rng.choice("ab"), rng.random() < 0.5) for i in range(n)]
    rows += [(100, i, "x", i < 40) for i in range(80)]  # deep: several passes
    got = regions.with_parents(regions.pair_scopes(spark.createDataFrame(rows, "k bigint, at int, label string, open boolean"), "k", 2), "k").collect()
    assert len(got) == len(rows)
    by = {}
    for k, at, label, opens in rows:
        by.setdefault(k, []).append((at, label, opens))
    for k, events in by.items():
        partner = stack_pairs(events)
        above = parents(events, partner)
        for r in (r for r in got if r["k"] == k):
            assert r["partner"] == partner.get(r["at"]) and r["parent"] == above[r["at"]], (k, r)


HTML = [
    "", "no tags", "<!-- only", "<p>a<!-- x --><script>if (a<b) '</p>'</script></p>", "<SCRIPT src=x>é</Script ><style>a", "<div><p>é<b>x</div></b></p></div>",
    "<br><img src=a/><hr/><i/>x", "<a><!--<b>--></a><!---->", "<script></script><script>", "</p></p><p>", None,
]


def test_segments_cover_the_text(spark):
    rows = list(enumerate(HTML))
    table = spark.createDataFrame(rows, "k int, text string")
    got = {}
    for r in regions.segments(table, "k").orderBy("k", "start").collect():
        got.setdefault(r["k"], []).append(r)
    for k, text in rows:
        raw, own = (text or "").encode(), got.get(k, [])
        assert b"".join(raw[r["start"] : r["end"]] for r in own) == raw
        for r in own:
            piece = raw[r["start"] : r["end"]].decode().lower()
            assert r["kind"] == ("comment" if piece.startswith("<!--") else "script" if piece.startswith("<script") else "style" if piece.startswith("<style") else "host")
    flags = {(r["k"], r["kind"]): r["closed"] for own in got.values() for r in own if r["kind"] != "host"}
    assert flags[2, "comment"] is False and flags[4, "style"] is False and flags[3, "script"] and flags[7, "comment"]


def test_scopes(spark):
    table = spark.createDataFrame(list(enumerate(HTML)), "k int, text string")
    got = {(r["k"], r["start"]): r for r in regions.scopes(table, "k").collect()}
    token = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<script\b[^<>]*>.*?(?:</script\s*>|\Z)|<style\b[^<>]*>.*?(?:</style\s*>|\Z)|</?([a-zA-Z][a-zA-Z0-9]*)\b[^<>]*>")
    seen = 0
    for k, text in enumerate(HTML):
        events, spans = [], []
        for m in token.finditer(text or ""):
            span = tuple(len((text or "")[:p].encode()) for p in m.span())
            label = (m[1] or "").lower()
            single = not label or label in regions.VOID or m[0].endswith("/>")
            events.append((len(spans), "" if single else label, not m[0].startswith("</")))
            spans.append((span, m[0], label, single))
        partner = stack_pairs(events)
        above = parents(events, partner)
        for at, ((start, end), raw, label, single) in enumerate(spans):
            if single and label or at in partner and not events[at][2]:
                assert (k, start) not in got
                continue
            r = got[k, start]
            seen += 1
            assert r["end"] == (spans[partner[at]][0][1] if at in partner else end)
            assert r["parent"] == (None if above[at] is None else spans[above[at]][0][0])
            want = "element" if at in partner else ("unclosed" if events[at][2] else "stray") if label else next(n for n in ("comment", "script", "style") if raw.lower().startswith({"comment": "<!--"}.get(n, f"<{n}")))
            assert r["kind"] == want and r["label"] == (label or None)
    assert seen == len(got)
