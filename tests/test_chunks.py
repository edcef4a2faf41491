"""Files in chunks cut anywhere give what whole files give."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import chunks as ch
from sparkloom.operators import detect as dt

TEXTS = ["", "a", "\r", "\n", "\r\n", "\r\r\n\n", "x\r\ny\nz\r", "été \r\n 你好 🌍\r\n\U0010ffff", "plain ascii, and more of it. " * 9, "ÿ" * 70, "🌍🌎🌏" * 30]
BROKEN = [b"\xff", b"ab\xc3", b"\xe2\x82", b"\xf0\x9f\x8c", b"\xc0\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"ok\x80", b"\xe0\x80\x80", b"\xf0\x80\x80\x80", b"a\xf1\x80\x80b", b"\xc3\xa9\xa9"]


def table(spark, files, seed, most=5):
    """Each file in random cuts, some of them empty."""
    rng, rows = random.Random(seed), []
    for k, raw in enumerate(files):
        at = no = 0
        while at < len(raw) or no == 0:
            n = rng.randint(0, most)
            rows.append((k, no, at, bytearray(raw[at : at + n])))
            at, no = min(len(raw), at + n), no + rng.randint(1, 2)  # gaps
    return spark.createDataFrame(rows, "f bigint, no bigint, offset bigint, content binary").repartition(3)


@pytest.mark.parametrize(("seed", "most", "fan"), [(1, 1, 3), (2, 5, 4), (3, 40, 64)])
def test_endings_and_utf8(spark, seed, most, fan):
    raws = [t.encode() for t in TEXTS] + BROKEN
    t = table(spark, raws, seed, most)
    got = ch.convert_endings(t, "f", "\n", fan).groupBy("f").agg(F.array_sort(F.collect_list(F.struct("no", "content"))).alias("p"), F.sum("lf").alias("lf"), F.sum("crlf").alias("crlf")).collect()
    assert len(got) == len(raws)
    for r in got:
        raw = raws[r["f"]]
        assert b"".join(bytes(p["content"]) for p in r["p"]) == raw.replace(b"\r\n", b"\n")
        assert r["crlf"] == raw.count(b"\r\n") and r["lf"] == raw.count(b"\n") - r["crlf"]
    back = ch.convert_endings(t, "f", "\r\n", fan).groupBy("f").agg(F.array_sort(F.collect_list(F.struct("no", "content"))).alias("p")).collect()
    assert all(b"".join(bytes(p["content"]) for p in r["p"]) == raws[r["f"]].replace(b"\r\n", b"\n").replace(b"\n", b"\r\n") for r in back)

    def valid(raw):
        try:
            raw.decode()
            return True
        except UnicodeDecodeError:
            return False

    assert {r["f"]: r["valid"] for r in ch.utf8_checks(t, "f", fan).collect()} == {k: valid(raw) for k, raw in enumerate(raws)}
    offsets = ch.with_offsets(t.drop("offset"), "f", fan).select("f", "no", "offset").collect()
    assert {(r["f"], r["no"], r["offset"]) for r in offsets} == {(r["f"], r["no"], r["offset"]) for r in t.collect()}


def test_empty_table(spark):
    none = spark.createDataFrame([], "f bigint, no bigint, offset bigint, content binary")
    assert ch.convert_endings(none, "f").count() == ch.utf8_checks(none, "f").count() == dt.detect(none, "f").count() == ch.with_offsets(none, "f").count() == 0


def brute_score(raw, width, order):
    """(eligible, score, share of zeros) by decoding whole files."""
    units = [int.from_bytes(raw[i : i + width], order) for i in range(0, len(raw) - width + 1, width)]
    zeros = sum(u >> 8 * (width - 1) == 0 for u in units)
    second = sum(u >> 16 & 255 == 0 for u in units) if width == 4 else zeros
    share = (min(zeros, second) - sum(u & 255 == 0 for u in units)) / len(units) if units else 0
    try:
        text = raw.decode({2: "utf-16-", 4: "utf-32-"}[width] + {"little": "le", "big": "be"}[order])
    except UnicodeDecodeError:
        return False, 0, share
    kind = lambda c: unicodedata.category(c)
    non = lambda c: 0xFDD0 <= ord(c) <= 0xFDEF or ord(c) & 0xFFFE == 0xFFFE
    good = sum((kind(c)[0] in "LMNPSZ" or c in "\t\n\v\f\r\x85") and not non(c) and (c != "�" or width == 4) for c in text)
    control = sum(kind(c) == "Cc" and c not in "\t\n\v\f\r\x85\0" for c in text)
    fine = len(text) >= 4 and "\0" not in text and not any(map(non, text)) and (width == 4 or "�" not in text) and good * 100 >= 95 * len(text) and control * 100 <= 2 * len(text)
    pairs = sum(ord(c) > 0xFFFF for c in text) if width == 2 else 0
    return fine, (20 + good * 50 // len(text) + min(30, int(max(0, share) * 30)) + min(10, len(text) // 8) + min(3, pairs)) if text else 0, share


def brute(raw):
    from sparkloom.operators.detect import LEAST_ZEROS

    for mark, name in ((b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return name, 100
    if not raw:
        return "utf-8", 0
    for width, may in ((4, len(raw) >= 16 and 0 in raw), (2, len(raw) >= 4 and (0 in raw or not utf8(raw)))):
        if may:
            found = {o: brute_score(raw, width, o) for o in ("little", "big")}
            fit = [o for o in ("little", "big") if found[o][0]]
            if fit:
                best = max(fit, key=lambda o: found[o][1])
                lead = found[best][1] - min(found[o][1] for o in fit) if len(fit) == 2 else 99
                if found[best][1] >= 82 and lead >= 12 and found[best][2] >= LEAST_ZEROS[width]:
                    return f"utf-{8 * width}-{best[0]}e", max(80, min(95, found[best][1]))
            if zeros_show(raw, width):
                return None, 0
    controls = sum(b < 32 and b not in b"\n\r\t" for b in raw)
    return ("utf-8", 100) if utf8(raw) and 0 not in raw and controls * 10 < len(raw) else "other"


def zeros_show(raw, width):
    n = len(raw) // width
    at = lambda k: sum(raw[i * width + k] == 0 for i in range(n))
    if width == 4:
        first, second = max(((at(3), at(2)), (at(0), at(1))), key=sum)
        return n >= 2 and first / n >= 0.75 and second / n >= 0.5
    most, least = max(at(0), at(1)), min(at(0), at(1))
    return n >= 2 and most / n >= 0.5 and (most - least) / n >= 0.5 or n >= 4 and most / n >= 0.2 and (most - least) / n >= 0.15


def utf8(raw):
    try:
        raw.decode()
        return True
    except UnicodeDecodeError:
        return False


@pytest.mark.parametrize(("seed", "most", "block"), [(1, 3, 16), (2, 50, 64), (3, 500, 65536)])
def test_detection_any_cut(spark, seed, most, block):
    texts = [*TEXTS[8:], "mixed été 你好 text 🌍 " * 8, "\x01\x02\x03 controls " * 3, "abc", "�� words here ￿", "ab\0cd plain words " * 4]
    raws = [t.encode(c) for t in texts for c in ("utf-8", "utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be")]
    raws += [b"", b"\xff\xfea\0", b"\xef\xbb\xbfx", "\ud800x many words".encode("utf-16-le", "surrogatepass"), "words " .encode("utf-16-le") * 4 + b"\0", bytes(range(256)), b"\0" * 40, *BROKEN]
    got = {r["f"]: (r["charset"], r["confidence"]) for r in dt.detect(table(spark, raws, seed, most), "f", block).collect()}
    for k, raw in enumerate(raws):
        want = brute(raw)
        if want != "other":
            assert got[k] == want, (raw[:40], want, got[k])
        else:
            assert got[k][0] in (None, "windows-1252", "utf-8")


def test_majority(spark):
    rows = [(1, "b", 90, 10), (1, "a", 80, 5), (1, "a", 91, 5), (1, None, 99, 100), (2, "z", 71, 3), (2, "z", 70, 4), (3, None, 1, 1)]
    got = {(r["f"], r["charset"], r["confidence"]) for r in ch.majority(spark.createDataFrame(rows, "f int, charset string, confidence int, weight int"), "f").collect()}
    assert got == {(1, "a", 85), (2, "z", 70)}
