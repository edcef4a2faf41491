"""Detection of UTF-8, UTF-16 and UTF-32 over files in chunks: counters of aligned blocks, summed, then decided in whole numbers.

Blocks are whatever the chunks were, so any cut gives the same counters.  A block is counted with numpy by itself, so a task's
memory is that of a few blocks; a surrogate pair over a block's end is seen in the bytes that it shows of the next.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import bom_type
from sparkloom.operators import chunks as ch

#: Least characters, percent of text characters, most percent of controls, least score and lead over the other order, least share
#: of zeros of each width, and the bounds of a confidence.  Fixed values.
LEAST_RUNES, TEXT_PERCENT, CONTROL_PERCENT, LEAST_SCORE, LEAST_LEAD, LEAST_ZEROS, CONFIDENCE = 4, 95, 2, 82, 12, {2: 0.12, 4: 0.35}, (80, 95)
#: Least file sizes for each width.  Fixed values.
LEAST_SIZE = {2: 4, 4: 16}
#: Bytes that windows-1252 lacks, and the confidence of that guess.  Fixed values.
LACKING, LATIN_CONFIDENCE = r"[\x81\x8D\x8F\x90\x9D]", 70

SPECS = {"utf-16-le": (2, "<u2"), "utf-16-be": (2, ">u2"), "utf-32-le": (4, "<u4"), "utf-32-be": (4, ">u4")}
FIELDS = ("units", "runes", "good", "control", "nul", "wrong", "pairs", "zeros", "second", "opposite", "broken")
_GOOD, _CONTROL, _NUL, _REPLACEMENT, _NONCHARACTER = 1, 2, 3, 4, 5


@cache
def classes() -> np.ndarray:
    """The class of each code point: text and white space, control, NUL, U+FFFD, noncharacter, or nothing of these."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LMNPS" or kind in ("Zs", "Zl", "Zp") or c in (9, 10, 11, 12, 13, 0x85):
            table[c] = _GOOD
        elif kind == "Cc":
            table[c] = _CONTROL
    table[np.arange(0xFDD0, 0xFDF0)] = _NONCHARACTER
    table[np.arange(0xFFFE, 0x110000, 0x10000)] = table[np.arange(0xFFFF, 0x110000, 0x10000)] = _NONCHARACTER
    table[0], table[0xFFFD] = _NUL, _REPLACEMENT
    return table


def _runes(units: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each unit the class of the character that begins there (255: none does), whether a pair does, whether it is broken."""
    if width == 4:
        broken = (units > 0x10FFFF) | (units >> 11 == 0xD800 >> 11)
        kind = classes()[np.where(broken, 0, units)]
        return np.where(broken, 255, np.where(kind == _REPLACEMENT, _GOOD, kind)), np.zeros(len(units), dtype=bool), broken
    high, low = units >> 10 == 0xD800 >> 10, units >> 10 == 0xDC00 >> 10
    pair = high & np.append(low[1:], False)
    broken = high & ~pair | low & ~np.append(False, high[:-1])
    code = np.where(pair, 0x10000 + ((units.astype(np.int64) & 0x3FF) << 10) + (np.append(units[1:], 0).astype(np.int64) & 0x3FF), units)
    return np.where((high | low) & ~pair, 255, classes()[code]), pair, broken


@F.udf(T.ArrayType(T.LongType()), useArrow=False)
def _evidence(raw: bytes, body: int) -> list[int]:
    """Counters of a block: MARGIN bytes, the body filled up to a multiple of 8, MARGIN bytes."""
    whole, out = np.frombuffer(raw, dtype=np.uint8), []
    for width, kind in SPECS.values():
        units = whole.view(kind).astype(np.uint32)
        inside = slice(ch.MARGIN // width, ch.MARGIN // width + body // width)
        rune, pair, broken = (x[inside] for x in _runes(units, width))
        own, top = units[inside], 8 * (width - 1)
        kinds = np.bincount(rune, minlength=256)
        zeros, second, opposite = own >> top == 0, own >> (top - 8) & 0xFF == 0, own & 0xFF == 0
        out += [len(own), len(own) - kinds[255], kinds[_GOOD], kinds[_CONTROL], kinds[_NUL], kinds[_REPLACEMENT] + kinds[_NONCHARACTER]]
        out += [np.count_nonzero(x) for x in (pair, zeros, second, opposite, broken)]
    return [int(n) for n in out]


_NAMES = [f"{spec}_{f}" for spec in SPECS for f in FIELDS]


def evidence(blocks: DataFrame, key: str) -> DataFrame:
    """(key, counters): sums over the blocks of aligned_blocks()."""
    filled = F.expr(f"(body + 7) div 8 * 8 + {ch.MARGIN}").cast("int")
    shown = F.substring("content", F.col("lead") + 1, filled)
    padded = F.concat(F.lpad(F.substring("content", F.lit(1), F.col("lead")), F.lit(ch.MARGIN), F.lit(b"\0")), F.rpad(shown, filled, F.lit(b"\0")))
    counted = blocks.select(key, _evidence(padded, F.col("body").cast("bigint")).alias("counters"))
    return counted.groupBy(key).agg(*[F.sum(F.col("counters")[i]).alias(n) for i, n in enumerate(_NAMES)])


def _of(spec: str):
    return lambda field: F.col(f"`{spec}_{field}`")


def _share(spec: str) -> Column:
    """How far zeros lie where the width and order expect them."""
    n, width = _of(spec), SPECS[spec][0]
    upper = F.least(n("zeros"), n("second")) if width == 4 else n("zeros")
    return F.coalesce(F.try_divide(upper - n("opposite"), n("units")), F.lit(0.0))


def score(spec: str) -> Column:
    n, width = _of(spec), SPECS[spec][0]
    quality, zeros = F.expr(f"`{spec}_good` * 50 div `{spec}_runes`"), F.floor(F.greatest(_share(spec), F.lit(0.0)) * 30)
    length, pairs = F.least(F.expr(f"`{spec}_runes` div 8"), F.lit(10)), F.least(n("pairs"), F.lit(3)) if width == 2 else F.lit(0)
    return F.when(n("runes") > 0, 20 + quality + F.least(zeros, F.lit(30)) + length + pairs).otherwise(0)


def eligible(spec: str) -> Column:
    n, width = _of(spec), SPECS[spec][0]
    whole = (F.col("total") % width == 0) & (n("broken") == 0) & (n("units") >= LEAST_RUNES) & (n("runes") >= LEAST_RUNES)
    return whole & (n("nul") == 0) & (n("wrong") == 0) & (n("good") * 100 >= n("runes") * TEXT_PERCENT) & (n("control") * 100 <= n("runes") * CONTROL_PERCENT)


def judged(counted: DataFrame) -> DataFrame:
    """counted with `fit`, `score` and `share` of each width and order, in columns of their own."""
    parts = {"fit": eligible, "score": score, "share": _share}
    return counted.withColumns({f"{spec}_{name}": part(spec) for spec in SPECS for name, part in parts.items()})


def decided(width: int) -> Column:
    """struct(charset, confidence) of the order that wins, or null; of the columns of judged()."""
    little, big = (_of(s) for s in SPECS if SPECS[s][0] == width)
    wins = lambda n, other: n("fit") & (n("score") >= LEAST_SCORE) & (n("share") >= LEAST_ZEROS[width]) & (~other("fit") | (n("score") - other("score") >= LEAST_LEAD))
    made = lambda n, name: F.when(wins(n, big if n is little else little), F.struct(F.lit(name).alias("charset"), F.greatest(F.lit(CONFIDENCE[0]), F.least(F.lit(CONFIDENCE[1]), n("score"))).cast("int").alias("confidence")))
    names = [s for s in SPECS if SPECS[s][0] == width]
    return F.coalesce(made(little, names[0]), made(big, names[1]))


def raw_signal(width: int) -> Column:
    """So many zeros that the file is of this width, or nothing that has a name."""
    little, big = (s for s in SPECS if SPECS[s][0] == width)
    a, b = _of(little), _of(big)
    units = F.greatest(a("units"), b("units"))
    if width == 4:
        better = b("zeros") + b("second") > a("zeros") + a("second")
        first, second = (F.when(better, b(f)).otherwise(a(f)) for f in ("zeros", "second"))
        return (units >= 2) & (first * 100 >= units * 75) & (second * 100 >= units * 50)
    most, least = F.greatest(a("zeros"), b("zeros")), F.least(a("zeros"), b("zeros"))
    strong = (units >= 2) & (most * 100 >= units * 50) & ((most - least) * 100 >= units * 50)
    return strong | (units >= 4) & (most * 100 >= units * 20) & ((most - least) * 100 >= units * 15)


def _verdicts(blocks: DataFrame, key: str) -> DataFrame:
    """(key, charset, confidence, weight) of each block by itself: UTF-8, windows-1252, or no name."""
    latin = F.decode(F.substring("content", F.col("lead") + 1, F.col("body")), "ISO-8859-1")
    # Beginnings and ends of characters that lie in other blocks are those blocks'.
    inner = F.regexp_replace(F.regexp_replace(latin, r"\A[\x80-\xBF]{1,3}", ""), ch._TAIL, "")
    controls = F.regexp_count(latin, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    binary = latin.contains("\0") | (F.col("body") >= 8) & (controls * 10 >= F.col("body"))
    high = F.regexp_count(latin, F.lit(r"[\x80-\xFF]"))
    plain = (F.col("body") >= 8) & (high >= LEAST_RUNES) & ~latin.rlike(LACKING) & (controls == 0)
    named = F.when(binary, None).when(F.is_valid_utf8(F.encode(inner, "ISO-8859-1").cast("string")), F.struct(F.lit("utf-8").alias("charset"), F.lit(100).alias("confidence")))
    named = named.when(plain, F.struct(F.lit("windows-1252").alias("charset"), F.lit(LATIN_CONFIDENCE).alias("confidence")))
    return blocks.select(key, named.alias("v"), F.col("body").alias("weight")).select(key, "v.charset", "v.confidence", "weight")


def detect(chunks: DataFrame, key: str, size: int = ch.BLOCK) -> DataFrame:
    """(key, charset, confidence) of files in chunks (key, no, offset, content): a byte order mark, UTF-32, UTF-16, then by blocks.

    A file that shows the zeros of a width but is no sound text of it has no name (null, 0), and so has one whose blocks have
    none.  A file without bytes is UTF-8, with confidence 0.
    """
    names = chunks.select(key).distinct()
    blocks = ch.aligned_blocks(chunks, key, size)
    head = blocks.where("block = 0").select(key, bom_type(F.substring("content", 1, 4)).alias("bom"), "total")
    nul = blocks.groupBy(key).agg(F.max(F.decode(F.substring("content", F.col("lead") + 1, F.col("body")), "ISO-8859-1").contains("\0")).alias("nul"))
    counted = judged(evidence(blocks, key).join(head, key).join(nul, key).join(ch.utf8_checks(chunks, key), key))
    legacy = ch.majority(_verdicts(blocks, key), key).select(key, F.struct("charset", "confidence").alias("legacy"))
    none = F.struct(F.lit(None).cast("string").alias("charset"), F.lit(0).alias("confidence"))
    mark = F.struct(F.col("bom").alias("charset"), F.lit(100).alias("confidence"))
    wide = (F.col("total") >= LEAST_SIZE[4]) & F.col("nul")
    pairs = (F.col("total") >= LEAST_SIZE[2]) & (F.col("nul") | ~F.col("valid"))
    sure = F.when(F.col("valid") & ~F.col("nul"), F.col("legacy"))
    found = F.when(F.col("bom") != "none", mark)
    for check, width in ((wide, 4), (pairs, 2)):
        by_width = F.coalesce(decided(width), F.when(raw_signal(width), none))
        found = F.coalesce(found, F.when(check, by_width)) if width == 4 else F.coalesce(found, F.when(check, by_width), sure, F.col("legacy"), none)
    made = counted.join(legacy, key, "left").select(key, found.alias("found"))
    empty = F.struct(F.lit("utf-8").alias("charset"), F.lit(0).alias("confidence"))
    return names.join(made, key, "left").select(key, F.coalesce("found", empty).alias("found")).select(key, "found.charset", "found.confidence")
