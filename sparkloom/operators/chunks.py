"""Files as chunks cut at any byte: states carried across chunks by a parallel scan, line endings, UTF-8 checks, aligned blocks.

A chunk says, for each state in which it may begin, the state in which it ends: an array, moves.  Such arrays compose, so the
state before every chunk comes from a prefix composition over groups of at most FAN successive chunks, then over groups of
groups: no task holds more than FAN arrays of a file, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 64
#: Bytes of an aligned block, and those that it shows of its neighbours.
BLOCK, MARGIN = 1 << 16, 8


def cut_text(texts: DataFrame, key: str, size: int, text: str = "text") -> DataFrame:
    """(key, no, offset, content): the bytes of each text in chunks of a size; an empty or null text is one empty chunk."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary") if dict(texts.dtypes)[text] == "string" else F.coalesce(F.col(text), F.lit(b""))
    whole = texts.select(key, raw.alias("raw"))
    numbered = whole.select(key, "raw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.octet_length("raw") - 1, F.lit(0)).cast("bigint"), F.lit(size).cast("bigint"))).alias("offset"))
    return numbered.select(key, F.expr(f"offset div {size}").alias("no"), "offset", F.substring("raw", (F.col("offset") + 1).cast("int"), F.lit(size)).alias("content"))


def _after(moves: Column, state: Column) -> Column:
    return F.element_at(moves, state + 1)


def states(chunks: DataFrame, key: str, moves: str = "moves", start: int = 0, fan: int = FAN) -> DataFrame:
    """chunks (key, no, moves, ...) with state: that before each chunk when the file begins in start.

    no: whole numbers from 0 in the order of a file, gaps allowed, each once.
    """
    last = chunks.agg(F.max("no").alias("no")).first()["no"]
    levels, size = [chunks.select(key, "no", moves)], fan
    ordered = lambda: F.array_sort(F.collect_list(F.struct("no", moves))).alias("own")
    through = lambda own, state: F.aggregate(own, state, lambda s, m: _after(m[moves], s))
    while last is not None and last >= size:
        grouped = levels[-1].groupBy(key, F.expr(f"no div {fan}").alias("group")).agg(ordered())
        width = F.size(F.col("own")[0][moves])
        composed = F.transform(F.sequence(F.lit(0), width - 1), lambda s: through(F.col("own"), s))
        levels.append(grouped.select(key, F.col("group").alias("no"), composed.alias(moves)))
        size *= fan
    # Top level: one group a file; then each group hands its members their states.
    known = None
    for level in reversed(levels):
        grouped = level.groupBy(key, F.expr(f"no div {fan}").alias("group")).agg(ordered())
        grouped = grouped.withColumn("state", F.lit(start)) if known is None else grouped.join(known.select(key, F.col("no").alias("group"), "state"), [key, "group"])
        member = F.posexplode("own").alias("at", "one")
        known = grouped.select(key, "own", "state", member).select(key, F.col("one.no").alias("no"), through(F.slice("own", F.lit(1), F.col("at")), F.col("state")).alias("state"))
    return chunks.join(known, [key, "no"])


def _latin(content: str | Column) -> Column:
    """A character for each byte."""
    return F.decode(content, "ISO-8859-1")


_CR = b"\r"


def newline_moves(content: str = "content") -> Column:
    """State 1: the last byte was a carriage return, which is not written yet."""
    ends = F.substring(content, -1, 1) == F.lit(_CR)
    return F.when(F.octet_length(content) == 0, F.array(F.lit(0), F.lit(1))).when(ends, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(0)))


def convert_endings(chunks: DataFrame, key: str, ending: str = "\n", fan: int = FAN) -> DataFrame:
    """(key, no, content, lf, crlf): each chunk with its line endings as asked for, and how many it ends alone and with a return.

    A return at a chunk's end is held back and written with the next byte, or by the file's last chunk.  A lone return stays.
    """
    moved = states(chunks.select(key, "no", "content", newline_moves().alias("moves")), key, fan=fan)
    last = chunks.groupBy(key).agg(F.max("no").alias("last"))
    whole = F.concat(F.when(F.col("state") == 1, "\r").otherwise(""), _latin("content"))
    held = (F.col("no") < F.col("last")) & F.col("whole").endswith("\r")
    body = F.when(held, F.expr("left(whole, length(whole) - 1)")).otherwise(F.col("whole"))
    crlf = F.regexp_count("body", F.lit("\r\n"))
    ended = moved.join(last, key).withColumn("whole", whole).withColumn("body", body)
    made = F.replace(F.replace("body", F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit(ending))
    return ended.select(key, "no", F.encode(made, "ISO-8859-1").alias("content"), (F.regexp_count("body", F.lit("\n")) - crlf).cast("int").alias("lf"), crlf.cast("int").alias("crlf"))


#: UTF-8: for each unfinished beginning, bytes that lead there, bytes that are missing, and the state after one of them.
_BEGUN = {1: (b"\xc2", 1, 0), 2: (b"\xe1", 2, 1), 3: (b"\xe0", 2, 1), 4: (b"\xed", 2, 1), 5: (b"\xf1", 3, 2), 6: (b"\xf0", 3, 2), 7: (b"\xf4", 3, 2)}
_BROKEN = 8
#: What a piece may end with without being wrong: the beginning of a character.
_TAIL = (
    r"(?:[\xC2-\xDF]|\xE0[\xA0-\xBF]?|[\xE1-\xEC\xEE\xEF][\x80-\xBF]?|\xED[\x80-\x9F]?"
    r"|\xF0(?:[\x90-\xBF][\x80-\xBF]?)?|[\xF1-\xF3](?:[\x80-\xBF]{1,2})?|\xF4(?:[\x80-\x8F][\x80-\xBF]?)?)\z"
)


def _state_of(tail: Column) -> Column:
    """The state that an unfinished beginning (a character for each byte) leaves."""
    lead, n = F.ascii(tail), F.length(tail)
    first = F.when(lead < 0xE0, 1).when(lead == 0xE0, 3).when(lead == 0xED, 4).when(lead < 0xF0, 2).when(lead == 0xF0, 6).when(lead == 0xF4, 7).otherwise(5)
    return F.when(n == 0, 0).when(n == 1, first).when((n == 2) & (lead >= 0xF0), 2).otherwise(1)


def _plain_end(content: Column) -> Column:
    """The state after content that begins with a character."""
    tail = F.regexp_extract(_latin(F.substring(content, -3, 3)), _TAIL, 0)
    body = F.substring(content, F.lit(1), F.octet_length(content) - F.length(tail))
    return F.when(F.is_valid_utf8(body.cast("string")), _state_of(tail)).otherwise(_BROKEN)


def utf8_moves(content: str = "content") -> Column:
    """States: 0 between characters, 1 to 7 within one, 8 broken."""
    own = F.col(content)
    size = F.octet_length(own)
    moves = [_plain_end(own)]
    for prefix, missing, _ in _BEGUN.values():
        begun = F.concat(F.lit(prefix), own)
        partly = F.regexp_extract(_latin(begun), f"^{_TAIL}", 0)
        short = F.when(F.length(partly) == size + 1, _state_of(partly)).otherwise(_BROKEN)
        done = F.is_valid_utf8(F.substring(begun, F.lit(1), F.lit(missing + 1)).cast("string"))
        rest = F.substring(own, F.lit(missing + 1), size)
        moves.append(F.when(size < missing, short).when(done, _plain_end(rest)).otherwise(_BROKEN))
    moved = F.array(*[m.cast("int") for m in moves], F.lit(_BROKEN))
    return F.when(size == 0, F.array(*map(F.lit, range(_BROKEN + 1)))).otherwise(moved)


def utf8_checks(chunks: DataFrame, key: str, fan: int = FAN) -> DataFrame:
    """(key, valid, bad_no): whether a file is UTF-8 as a whole, else the first chunk with (or, at the end, within) a wrong character."""
    moved = states(chunks.select(key, "no", utf8_moves().alias("moves")), key, fan=fan).withColumn("end", _after(F.col("moves"), F.col("state")))
    ended = moved.groupBy(key).agg(F.min(F.when(F.col("end") == _BROKEN, F.col("no"))).alias("bad_no"), F.max_by("end", "no").alias("end"), F.max("no").alias("last"))
    bad = F.coalesce("bad_no", F.when(F.col("end") != 0, F.col("last")))
    return ended.select(key, bad.isNull().alias("valid"), bad.alias("bad_no"))


def with_offsets(chunks: DataFrame, key: str, fan: int = FAN) -> DataFrame:
    """chunks (key, no, content) with offset, the bytes before each; sums over groups of fan chunks, then over these."""
    sizes = chunks.select(key, "no", F.octet_length("content").cast("bigint").alias("n"))
    last = chunks.agg(F.max("no").alias("no")).first()["no"]
    levels, width = [sizes], fan
    while last is not None and last >= width:
        levels.append(levels[-1].groupBy(key, F.expr(f"no div {fan}").alias("no")).agg(F.sum("n").alias("n")))
        width *= fan
    known = None
    for level in reversed(levels):
        own = level.groupBy(key, F.expr(f"no div {fan}").alias("group")).agg(F.array_sort(F.collect_list(F.struct("no", "n"))).alias("own"))
        own = own.withColumn("before", F.lit(0).cast("bigint")) if known is None else own.join(known.select(key, F.col("no").alias("group"), F.col("offset").alias("before")), [key, "group"])
        total = F.aggregate(F.slice("own", F.lit(1), F.col("at")), F.col("before"), lambda s, r: s + r["n"])
        known = own.select(key, "own", "before", F.posexplode("own").alias("at", "one")).select(key, F.col("one.no").alias("no"), total.alias("offset"))
    return chunks.join(known, [key, "no"])


def aligned_blocks(chunks: DataFrame, key: str, size: int = BLOCK, margin: int = MARGIN) -> DataFrame:
    """(key, block, content, lead, body, total): the bytes of each file in blocks that begin at multiples of size, whatever its chunks.

    chunks: (key, offset, content).  content holds lead bytes before the block's body and up to margin behind it; total is the
    file's length.  A group is as large as a block, however long the file.
    """
    own = chunks.where(F.octet_length("content") > 0).withColumn("stop", F.col("offset") + F.octet_length("content"))
    first, last = F.expr(f"greatest(0L, offset - {margin}) div {size}"), F.expr(f"(stop - 1 + {margin}) div {size}")
    spread = own.withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("offset"), F.col("block") * size - margin)
    high = F.least(F.col("stop"), (F.col("block") + 1) * size + margin)
    pieces = spread.where(low < high).select(key, "block", low.alias("at"), F.substring("content", (low - F.col("offset") + 1).cast("int"), (high - low).cast("int")).alias("piece"))
    joined = pieces.groupBy(key, "block").agg(F.min("at").alias("start"), F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
    whole = joined.select(key, "block", "start", F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["piece"])).alias("content"))
    totals = own.groupBy(key).agg(F.max("stop").alias("total"))
    lead = F.col("block") * size - F.col("start")
    body = F.least(F.lit(size).cast("bigint"), F.col("total") - F.col("block") * size)
    return whole.join(totals, key).select(key, "block", "content", lead.cast("int").alias("lead"), body.cast("int").alias("body"), "total").where("body > 0")


def majority(verdicts: DataFrame, key: str) -> DataFrame:
    """(key, charset, confidence): of verdicts (key, charset, confidence, weight) the name with most bytes, ties to the smaller name.

    The confidence is the mean by bytes, in whole numbers.  Verdicts without a name don't count.
    """
    own = verdicts.where("charset is not null").groupBy(key, "charset").agg(F.sum(F.col("weight").cast("bigint")).alias("w"), F.sum(F.col("confidence").cast("bigint") * F.col("weight")).alias("c"))
    best = own.groupBy(key).agg(F.min(F.struct((-F.col("w")).alias("order"), "charset", F.expr("c div w").alias("mean"))).alias("b"))
    return best.select(key, F.col("b.charset").alias("charset"), F.col("b.mean").cast("int").alias("confidence"))
