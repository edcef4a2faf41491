"""Replacing a passage of a text: exactly, else by lines that differ in blanks around them, else by the one window that is most alike.

All of it is expressions on rows, so texts are edited where they lie.  A window is compared only if its length allows it and if one
of the pieces into which the sought text is cut comes in it unchanged: so many edits can't touch all of one piece more.  What is
left is compared by a distance that stops at the bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as fx

#: Bounds of a similarity search; beyond them it is an error.  Fixed values.
LEAST_SIMILARITY, MOST_WINDOWS, MOST_CHARACTERS, MOST_CELLS = 0.5, 10_000, 4096, 2_000_000
#: Scores that are nearer than this are equal.  Fixed value.
EQUAL = 1e-12
#: White space of any script.
_SPACE = r"[\s\x0B\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, rf"\A{_SPACE}+|{_SPACE}+\z", "")


def _collapsed(line: Column) -> Column:
    return F.regexp_replace(_trimmed(line), f"{_SPACE}+", " ")


def indent(line: Column) -> Column:
    return F.regexp_extract(line, r"\A[ \t]*", 0)


def rebased(new: Column, old: Column, base: Column) -> Column:
    """The lines of new for a place indented as base: the first as that is, others by how their indent differs from old's line."""

    def moved(line: Column, k: Column) -> Column:
        bare = F.regexp_replace(line, r"\A[ \t]+", "")
        more = F.length(indent(line)) - F.length(indent(F.try_element_at(old, k + 1)))
        deeper = F.concat(F.rpad(base, F.length(base) + F.greatest(more, F.lit(0)), " "), bare)
        less = F.concat(F.substring(base, F.lit(1), F.greatest(F.length(base) + more, F.lit(0))), bare)
        later = F.when(k >= F.size(old), line).when(more < 0, less).otherwise(deeper)
        return F.when(k == 0, F.concat(base, bare)).otherwise(later)

    return F.transform(new, moved)


def bounded_distance(a: Column, b: Column, most: Column) -> Column:
    """The edits between a and b, null if they are more than most: told by lengths, then by pieces, then by a banded distance."""
    n = F.length(a)
    pieces = F.transform(F.sequence(F.lit(0), most), lambda i: F.substring(a, F.floor(i * n / (most + 1)).cast("int") + 1, (F.floor((i + 1) * n / (most + 1)) - F.floor(i * n / (most + 1))).cast("int")))
    may = (F.abs(n - F.length(b)) <= most) & F.exists(pieces, lambda p: F.contains(b, p))
    distance = F.when(may, F.call_function("levenshtein", a, b, most))
    return F.when(distance >= 0, distance)


def replace_text(rows: DataFrame, text: str, old: str, new: str, similarity: float | None = None, into: str = "got") -> DataFrame:
    """rows with into: struct(text, how, ln, score, error); how: exact, trimmed or similar, ln: the line where it begins.

    The first exact occurrence counts, else the first window of lines that are equal without the blanks around them, else, where
    a similarity is given, the window of the highest one, not below it: 1 - edits / the longer length, blanks collapsed.  Two
    windows of the best score are an error, and so are searches beyond the bounds; nothing is replaced then.  Replaced windows
    take the indent of their first line.  Texts whose endings are all CRLF keep them, mixed ones become LF.  Nulls give nulls.
    """
    if similarity is not None and not LEAST_SIMILARITY <= similarity <= 1:
        raise ValueError(f"similarity must be from {LEAST_SIMILARITY} to 1")
    lf, crlf = fx.ending_counts(F.col(text))
    own = rows.select(F.struct(*rows.columns).alias("row"), (fx.ending_style(lf, crlf) == "crlf").alias("crlf"), *[fx.to_lf(F.col(c)).alias(n) for c, n in ((text, "text"), (old, "old"), (new, "new"))])
    own = own.withColumns({"at": F.when(F.col("old") != "", F.instr("text", F.col("old"))), "lines": F.split("text", "\n"), "sought": F.split("old", "\n"), "put": F.split("new", "\n")})
    n, size = F.size("sought"), F.size("lines")
    windows = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    open_ = F.col("at") == 0
    bare = own.withColumns({"windows": F.when(open_, windows), "b_lines": F.when(open_, F.transform("lines", _trimmed)), "b_sought": F.when(open_, F.transform("sought", _trimmed))})
    same = F.filter("windows", lambda i: (F.element_at("b_lines", i) == F.element_at("b_sought", 1)) & (F.slice("b_lines", i, n) == F.col("b_sought")))
    found = bare.withColumn("first", F.try_element_at(same, F.lit(1)))
    if similarity is None:
        found = found.withColumns({"best": F.lit(None).cast("struct<ln:int,score:double>"), "wrong": F.lit(None).cast("string")})
    else:
        loose = (F.col("at") == 0) & F.col("first").isNull()
        found = found.withColumns({"c_lines": F.when(loose, F.transform("lines", _collapsed)), "goal": F.when(loose, F.array_join(F.transform("sought", _collapsed), "\n"))})
        few = (F.size("windows") <= MOST_WINDOWS) & (F.length("goal") <= MOST_CHARACTERS)
        cut = F.transform("windows", lambda i: F.struct(i.alias("ln"), F.array_join(F.slice("c_lines", i, n), "\n").alias("body")))
        longest = lambda w: F.greatest(F.length(w["body"]), F.length("goal"))
        most = lambda w: F.floor((1 - similarity) * longest(w)).cast("int")
        sized = F.filter(cut, lambda w: (F.length(w["body"]) <= MOST_CHARACTERS) & (longest(w) > 0))
        found = found.withColumn("cut", F.when(few, F.transform(sized, lambda w: F.struct(w["ln"].alias("ln"), w["body"].alias("body"), longest(w).alias("longest"), most(w).alias("most")))))
        cells = F.aggregate("cut", F.lit(0).cast("bigint"), lambda s, w: s + F.greatest(F.length("goal").cast("bigint") * (2 * w["most"] + 1), w["longest"].cast("bigint")))
        found = found.withColumn("cells", cells)
        scored = F.transform("cut", lambda w: F.struct((1 - bounded_distance(F.col("goal"), w["body"], w["most"]) / w["longest"]).alias("score"), w["ln"].alias("ln")))
        found = found.withColumn("scores", F.when(F.col("cells") <= MOST_CELLS, F.filter(scored, lambda w: w["score"].isNotNull())))
        found = found.withColumn("top", F.array_max(F.transform("scores", lambda w: w["score"])))
        found = found.withColumn("tops", F.filter("scores", lambda w: w["score"] >= F.col("top") - EQUAL))
        best = F.when(F.size("tops") == 1, F.struct(F.col("tops")[0]["ln"].alias("ln"), F.col("tops")[0]["score"].alias("score")))
        wrong = F.when(F.size("windows") > MOST_WINDOWS, "too many windows").when(F.length("goal") > MOST_CHARACTERS, "too long a passage").when(F.col("cells") > MOST_CELLS, "too many comparisons").when(F.size("tops") > 1, "several windows are equally alike")
        found = found.withColumns({"best": best, "wrong": F.when(loose, wrong)})
    ln = F.coalesce("first", "best.ln")
    first_line = F.col("put")[0]
    placed = rebased(F.col("put"), F.col("sought"), indent(F.element_at("lines", ln)))
    # A window that is merely alike keeps an empty first line empty.
    placed = F.when(F.col("first").isNull() & (first_line == ""), F.concat(F.array(F.lit("")), F.slice(placed, F.lit(2), F.size("put")))).otherwise(placed)
    lines = F.concat(F.slice("lines", F.lit(1), ln - 1), placed, F.slice("lines", ln + n, size))
    exact = F.concat(F.substring("text", F.lit(1), F.col("at") - 1), F.col("new"), F.expr("substr(text, at + length(old))"))
    made = F.when(F.col("at") > 0, exact).when(ln.isNotNull(), F.array_join(lines, "\n"))
    how = F.when(F.col("at") > 0, "exact").when(F.col("first").isNotNull(), "trimmed").when(F.col("best").isNotNull(), "similar")
    line = F.when(F.col("at") > 0, F.regexp_count(F.substring("text", F.lit(1), F.col("at") - 1), F.lit("\n")) + 1).otherwise(ln).cast("int")
    score = F.when(F.col("at") > 0, F.lit(1.0)).when(F.col("first").isNotNull(), F.lit(1.0)).otherwise(F.col("best.score"))
    known = F.col("text").isNotNull() & F.col("old").isNotNull() & F.col("new").isNotNull()
    error = F.when(known, F.when(F.col("old") == "", "nothing sought").otherwise(F.coalesce("wrong", F.when(how.isNull(), "not found"))))
    made = F.when(known & error.isNull(), F.when(F.col("crlf"), fx.to_crlf(made)).otherwise(made))
    sure = lambda c: F.when(known & error.isNull(), c)
    return found.select("row.*", F.struct(made.alias("text"), sure(how).alias("how"), sure(line).alias("ln"), sure(score).alias("score"), error.alias("error")).alias(into))
