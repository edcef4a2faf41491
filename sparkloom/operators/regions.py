"""Regions of composite texts and scopes of their tags, as rows: offsets, pairs, parents.

Opening and closing events are paired in rounds of window functions over (text, order): in each round every open event whose next
live neighbour is a closing one is settled, so a round settles a whole level of nesting everywhere.  All rounds of a pass are one
stage, as they share partitioning and order; a deeper text takes another pass.  Rows are never gathered into arrays.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.sources.shared import cut

ROUNDS = 6


@dataclasses.dataclass(frozen=True)
class Rule:
    """A region that begins with open and ends with close (regular expressions), whatever stands between."""

    kind: str
    open: str
    close: str


#: What HTML holds of other languages, and its elements without an end.  Fixed values.
HTML = (Rule("comment", "<!--", "-->"), Rule("script", r"<script\b[^<>]*>", r"</script\s*>"), Rule("style", r"<style\b[^<>]*>", r"</style\s*>"))
VOID = "area base br col embed hr img input link meta param source track wbr".split()
_TAG = r"</?[a-zA-Z][a-zA-Z0-9]*\b[^<>]*>"


def _region(rule: Rule) -> str:
    return rf"(?:{rule.open}).*?(?:{rule.close}|\z)"


def _tokens(texts: DataFrame, key: str, text: str, pattern: str, marks: list[Column]) -> DataFrame:
    """(key, at, start, end, marks): matches in their order with byte offsets; marks are made of the match, `token`."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    each = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.arrays_zip(pieces.alias("piece"), found.alias("token"))).alias("at", "one"))
    sized = each.select(key, "at", F.octet_length("one.piece").alias("gap"), F.coalesce(F.octet_length("one.token"), F.lit(0)).alias("size"), F.col("one.token").alias("token")).select(key, "at", "gap", "size", F.col("token").isNull().alias("rest"), *marks)
    before = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    return sized.withColumn("end", before.cast("int")).withColumn("start", (F.col("end") - F.col("size")).cast("int"))


def _kind_of(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    kind, closed = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in reversed(rules):
        here = F.col("token").rlike(rf"(?is)\A(?:{rule.open})")
        kind = F.when(here, rule.kind).otherwise(kind)
        closed = F.when(here, F.col("token").rlike(rf"(?is)\A(?:{rule.open}).*?(?:{rule.close})\z")).otherwise(closed)
    return kind.alias("kind"), closed.alias("closed")


def segments(texts: DataFrame, key: str, text: str = "text", rules: tuple[Rule, ...] = HTML, host: str = "host") -> DataFrame:
    """(key, start, end, kind, closed): the text from end to end, in regions and what hosts them; byte offsets, empty ones left out.

    The leftmost opening counts, of several there the first rule's; a region without its end lasts to the end (closed false).
    """
    pattern = "(?is)" + "|".join(map(_region, rules))
    found = _tokens(texts, key, text, pattern, list(_kind_of(rules)))
    region = F.struct("start", "end", "kind", "closed")
    around = F.struct((F.col("start") - F.col("gap")).alias("start"), F.when(F.col("rest"), F.col("end")).otherwise(F.col("start")).alias("end"), F.lit(host).alias("kind"), F.lit(True).alias("closed"))
    return found.select(key, F.inline(F.array(around, region))).where("start < end")


def tags(texts: DataFrame, key: str, text: str = "text", rules: tuple[Rule, ...] = HTML) -> DataFrame:
    """(key, at, start, end, kind, label): regions, and the opening and closing tags outside them, in their order."""
    pattern = "(?is)" + "|".join([*map(_region, rules), _TAG])
    label = F.lower(F.regexp_extract("token", r"\A</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    kind, _ = _kind_of(rules)
    tag = F.when(F.col("token").startswith("</"), "close").when(F.col("token").endswith("/>") | label.isin(VOID), "single").otherwise("open")
    found = _tokens(texts, key, text, pattern, [F.coalesce(kind, tag).alias("kind"), F.when(kind.isNull(), label).alias("label")])
    return found.where(~F.col("rest")).select(key, "at", "start", "end", "kind", "label")


def pair_scopes(events: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """events (key, at, label, open) with partner: the at of the other end, null for events without one.

    A closing event only ends the innermost open scope, and only if the labels are equal; else it has no partner and changes
    nothing.  An event with an empty or null label has no partner and opens nothing.
    """
    live = F.coalesce(F.trim("label") != "", F.lit(False))
    now = events.withColumns({"live": live, "partner": F.lit(None).cast(events.schema["at"].dataType)})
    own = W.partitionBy(key).orderBy("at")
    shown = F.when(F.col("live"), F.struct("at", "label", "open"))
    while True:
        for _ in range(rounds):
            seen = now.withColumns({"_next": F.first(shown, ignorenulls=True).over(own.rowsBetween(1, W.unboundedFollowing)), "_last": F.last(shown, ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, -1))})
            opens = F.col("open") & (F.col("_next.open") == F.lit(False)) & (F.col("_next.label") == F.col("label"))
            closes = ~F.col("open") & F.col("_last.open") & (F.col("_last.label") == F.col("label"))
            stray = ~F.col("open") & (F.col("_last").isNull() | F.col("_last.open") & (F.col("_last.label") != F.col("label")))
            partner = F.when(F.col("live") & opens, F.col("_next.at")).when(F.col("live") & closes, F.col("_last.at")).otherwise(F.col("partner"))
            done = F.coalesce(opens | closes | stray, F.lit(False))
            now = seen.withColumns({"partner": partner, "live": F.col("live") & ~done}).drop("_next", "_last")
        now = cut(now, "scopes")
        if now.where("live and not open").isEmpty():
            return now.drop("live")


def with_parents(paired: DataFrame, key: str) -> DataFrame:
    """paired with parent: the at of the innermost pair around each event; ends of a pair have the same parent.

    The depth of an event is a running sum; its parent is the last event that opened that depth, found within (key, depth).
    """
    step = F.when(F.col("partner").isNull(), 0).when(F.col("open"), 1).otherwise(-1)
    depth = F.sum(step).over(W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    opened = (F.col("partner").isNotNull() & F.col("open")).alias("opened")
    deep = paired.withColumn("depth", depth)
    asks = F.struct((F.col("depth") - F.when(opened, 1).otherwise(0)).alias("level"), F.lit(None).cast(paired.schema["at"].dataType).alias("gives"))
    gives = F.when(opened, F.struct(F.col("depth").alias("level"), F.col("at").alias("gives")))
    both = deep.withColumn("way", F.explode(F.array_compact(F.array(asks, gives))))
    last = F.last("way.gives", ignorenulls=True).over(W.partitionBy(key, "way.level").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    found = both.withColumn("parent", F.when(F.col("way.level") > 0, last)).where("way.gives is null")
    return found.drop("way", "depth")


def scopes(texts: DataFrame, key: str, text: str = "text", rules: tuple[Rule, ...] = HTML) -> DataFrame:
    """(key, start, end, kind, label, parent): regions, and elements from tag to tag; parent: the start of the element around it.

    An opening tag without its end is an `unclosed` row as long as the tag, a closing one without its beginning a `stray` one.
    """
    found = cut(tags(texts, key, text, rules), "tags")
    single = ~F.col("kind").isin("open", "close")
    events = found.withColumns({"open": F.col("kind") == "open", "label": F.when(~single, F.col("label"))})
    whole = with_parents(pair_scopes(events, key), key)
    ends = found.select(key, F.col("at").alias("partner"), F.col("end").alias("other_end"))
    around = found.select(key, F.col("at").alias("parent"), F.col("start").alias("parent_start"))
    met = whole.join(ends, [key, "partner"], "left").join(around, [key, "parent"], "left")
    kind = F.when(single, F.col("kind")).when(F.col("partner").isNotNull(), "element").when(F.col("kind") == "open", "unclosed").otherwise("stray")
    out = met.where("partner is null or open").where(F.col("kind") != "single")
    return out.select(key, "start", F.when(F.col("partner").isNotNull(), F.col("other_end")).otherwise(F.col("end")).alias("end"), kind.alias("kind"), F.col("label"), F.col("parent_start").alias("parent"))
