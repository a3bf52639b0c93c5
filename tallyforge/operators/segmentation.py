"""Texts cut at anchors.

Anchors are the matches of several patterns, each with a name.  A text becomes one row an anchor: what was matched, and the text up to the next anchor.  What a text says
once for all that follows (a heading) is carried forward over these rows.  All the rows of one text meet in one task: work is bounded by the longest text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def segmented(docs: DataFrame, text: str, anchors: dict[str, str]) -> DataFrame:
    """docs without text, with at (from 0, in order), kind, anchor, body and begin (characters before the anchor) of every segment.

    Segment 0 is what stands before the first anchor: its kind is null and its anchor empty.  Where patterns match at one place, the first wins.  A null text has no segments.
    Patterns must match their own matches when these stand alone (no lookaround over their ends).
    """
    pattern = "|".join(f"(?:{p})" for p in anchors.values())
    column = F.col(text)
    found = F.concat(F.array(F.lit("")), F.regexp_extract_all(column, F.lit(pattern), F.lit(0)))
    pairs = F.arrays_zip(found.alias("anchor"), F.split(column, pattern, -1).alias("body"))
    rows = docs.withColumn("_parts", pairs).select(*(c for c in docs.columns if c != text), F.posexplode("_parts").alias("at", "_part"))
    kind = F.coalesce(*(F.when(F.col("_part.anchor").rlike(rf"\A(?:{p})\z"), name) for name, p in anchors.items()))
    rows = rows.select("*", F.when(F.col("at") > 0, kind).alias("kind"), "_part.anchor", "_part.body").drop("_part")
    keys = [c for c in docs.columns if c != text]
    own = F.length("anchor") + F.length("body")
    return rows.withColumn("begin", F.sum(own).over(in_order(keys)) - own)


def in_order(keys: list[str], by: str = "at") -> WindowSpec:
    """A text's segments up to the current one; keys must tell texts apart."""
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carried(kind: str, value: Column, keys: list[str]) -> Column:
    """value of the last segment of a kind, this one included; null before the first."""
    return F.last(F.when(F.col("kind") == kind, value), ignorenulls=True).over(in_order(keys))


def number_of(keys: list[str], *kinds: str) -> Column:
    """How many segments of these kinds there are up to this one."""
    return F.count_if(F.coalesce(F.col("kind").isin(*kinds), F.lit(False))).over(in_order(keys))


def whole_text(rows: Column) -> Column:
    """Segments (an array of structs with at, anchor and body) as text again."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: F.concat(r["anchor"], r["body"])), "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def listed_segments() -> Column:
    """Aggregate: the segments of a group, in order."""
    return F.array_sort(F.collect_list(F.struct("at", "kind", "anchor", "body", "begin")))
