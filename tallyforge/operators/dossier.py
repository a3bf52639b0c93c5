"""One nested document a member, from ranked sections of bounded length.

Each section ranks rows of its own and keeps a member's first ones; sections are put one under the other and grouped once, so there is no join a section, and however much a member has, what goes into the
document is bounded by the sections' limits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def section(rows: DataFrame, name: str, order: list[Column], content: list[str], most: int) -> DataFrame:
    """member_id, section, rank and content (JSON, nulls kept) of the first rows of each member by order, `most` at most; equal ones by content.

    Ranks are cut before rows move to their member, by Spark's own limit of window groups.
    """
    own = rows.select("member_id", F.lit(name).alias("section"), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("order"), F.to_json(F.struct(*content), {"ignoreNullFields": "false"}).alias("content"))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("member_id").orderBy("order", "content")))
    return ranked.where(F.col("rank") <= most).select("member_id", "section", "rank", "content")


def dossiers(members: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """member_id and document for every row of members (member_id, unique): JSON with a list for each of the sections, in their order; empty where a member has nothing."""
    whole = reduce(DataFrame.unionByName, sections.values())
    held = whole.groupBy("member_id").agg(F.array_sort(F.collect_list(F.struct("section", "rank", "content"))).alias("held"))

    def part(name: str) -> Column:
        own = F.transform(F.filter("held", lambda x: x["section"] == name), lambda x: x["content"])
        return F.concat(F.lit(f'"{name}":['), F.coalesce(F.array_join(own, ","), F.lit("")), F.lit("]"))

    text = F.concat(F.lit("{"), F.concat_ws(",", *map(part, sections)), F.lit("}"))
    return members.select("member_id").join(held, "member_id", "left").select("member_id", text.alias("document"))
