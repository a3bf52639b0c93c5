"""Connected components as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """node and part (the smallest node of its component) for every node of links (a, b: long).

    Alternating large-star and small-star steps: each keeps the components and brings every node nearer to the smallest; the number of
    rounds grows with the logarithm of the longest path.  A round is two groupings and two joins over the links; nothing is collected but a count
    and a checksum.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if tuple(seen) == state or not seen["n"]:
            break
        state = tuple(seen)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = materialize(large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("part")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("part"))).distinct()
