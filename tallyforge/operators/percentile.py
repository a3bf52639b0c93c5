"""Places of values within a frozen reference.

Values meet the reference in ranges: edges come from the reference's approximate quantiles, so each range holds about as much of it, and both sides are sorted within their range only.  What a range needs from
the ones around it is the last reference value before it and the first one after, a row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Ranges of reference values: as many edges at most are held by the driver and go into the plan.
RANGES = 512


def range_of(value: Column, edges: list[float]) -> Column:
    """How many of the ascending edges are at or below value, by halving."""
    if not edges:
        return F.lit(0)
    table = F.array(*map(F.lit, edges))
    steps = F.array(*(F.lit(1 << k) for k in range(len(edges).bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(table, at + s - 1) <= value, at + s).otherwise(at))


def frozen_percentile(rows: DataFrame, x: str, reference: DataFrame, v: str, ranges: int = RANGES) -> DataFrame:
    """rows with percentile: the place of x among the reference's values, from 0 to 1.

    Tied values share the middle of their places; a value between two takes a place between theirs, in proportion; below all it is 0, above all 1; beside a single reference value 0.5.  Null for null
    (or not a number) and if the reference is empty; nulls in the reference don't count.  Equal values are worked out once, so a frequent one is no hot key.
    """
    known = written(reference.where(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))).groupBy(F.col(v).cast("double").alias("v")).agg(F.count("*").alias("n")))
    edges = sorted(set(known.approxQuantile("v", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    known = known.withColumn("range", range_of(F.col("v"), edges))
    sums = known.groupBy("range").agg(F.sum("n").alias("own"), F.min("v").alias("low"), F.max("v").alias("high"))
    by_range = Window.orderBy("range")
    sums = sums.select("range", "low", "high", (F.sum("own").over(by_range) - F.col("own")).alias("before"), F.sum("own").over(Window.partitionBy()).alias("all"))
    inside = Window.partitionBy("range").orderBy("v")
    ref = known.join(F.broadcast(sums.select("range", "before")), "range").select("range", "v", "n", (F.col("before") + F.sum("n").over(inside) - F.col("n")).alias("lower"))
    values = rows.select(F.col(x).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).distinct().withColumn("range", range_of(F.col("v"), edges))
    ref_row = F.struct("v", "n", "lower")
    both = ref.select("range", "v", F.lit(0).alias("side"), ref_row.alias("ref")).unionByName(values.select("range", "v", F.lit(1).alias("side"), F.lit(None).cast("struct<v:double,n:bigint,lower:bigint>").alias("ref")))
    order = Window.partitionBy("range").orderBy("v", "side")
    met = both.withColumn("left", F.last("ref", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("right", F.first("ref", True).over(order.rowsBetween(1, Window.unboundedFollowing))).where("side = 1")
    # The neighbours of a range: at most one row a range, whether or not the reference has values in it.
    spans = known.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("range")).join(F.broadcast(sums), "range", "left")
    upto, after = by_range.rowsBetween(Window.unboundedPreceding, -1), by_range.rowsBetween(1, Window.unboundedFollowing)
    spans = spans.select("range", F.last("high", True).over(upto).alias("high"), F.first("low", True).over(after).alias("low"))
    spans = spans.crossJoin(F.broadcast(known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))))
    last = ref.select(F.col("v").alias("high"), F.struct("v", "n", "lower").alias("prev"))
    met = met.join(F.broadcast(spans), "range").join(F.broadcast(last.join(F.broadcast(spans.select("high").distinct()), "high")), "high", "left")
    left = F.coalesce(F.col("left"), F.col("prev"))
    right_v = F.coalesce(F.col("right.v"), F.col("low"))
    met = met.select("v", "all", left.alias("left"), right_v.alias("right_v"))
    top = F.col("left.lower") + F.col("left.n") - 1
    share = (F.col("v") - F.col("left.v")) / (F.col("right_v") - F.col("left.v"))
    place = (
        F.when(F.col("all") == 0, None).when(F.col("all") == 1, 0.5).when(F.col("left").isNull(), 0.0).when(F.col("left.v") == F.col("v"), (F.col("left.lower") + (F.col("left.n") - 1) / 2) / (F.col("all") - 1))
        .when(F.col("right_v").isNull(), 1.0).otherwise((top + share) / (F.col("all") - 1))
    )
    told = met.select(F.col("v").alias("_v"), place.alias("percentile"))
    return rows.join(told, F.col(x).cast("double") == F.col("_v"), "left").drop("_v")
