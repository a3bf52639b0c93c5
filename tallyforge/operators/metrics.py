"""Scores of probability forecasts: p and outcome (0 or 1) in slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rates import bin_of

EPSILON = 1e-12


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, 2))


def log_loss(p: Column, y: Column, epsilon: float = EPSILON) -> Column:
    p = F.least(F.lit(1 - epsilon), F.greatest(F.lit(epsilon), p))
    return F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))


def accuracy(p: Column, y: Column) -> Column:
    return F.avg(F.when((p >= 0.5).cast("int") == y, 1.0).otherwise(0.0))


def scorecard(forecasts: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, positive_rate, brier, log_loss, accuracy and ece by slice, in one pass over bins and one over them."""
    p, y = F.col("p"), F.col("outcome")
    clipped = F.least(F.lit(1 - EPSILON), F.greatest(F.lit(EPSILON), p))
    bins = forecasts.groupBy(*by, bin_of(p).alias("_bin")).agg(
        F.count("*").alias("n"),
        F.sum(p).alias("p"),
        F.sum(y).alias("y"),
        F.sum(F.pow(p - y, 2)).alias("square"),
        F.sum(-(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))).alias("loss"),
        F.sum(F.when((p >= 0.5).cast("int") == y, 1).otherwise(0)).alias("right"),
    )
    n = F.sum("n")
    return bins.groupBy(*by).agg(
        n.alias("n"),
        (F.sum("y") / n).alias("positive_rate"),
        (F.sum("square") / n).alias("brier"),
        (F.sum("loss") / n).alias("log_loss"),
        (F.sum("right") / n).alias("accuracy"),
        (F.sum(F.abs(F.col("p") - F.col("y"))) / n).alias("ece"),
    )


def calibration_bins(forecasts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return forecasts.groupBy(*by, bin_of(F.col("p")).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("outcome").alias("observed"))


def tied(forecasts: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row per slice and p: positives and negatives.  Ranking works on these, so ties count as one."""
    return forecasts.groupBy(*by, "p").agg(F.sum("outcome").alias("pos"), F.sum(1 - F.col("outcome")).alias("neg"))


#: Ranges of p in which ranks are taken: a slice's rows are windowed a range at a time.
RANGES = 4096


def ranking(forecasts: DataFrame, by: Sequence[str]) -> DataFrame:
    """average_precision (null without positives) and roc_auc (null if one class is missing) by slice.

    Works on a row per distinct p of a slice, in ranges of p: sums within a range, over what the ranges above and below hold, a row a range.  A null p is the lowest.
    """
    place = F.coalesce(F.least(F.lit(RANGES - 1), F.greatest(F.lit(0), F.floor(F.col("p") * RANGES))), F.lit(-1)).cast("int")
    rows = tied(forecasts, by).withColumn("_range", place)
    sums = rows.groupBy(*by, "_range").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    ascending = Window.partitionBy(*by).orderBy("_range")
    both = Window.partitionBy(*by)
    over = lambda c: F.sum(c).over(both) - F.sum(c).over(ascending)
    sums = sums.select(*by, "_range", over("_pos").alias("_pos_over"), over("_neg").alias("_neg_over"), (F.sum("_neg").over(ascending) - F.col("_neg")).alias("_neg_under"))
    rows = rows.alias("r").join(sums.alias("s"), [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "_range")]).select(*(F.col(f"r.{c}") for c in (*by, "_range", "p", "pos", "neg")), "_pos_over", "_neg_over", "_neg_under")
    down = Window.partitionBy(*by, "_range").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*by, "_range").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    tp = F.col("_pos_over") + F.sum("pos").over(down)
    seen = tp + F.col("_neg_over") + F.sum("neg").over(down)
    rows = rows.select(*by, "pos", "neg", tp.alias("_tp"), seen.alias("_seen"), (F.col("_neg_under") + F.coalesce(F.sum("neg").over(up), F.lit(0))).alias("_below"))
    pos, neg = F.sum("pos"), F.sum("neg")
    wins = F.sum(F.col("pos") * F.col("_below") + 0.5 * F.col("pos") * F.col("neg"))
    return rows.groupBy(*by).agg(
        F.when(pos > 0, F.sum(F.col("pos") * F.col("_tp") / F.col("_seen")) / F.when(pos > 0, pos)).alias("average_precision"),
        F.when((pos > 0) & (neg > 0), wins / F.when((pos > 0) & (neg > 0), pos * neg)).alias("roc_auc"),
    )


def ranked_probability_score(pmf: Column, actual: Column) -> Column:
    """Of a distribution over 0..n and the count that came."""
    n = F.size(pmf) - 1
    state = F.struct(F.lit(0.0).alias("cum"), F.lit(0.0).alias("loss"))
    steps = F.transform(F.slice(pmf, F.lit(1), n), lambda x, i: F.struct(x.alias("x"), F.when(actual <= i, 1.0).otherwise(0.0).alias("hit")))
    total = F.aggregate(steps, state, lambda s, e: F.struct((s["cum"] + e["x"]).alias("cum"), (s["loss"] + F.pow(s["cum"] + e["x"] - e["hit"], 2)).alias("loss")), lambda s: s["loss"])
    return total / n
