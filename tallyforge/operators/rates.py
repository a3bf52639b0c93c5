"""Rates with hierarchical shrinkage, and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp
from ..sources.tables import written
from .asof import decayed_prior_days, rejoin, rejoin_few, strict_prior_days

# Prior strengths, caps, bounds and least support of the member model.
PARTY_PRIOR, MEMBER_PRIOR, ANALOGUE_CAP, LEAST_GLOBAL, FALLBACK, LOW, HIGH = 12, 3, 8, 20, 0.5, 0.005, 0.995
BASELINE_PRIOR = 4
BINS, LEAST_BIN, SMOOTHING = 10, 25, 4


def prior_counts(votes: DataFrame, within: tuple[str, ...] = (), half_life: float | None = None, more: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """votes with strictly prior yes and n of all (g_), of the party (p_) and of the member (m_), each within the given columns.

    half_life: of party's and member's history; the global one doesn't decay.  more: further histories without decay within fewer columns, by what their names begin with.

    Votes are read twice: for one row per member and day, which is written beside the member's sums, and to take these back.  The sums of party and of all are few rows, taken from the same table.
    """
    keys, sets = [*within, "party", "member_id", "day"], {"": within} | (more or {})
    days = votes.groupBy(*keys).agg(F.sum("outcome").alias("yes"), F.count("*").alias("n"))
    if half_life is None:
        # A window by few columns first: those by more then find their rows together.
        for lead, own in sorted(sets.items(), key=lambda x: len(x[1])):
            before = Window.partitionBy(*(["member_id", *own])).orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
            days = days.withColumns({f"{lead}m_{v}": F.coalesce(F.when(F.col("day").isNotNull(), F.sum(v).over(before)), F.lit(0)) for v in ("yes", "n")})
    days = written(days)
    sums = days.drop("yes", "n")
    if half_life is not None:
        sums = rejoin(sums, decayed_prior_days(days, [*within, "member_id"], {"m_yes": F.col("yes"), "m_n": F.col("n")}, half_life), [*within, "member_id", "day"])
    out = rejoin(votes, sums, keys)
    for lead, columns in sets.items():
        for short, own, decay in (("p", ["party"], half_life), ("g", [], None)):
            measures = {f"{lead}{short}_yes": F.col("yes"), f"{lead}{short}_n": F.col("n")}
            prior = strict_prior_days(days, [*columns, *own], measures) if decay is None else decayed_prior_days(days, [*columns, *own], measures, decay)
            out = rejoin_few(out, prior, [*columns, *own, "day"])
    return out


def rate(yes: Column, n: Column) -> Column:
    return F.when(n > 0, yes / n)


def baseline_member_rate(k: float = BASELINE_PRIOR, fallback: float = FALLBACK) -> Column:
    """(yes + k * party rate) / (n + k); the party's rate falls back on the global one, that on fallback."""
    party = F.coalesce(rate(F.col("p_yes"), F.col("p_n")), rate(F.col("g_yes"), F.col("g_n")), F.lit(fallback))
    return (F.col("m_yes") + k * party) / (F.col("m_n") + k)


def shrunk(yes: Column, n: Column, prior: Column, k: float, cap: Column | None = None) -> Column:
    weight = n if cap is None else F.least(n.cast("double"), cap)
    return F.when(n > 0, (yes / n * weight + k * prior) / (weight + k)).otherwise(prior)


def member_probability(cap: Column | None = None, analogue: tuple[Column, Column] | None = None) -> Column:
    """Global to party to member to analogue (rate, weight); null without support."""
    c = F.col
    party = shrunk(c("p_yes"), c("p_n"), F.coalesce(rate(c("g_yes"), c("g_n")), F.lit(FALLBACK)), PARTY_PRIOR)
    p = shrunk(c("m_yes"), c("m_n"), party, MEMBER_PRIOR, cap)
    supported = (c("g_n") >= LEAST_GLOBAL) | (c("p_n") > 0) | (c("m_n") > 0)
    if analogue is not None:
        own, weight = analogue[0], F.least(F.lit(float(ANALOGUE_CAP)), analogue[1])
        base = F.greatest(F.lit(1.0), MEMBER_PRIOR + (c("m_n") if cap is None else F.least(c("m_n").cast("double"), cap)))
        blended = own.isNotNull() & (analogue[1] > 0)
        p = F.when(blended, (base * p + weight * own) / (base + weight)).otherwise(p)
        supported = supported | F.coalesce(analogue[1] > 0, F.lit(False))
    return F.when(supported, clamp(p, LOW, HIGH))


def bin_of(p: Column, bins: int = BINS) -> Column:
    return F.least(F.lit(bins - 1), F.floor(p * bins)).cast("int")


def calibrator(forecasts: DataFrame, bins: int = BINS, least: int = LEAST_BIN, smoothing: float = SMOOTHING) -> DataFrame:
    """bin, n, mean_p and calibrated of bins with enough forecasts (p, outcome)."""
    groups = forecasts.groupBy(bin_of(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.sum("outcome").alias("yes")).where(F.col("n") >= least)
    return groups.select("bin", "n", "mean_p", ((F.col("yes") + smoothing * F.col("mean_p")) / (F.col("n") + smoothing)).alias("calibrated"))


def calibrate(forecasts: DataFrame, fitted: DataFrame, bins: int = BINS) -> DataFrame:
    """forecasts with calibrated; a p without a fitted bin stays."""
    met = forecasts.withColumn("bin", bin_of(F.col("p"), bins)).join(F.broadcast(fitted.select("bin", F.col("calibrated").alias("_c"))), "bin", "left")
    return met.withColumn("calibrated", F.coalesce(clamp(F.col("_c"), LOW, HIGH), F.col("p"))).drop("_c")
