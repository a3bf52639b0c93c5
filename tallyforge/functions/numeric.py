"""Numbers: log odds, distribution functions, entropy, bands."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def logit(p: Column, bound: float = 1e-9) -> Column:
    p = clamp(p, bound, 1 - bound)
    return F.log(p / (1 - p))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def normal_cdf(z: Column) -> Column:
    """By the five-term polynomial of Abramowitz and Stegun, 26.2.17."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        tail = (tail + c) * t
    tail = tail * F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def laplace_cdf(z: Column) -> Column:
    """Of unit standard deviation."""
    side = 0.5 * F.exp(-math.sqrt(2) * F.abs(z))
    return F.when(z >= 0, 1 - side).otherwise(side)


def logistic_cdf(z: Column) -> Column:
    """Of unit standard deviation."""
    return logistic(z * (math.pi / math.sqrt(3)))


def entropy_bits(p: Column) -> Column:
    q = 1 - p
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + q * F.log2(q)))


def half_life(age: Column, half: float) -> Column:
    return F.pow(F.lit(2.0), -age / half)


def width_band(n: Column, width: int = 500) -> Column:
    """1-500, 501-1000, ...; unknown for null and less than 1."""
    low = F.floor((n - 1) / width) * width
    return F.when(n >= 1, F.concat((low + 1).cast("string"), F.lit("-"), (low + width).cast("string"))).otherwise("unknown")


def step_band(n: Column, *steps: tuple[int, str], above: str) -> Column:
    """The name of the first step that n doesn't exceed."""
    out = F.lit(above)
    for most, name in reversed(steps):
        out = F.when(n <= most, name).otherwise(out)
    return out


def required_yes(kind: Column, seats: Column, numerator: Column | None = None, denominator: Column | None = None, fixed: Column | None = None) -> Column:
    """Votes needed: over half of seats (or of votes cast), a fraction of seats rounded up, or a fixed number."""
    out = F.when(kind.isin("majority-of-cast", "absolute-majority"), F.floor(seats / 2) + 1)
    if numerator is not None:
        out = out.when(kind == "fraction-of-seats", F.ceil(seats * numerator / denominator))
    return (out.when(kind == "fixed", fixed) if fixed is not None else out).cast("long")
