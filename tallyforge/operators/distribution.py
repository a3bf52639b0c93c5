"""Distributions of a group's count from its members' chances, and simulation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import normal_cdf

# The historical error of the count, and from how many members on it is applied.
YES_MAE = 18.063455435783432
SIGMA = YES_MAE * math.sqrt(math.pi / 2)
LEAST_MEMBERS = 20
INTERVAL = 0.8
SHOCKS = (0.2, 0.45, 0.35)


def count_pmf(chances: Column) -> Column:
    """Poisson binomial: chances of 0..n, from an array of chances, taken in order of size so that sums don't depend on row order."""
    zero = F.array(F.lit(0.0))

    def step(pmf: Column, p: Column) -> Column:
        return F.zip_with(F.concat(pmf, zero), F.concat(zero, pmf), lambda stay, up: stay * (1 - p) + up * p)

    return F.aggregate(F.array_sort(chances), F.array(F.lit(1.0)), step)


def without_one(pmf: Column, p: Column, at: Column) -> Column:
    """The chance of a count at of the others: the member of chance p divided out of pmf, from the end that is stable; 0 outside 0..n-1."""
    up = F.aggregate(F.slice(pmf, F.lit(1), at + 1), F.lit(0.0), lambda f, g: (g - p * f) / (1 - p))
    n = F.size(pmf)
    down = F.aggregate(F.reverse(F.slice(pmf, at + 2, n)), F.lit(0.0), lambda f, g: (g - (1 - p) * f) / p)
    return F.when((at < 0) | (at > n - 2), 0.0).when(p <= 0.5, up).otherwise(down)


def quantile(pmf: Column, q: float) -> Column:
    """The least count whose cumulative chance reaches q; the last if none does."""
    sums = F.aggregate(pmf, F.struct(F.lit(0.0).alias("cum"), F.lit(0).alias("below")), lambda s, x: F.struct((s["cum"] + x).alias("cum"), (s["below"] + F.when(s["cum"] + x < q, 1).otherwise(0)).alias("below")))
    return F.least(sums["below"], F.size(pmf) - 1)


def smoothed_cdf(pmf: Column, boundary: Column, sigma: Column) -> Column:
    """Chance of a count up to boundary, each count spread as a normal of sigma (0: not at all)."""
    plain = F.aggregate(F.transform(pmf, lambda x, i: F.when(i <= boundary, x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    spread = F.aggregate(F.transform(pmf, lambda x, i: x * normal_cdf((boundary - i) / sigma)), F.lit(0.0), lambda a, x: a + x)
    return F.when(sigma > 0, spread).otherwise(plain)


def smoothed_quantile(pmf: Column, q: float, sigma: Column) -> Column:
    n = F.size(pmf) - 1
    found = F.filter(F.sequence(F.lit(0), n), lambda k: smoothed_cdf(pmf, k + 0.5, sigma) >= q)
    return F.when(sigma > 0, F.coalesce(F.get(found, F.lit(0)), n)).otherwise(quantile(pmf, q))


def chamber(forecasts: DataFrame, by: list[str], required: Column | None = None, interval: float = INTERVAL, error: float = SIGMA) -> DataFrame:
    """members, expected_yes, required_yes, pmf, independent_p, passage_p, yes_low, yes_high by group.  required: over half of the members if not given.  error: of the count, from LEAST_MEMBERS on; 0 for none."""
    groups = forecasts.groupBy(*by).agg(F.count("*").alias("members"), F.array_sort(F.collect_list("p")).alias("chances"))
    out = groups.withColumn("expected_yes", F.aggregate("chances", F.lit(0.0), lambda a, x: a + x)).withColumn("required_yes", (F.floor(F.col("members") / 2) + 1 if required is None else required).cast("long"))
    out = out.withColumn("pmf", count_pmf(F.col("chances"))).withColumn("sigma", F.when(F.col("members") >= LEAST_MEMBERS, error).otherwise(0.0))
    pmf, need, sigma = F.col("pmf"), F.col("required_yes"), F.col("sigma")
    at_least = F.aggregate(F.transform(pmf, lambda x, i: F.when(i >= need, x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    passage = F.when(need <= 0, 1.0).when(need > F.col("members"), 0.0).otherwise(1 - smoothed_cdf(pmf, need - 0.5, sigma))
    tail = (1 - interval) / 2
    bounded = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return out.select(
        *by, "members", "expected_yes", "required_yes", "pmf", bounded(at_least).alias("independent_p"), bounded(passage).alias("passage_p"),
        smoothed_quantile(pmf, tail, sigma).cast("long").alias("yes_low"), smoothed_quantile(pmf, 1 - tail, sigma).cast("long").alias("yes_high"),
    )


def simulated(forecasts: DataFrame, by: str, coalition: str = "party", runs: int = 25_000, seed: int = 20_260_908, interval: float = INTERVAL) -> DataFrame:
    """by, members, expected_yes, yes_low, yes_high and passage_p by drawing shocks of the whole, of the bill and of each coalition on the log odds.

    Each group draws the same numbers from the start, as the generator is seeded anew for each: every run has its shocks, and one number for each place of a member and of a coalition.  A member
    votes yes where its number lies under its chance, that is where its log odds exceed the number's less the shocks; so a task works out these bounds once and compares them with each group's
    log odds.  One group is one array of chances in a task.
    """
    rows = forecasts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("p", F.col(coalition).cast("string").alias("c")))).alias("m")).select(F.col(by).cast("long").alias(by), F.col("m.p").alias("p"), F.col("m.c").alias("c"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds = ShockBounds(runs, seed)
        for f in frames:
            out = []
            for key, p, c in zip(f[by], f["p"], f["c"], strict=True):
                p = np.clip(np.asarray(p, float), 1e-6, 1 - 1e-6)
                of = np.unique(np.asarray(c, str), return_inverse=True)[1]
                counts = bounds.counts(np.log(p / (1 - p)), of)
                low, high = np.searchsorted(np.cumsum(counts), [np.ceil(runs * q) for q in ((1 - interval) / 2, (1 + interval) / 2)])
                out.append((key, len(p), (counts @ np.arange(len(counts))) / runs, int(low), int(high), counts[len(p) // 2 + 1 :].sum() / runs))
            yield pd.DataFrame(out, columns=[by, "members", "expected_yes", "yes_low", "yes_high", "passage_p"])

    return rows.mapInPandas(run, f"{by} long, members long, expected_yes double, yes_low long, yes_high long, passage_p double")


class ShockBounds:
    """What each run's shocks and numbers ask of a member's log odds, by the member's place in its group and its coalition's: worked out when first met, at most KEPT of them kept."""

    KEPT = 256

    def __init__(self, runs: int, seed: int):
        self.runs, self.seed = runs, seed
        self.whole = self.normal(0, 0) * SHOCKS[0] + self.normal(1, 0) * SHOCKS[2]
        self.kept: dict[tuple[int, int], np.ndarray] = {}

    def normal(self, kind: int, place: int) -> np.ndarray:
        return np.random.default_rng([self.seed, kind, place]).normal(size=self.runs)

    def of(self, member: int, coalition: int) -> np.ndarray:
        found = self.kept.get((member, coalition))
        if found is None:
            u = np.random.default_rng([self.seed, 3, member]).random(self.runs)
            with np.errstate(divide="ignore"):
                found = np.log(u / (1 - u)) - self.whole - self.normal(2, coalition) * SHOCKS[1]
            if len(self.kept) < self.KEPT:
                self.kept[member, coalition] = found
        return found

    def counts(self, odds: np.ndarray, coalitions: np.ndarray) -> np.ndarray:
        """In how many runs 0, 1 ... all of the members (their log odds and the places of their coalitions) vote yes."""
        n = np.zeros(self.runs, np.uint8 if len(odds) < 256 else np.int64)
        for i, (x, c) in enumerate(zip(odds.tolist(), coalitions.tolist(), strict=True)):
            n += (self.of(i, c) < x).view(np.uint8)
        if len(odds) < 16:
            return np.array([np.count_nonzero(n == k) for k in range(len(odds) + 1)])
        return np.bincount(n, minlength=len(odds) + 1)


def xorshift(seed: int) -> Iterator[float]:
    """Numbers in [0, 1) of the 32-bit xorshift generator with shifts 13, 17 and 5."""
    state = seed & 0xFFFFFFFF or 0x6D2B79F5
    while True:
        state ^= state << 13 & 0xFFFFFFFF
        state ^= state >> 17
        state ^= state << 5 & 0xFFFFFFFF
        yield state / 0x100000000


def xorshift_simulated(forecasts: DataFrame, by: str, member: str, runs: int = 10_000, seed: int = 1, interval: float = 0.9) -> DataFrame:
    """by, members, expected_yes, passage_p, yes_low and yes_high from runs draws of every member in order of member; each group draws the same numbers from the start."""
    rows = forecasts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(member, "p"))).alias("m")).select(F.col(by).cast("long").alias(by), F.col("m.p").alias("p"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn, source = np.zeros(0), xorshift(seed)
        for f in frames:
            out = []
            for key, p in zip(f[by], f["p"], strict=True):
                p = np.asarray(p, float)
                if len(drawn) < runs * len(p):
                    drawn = np.concatenate([drawn, np.fromiter(source, float, runs * len(p) - len(drawn))])
                yes = np.sort((drawn[: runs * len(p)].reshape(runs, len(p)) < p).sum(axis=1))
                tail = (1 - interval) / 2
                low, high = (int(yes[min(runs - 1, int(np.floor(q * runs)))]) for q in (tail, 1 - tail))
                out.append((key, len(p), p.sum(), (yes >= len(p) // 2 + 1).mean(), low, high))
            yield pd.DataFrame(out, columns=[by, "members", "expected_yes", "passage_p", "yes_low", "yes_high"])

    return rows.mapInPandas(run, f"{by} long, members long, expected_yes double, passage_p double, yes_low long, yes_high long")
