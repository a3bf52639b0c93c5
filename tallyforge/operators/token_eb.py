"""Empirical-Bayes models over feature tokens: each token shifts the log odds by its shrunk rate; the strongest shifts of a row are averaged."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, logistic, logit


@dataclass(frozen=True)
class Group:
    """How a kind of token counts: prior strength, least support, how many of the strongest, and the scale of their mean."""

    prior: float
    least: int
    most: int
    scale: float


# Fixed values of the title, structural and text models.
TITLE = Group(100, 25, 8, 0.35)
TITLE_BOUNDS = (0.0025, 0.35)
UNIGRAM, BIGRAM = Group(150, 30, 6, 0.22), Group(120, 20, 4, 0.12)
CHAMBER, NUMBER, LENGTH = Group(600, 1, 1, 0.08), Group(600, 1, 1, 0.18), Group(600, 1, 1, 0.08)
STRUCTURAL_BOUNDS = (0.003, 0.20)
TEXT = Group(200, 40, 10, 0.18)


def shift(pos: Column, total: Column, base: Column, prior: float, least: int) -> Column:
    return F.when(total >= least, logit((pos + prior * base) / (total + prior)) - logit(base)).otherwise(0.0)


def statistics(rows: DataFrame, tokens: str, by: Sequence[str] = ()) -> DataFrame:
    """token, pos and total over training rows (tokens: an array without repeats; outcome)."""
    return rows.select(*by, F.explode(tokens).alias("token"), "outcome").groupBy(*by, "token").agg(F.sum("outcome").alias("pos"), F.count("*").alias("total"))


def strongest_mean(rows: DataFrame, stats: DataFrame, key: str, tokens: str, group: Group, by: Sequence[str] = ()) -> DataFrame:
    """key and delta: the mean of the group.most shifts of largest size; earlier tokens first among equals.  rows and stats have base."""
    met = rows.select(key, *by, "base", F.posexplode(tokens).alias("pos_", "token")).join(stats.drop("base"), [*by, "token"])
    moved = met.withColumn("d", shift(F.col("pos"), F.col("total"), F.col("base"), group.prior, group.least)).where("d <> 0")
    w = Window.partitionBy(key).orderBy(F.desc(F.round(F.abs("d"), 12)), "pos_")
    return moved.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= group.most).groupBy(key).agg(F.avg("d").alias("delta"))


def predict(rows: DataFrame, key: str, groups: dict[str, tuple[DataFrame, Group]], bounds: tuple[float, float], start: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """rows (key, base, a column of tokens for each name of groups) with p.  start: a column of chances to shift instead of base."""
    out, total = rows, logit(F.col(start or "base"))
    for name, (stats, group) in groups.items():
        out = out.join(strongest_mean(rows, stats, key, name, group, by).withColumnRenamed("delta", f"d_{name}"), key, "left")
        total = total + group.scale * F.coalesce(F.col(f"d_{name}"), F.lit(0.0))
    return out.withColumn("p", clamp(logistic(total), *bounds)).drop(*(f"d_{n}" for n in groups))
