"""Evidence: admission, impact, idempotent ingestion, supersession and ledgers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import logistic, logit

# Weights of an evidence signal.
KIND = {"direct_statement": 4.0, "related_statement": 1.25, "fact": 0.65, "context": 0.35, "inference": 0.25}
QUALITY = {"official": 1.0, "member_primary": 1.0, "reputable_secondary": 0.8, "other": 0.55, "unknown": 0.35}
RELEVANCE = {"direct": 1.0, "high": 0.8, "medium": 0.55, "low": 0.3}
FRESHNESS = {"current": 1.0, "recent": 0.85, "stale": 0.45, "unknown": 0.65}
STANCE = {"supports": 1.0, "opposes": -1.0, "mixed": 0.0, "neutral": 0.0, "unclear": 0.0}


def looked_up(value: Column, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def logit_delta(kind: Column, stance: Column, quality: Column, relevance: Column, freshness: Column, confidence: Column) -> Column:
    return looked_up(stance, STANCE) * looked_up(kind, KIND) * looked_up(quality, QUALITY) * looked_up(relevance, RELEVANCE) * looked_up(freshness, FRESHNESS) * F.coalesce(confidence, F.lit(0.5))


def shifted(p: Column, delta: Column) -> Column:
    """p, held to [.005, .995], with its log odds shifted."""
    return F.least(F.lit(0.995), F.greatest(F.lit(0.005), logistic(logit(p, 0.005) + delta)))


def admission(day: Column, cutoff: Column, verified: Column, stance: Column, kind: Column, relevance: Column, quality: Column, confidence: Column) -> Column:
    """struct(allowed, reason): the first rule that excludes, in this order, or none."""
    reason = (
        F.when(~F.coalesce(verified, F.lit(True)), "source not verified")
        .when(day.isNull(), "no usable date")
        .when(day >= cutoff, "after cutoff")
        .when(~stance.isin("supports", "opposes"), "no direction")
        .when(kind == "inference", "inference")
        .when(relevance == "low", "low relevance")
        .when(quality == "unknown", "unknown source")
        .when(confidence < 0.5, "low confidence")
    )
    return F.struct(reason.isNull().alias("allowed"), F.coalesce(reason, F.lit("admitted")).alias("reason"))


def validation_errors(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail, as an array; a null check fails."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items())), lambda x: x.isNotNull())


def ingestion_key(*parts: Column) -> Column:
    """SHA-256 of the parts, null apart from empty."""
    return F.sha2(F.to_json(F.struct(*(p.cast("string").alias(f"p{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}).cast("binary"), 256)


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of incoming to append: keys not in target, one row per key."""
    new = incoming.join(target.select(*keys).distinct(), list(keys), "left_anti")
    others = [c for c in incoming.columns if c not in keys]
    return new.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in others)) if others else new.distinct()


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str], merged: str | None = None) -> DataFrame:
    """target with incoming's rows put in by key; merged: a map column whose entries are united, incoming's winning."""
    values = [c for c in target.columns if c not in keys]
    old, new = target.select(*keys, F.struct(*values).alias("_old")), incoming.select(*keys, F.struct(*values).alias("_new"))
    both = old.join(new, list(keys), "full_outer")

    def pick(c: str) -> Column:
        a, b = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        if c == merged:
            empty = F.create_map().cast(target.schema[c].dataType)
            left = F.map_filter(F.coalesce(a, empty), lambda k, _: ~F.map_contains_key(F.coalesce(b, empty), k))
            return F.map_concat(left, F.coalesce(b, empty))
        return F.when(F.col("_new").isNotNull(), b).otherwise(a)

    return both.select(*keys, *(pick(c).alias(c) for c in values))


def first_seen(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row by order of each key."""
    return df.withColumn("_k", key).withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).where("_n = 1").drop("_k", "_n")


def superseded(df: DataFrame, series: Sequence[str], fetched: str, *tie: str) -> DataFrame:
    """df with current: whether it is the last fetched of its series.  All rows stay."""
    w = Window.partitionBy(*series).orderBy(F.desc(fetched), *(F.desc(t) for t in tie))
    return df.withColumn("current", F.row_number().over(w) == 1)


def bounded_read(df: DataFrame, most: int) -> DataFrame:
    """df if it has most rows at most; raises instead of cutting it."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def chain_breaks(ledger: DataFrame, keys: Sequence[str], day: str, seal: str, prior: str) -> DataFrame:
    """Rows whose prior seal isn't the seal of the row before."""
    w = Window.partitionBy(*keys).orderBy(day)
    return ledger.withColumn("_last", F.lag(seal).over(w)).where(~F.col(prior).eqNullSafe(F.col("_last"))).drop("_last")


def sealed(content: Column) -> Column:
    """The seal of a day's content."""
    return F.sha2(content.cast("binary"), 256)


def admitted_within(requests: DataFrame, key: str, at: str, tie: str, most: int, span: int) -> DataFrame:
    """requests with admitted: whether fewer than most admitted ones of the key lie less than span before.

    Decisions depend on those before, so a key's requests are taken in order by one task, in batches of which only the last most times are kept.
    """
    schema = f"{key} long, {at} long, {tie} long, admitted boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, []
        for f in frames:
            out = []
            for k, t in zip(f[key], f[at], strict=True):
                if k != last:
                    last, kept = k, []
                kept = [x for x in kept if x > t - span]
                out.append(len(kept) < most)
                if out[-1]:
                    kept.append(t)
            yield f.assign(admitted=out)

    # Sorted within partitions by key: a key's rows are never gathered as a group, they stream by.
    return requests.select(key, at, tie).repartition(key).sortWithinPartitions(key, at, tie).mapInPandas(run, schema)
