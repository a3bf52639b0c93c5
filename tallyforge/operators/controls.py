"""Matched controls: each case beside controls of its own stratum, no control twice, and estimates over the pairs.

Which control a case gets follows from ranks: the rank of a case among the cases of its stratum, by a keyed hash, is that of its controls among theirs.  Ranks are taken within hash buckets and
over the buckets' counts, so a stratum of any size is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Rows in a bucket of ranks, about.
BUCKET_ROWS = 1 << 16


def ranked(rows: DataFrame, strata: list[str], key: str, seed: int, name: str) -> DataFrame:
    """rows (written) with a column name: from 0 within each stratum (nulls are equal), by hash of key; ties of the hash by key."""
    n = rows.count()
    rows = rows.withColumn("_hash", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_stratum", F.to_json(F.struct(*strata), {"ignoreNullFields": "false"}))
    width = F.lit(max(1, -(-n // BUCKET_ROWS)))
    # Equal parts of the hash's range, in its order.
    rows = rows.withColumn("_bucket", F.floor((F.shiftright(F.col("_hash"), 32) + F.lit(1 << 31)) * width / F.lit(1 << 32)))
    counts = rows.groupBy("_stratum", "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("_stratum", "_bucket", (F.sum("_n").over(Window.partitionBy("_stratum").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_stratum", "_bucket").orderBy("_hash", key)) - 1
    return rows.withColumn("_own", own).join(before, ["_stratum", "_bucket"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_bucket", "_hash")


def matched(cases: DataFrame, controls: DataFrame, strata: list[str], key: str, per_case: int = 1, seed: int = 1) -> DataFrame:
    """A row for each case and control of it: strata, pair (the case's rank), case and control (their keys).  Cases beyond the controls of their stratum have fewer, or none and no row.

    key tells the rows of each table apart.  Reruns agree.
    """
    a = ranked(written(cases.select(*strata, key)), strata, key, seed, "pair").select("_stratum", *strata, "pair", F.col(key).alias("case"))
    b = ranked(written(controls.select(*strata, key)), strata, key, seed + 1, "_rank").select("_stratum", F.floor(F.col("_rank") / per_case).cast("long").alias("pair"), F.col(key).alias("control"))
    return a.join(b, ["_stratum", "pair"]).drop("_stratum")


def paired_estimate(pairs: DataFrame, case_outcome: Column, control_outcome: Column, by: list[str] | None = None) -> DataFrame:
    """pairs, case_rate, control_rate, difference, its standard error (null under two pairs), and the pairs in which only the case, or only the control, has the outcome, by group."""
    d = case_outcome - control_outcome
    n = F.count("*")
    return pairs.groupBy(*(by or [])).agg(
        n.alias("pairs"), F.avg(case_outcome).alias("case_rate"), F.avg(control_outcome).alias("control_rate"), F.avg(d).alias("difference"), F.when(n > 1, F.sqrt((F.sum(d * d) - F.sum(d) * F.sum(d) / n) / (n - 1) / n)).alias("error"),
        F.count_if(d > 0).alias("case_only"), F.count_if(d < 0).alias("control_only"),
    )
