"""Ridge logistic regression with a fixed offset: Newton steps whose gradient and Hessian are Spark aggregates.

The driver holds one small matrix (features squared), never rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import logistic


def standardized(df: DataFrame, names: list[str]) -> DataFrame:
    """names less their mean, over their sample deviation (1 where that is next to nothing)."""
    stats = df.agg(*(F.avg(n).alias(f"{n}_m") for n in names), *(F.stddev_samp(n).alias(f"{n}_s") for n in names))
    met = df.crossJoin(F.broadcast(stats))
    scale = lambda n: F.when(F.col(f"{n}_s") > 1e-9, F.col(f"{n}_s")).otherwise(1.0)
    return met.select(*(((F.col(c) - F.col(f"{c}_m")) / scale(c)).alias(c) if c in names else F.col(c) for c in df.columns))


def ridge_logistic(df: DataFrame, names: list[str], outcome: str, offset: Column | None = None, penalty: float = 1.0, rounds: int = 30, tolerance: float = 1e-7) -> np.ndarray:
    """Coefficients of names that minimize the summed log loss plus penalty / 2 times their squares; offset: log odds added to each row."""
    rows = df.select(F.array(*(F.col(n).cast("double") for n in names)).alias("x"), F.col(outcome).cast("double").alias("y"), (F.lit(0.0) if offset is None else offset).alias("o")).persist()
    beta, k = np.zeros(len(names)), len(names)
    try:
        for _ in range(rounds):
            p = logistic(F.col("o") + sum((float(b) * F.col("x")[i] for i, b in enumerate(beta)), F.lit(0.0)))
            own = rows.select("x", (p - F.col("y")).alias("e"), (p * (1 - p)).alias("w"))
            sums = own.agg(*(F.sum(F.col("e") * F.col("x")[i]) for i in range(k)), *(F.sum(F.col("w") * F.col("x")[i] * F.col("x")[j]) for i in range(k) for j in range(i, k))).first()
            if sums is None or sums[0] is None:
                return beta
            gradient, hessian, at = np.array(sums[:k]) + penalty * beta, np.diag([penalty] * k), k
            for i in range(k):
                for j in range(i, k):
                    hessian[i, j] = hessian[i, j] + sums[at]
                    hessian[j, i] = hessian[i, j]
                    at += 1
            step = np.linalg.solve(hessian, gradient)
            beta = beta - step
            if np.abs(step).max() < tolerance:
                break
    finally:
        rows.unpersist()
    return beta


def coordinate_ridge(df: DataFrame, names: list[str], outcome: str, offset: Column, penalty: float = 1.0, rounds: int = 40, tolerance: float = 1e-7) -> np.ndarray:
    """The same minimum by one coordinate at a time: each step is one aggregate over the rows; a round visits every coordinate."""
    beta = np.zeros(len(names))
    for _ in range(rounds):
        largest = 0.0
        for i, name in enumerate(names):
            p = logistic(offset + sum((float(b) * F.col(n) for b, n in zip(beta, names, strict=True)), F.lit(0.0)))
            x = F.col(name)
            pull, curve = df.agg(F.sum(x * (F.col(outcome) - p)), F.sum(x * x * F.greatest(F.lit(1e-8), p * (1 - p)))).first()
            step = ((pull or 0.0) - penalty * beta[i]) / ((curve or 0.0) + penalty)
            beta[i] += step
            largest = max(largest, abs(step))
        if largest < tolerance:
            break
    return beta


def with_prediction(df: DataFrame, names: list[str], beta: np.ndarray, offset: Column | None = None) -> DataFrame:
    total = F.lit(0.0) if offset is None else offset
    for n, b in zip(names, beta, strict=True):
        total = total + float(b) * F.col(n)
    return df.withColumn("p", logistic(total))
