"""As-of operators.  A row of day d learns from days before d only; all rows of a day see the same history.

Counts over earlier days are prefix sums over one row per key and day, joined back: rows are aggregated before they are shuffled, and no window grows with the rows of a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def daily(df: DataFrame, keys: Sequence[str], day: str, measures: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys, day).agg(*(F.sum(m).alias(name) for name, m in measures.items()))


def strict_prior_days(df: DataFrame, keys: Sequence[str], measures: dict[str, Column], day: str = "day") -> DataFrame:
    """keys, day and the sum of each measure over the rows of equal keys and earlier days, for each day of df; 0 where there are none."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return daily(df, keys, day, measures).select(*keys, day, *(F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in measures))


def strict_prior(df: DataFrame, keys: Sequence[str], measures: dict[str, Column], day: str = "day") -> DataFrame:
    """df with the sums of strict_prior_days.  Null keys are a key."""
    return rejoin(df, strict_prior_days(df, keys, measures, day), [*keys, day])


def rejoin(df: DataFrame, more: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inner join on null-safe equal names, which stay once."""
    other = more.select(*(F.col(n).alias(f"_{n}") for n in names), *(c for c in more.columns if c not in names))
    on = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    return df.join(other, on).drop(*(f"_{n}" for n in names))


#: Rows of a table that are broadcast at most.
FEW = 200_000


def rejoin_few(df: DataFrame, more: DataFrame, names: Sequence[str]) -> DataFrame:
    """As rejoin, for more that may be few rows: it is written and counted, and broadcast if so."""
    few = written(more)
    return rejoin(df, F.broadcast(few) if few.count() <= FEW else few, names)


#: Half-lives that a history may span: a double holds 2 to the power of 1023.
MOST_HALF_LIVES = 900


def decayed_prior_days(df: DataFrame, keys: Sequence[str], measures: dict[str, Column], half_life: float, day: str = "day") -> DataFrame:
    """As strict_prior_days, with each earlier day's sum halved every half_life days.

    In closed form: weights grow with the day from the key's first day and are scaled back.  A history of over MOST_HALF_LIVES raises an error.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    age = (F.col(day) - F.min(day).over(Window.partitionBy(*keys))) / half_life
    per_day = daily(df, keys, day, measures).withColumn("_age", age).withColumn("_age", F.when(F.col("_age") > MOST_HALF_LIVES, F.raise_error(F.lit("a history spans too many half-lives")).cast("double")).otherwise(F.col("_age")))
    grown = F.pow(F.lit(2.0), F.col("_age"))
    return per_day.select(*keys, day, *(F.coalesce(F.sum(F.col(n) * grown).over(before) / grown, F.lit(0.0)).alias(n) for n in measures))


def decayed_prior(df: DataFrame, keys: Sequence[str], measures: dict[str, Column], half_life: float, day: str = "day") -> DataFrame:
    """df with the sums of decayed_prior_days."""
    return rejoin(df, decayed_prior_days(df, keys, measures, half_life, day), [*keys, day])


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key by order, which should leave no ties."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_day: str, right_day: str, values: Sequence[str], strict: bool = True) -> DataFrame:
    """left with values of the right row of equal keys whose day is the latest before (or, if not strict, on) left's; null where there is none.

    The two are merged in one window per key, with the last non-null right row carried forward: rows in, rows out, with no pairs.  Of right rows of a day the greatest values win.
    """
    last = right.groupBy(*keys, F.col(right_day).alias("_day")).agg(F.max(F.struct(*values)).alias("_value"))
    other = last.select(*keys, "_day", F.lit(0 if not strict else 1).alias("_side"), F.struct(F.col("_day").alias(right_day), "_value").alias("_value"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    own = left.select(*keys, F.col(left_day).alias("_day"), F.lit(1 if not strict else 0).alias("_side"), F.lit(None).cast(other.schema["_value"].dataType).alias("_value"), F.struct("*").alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_day", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = own.unionByName(other).withColumn("_last", F.last("_value", ignorenulls=True).over(w)).where("_row IS NOT NULL")
    return found.select("_row.*", F.col(f"_last.{right_day}").alias(right_day), *(F.col(f"_last._value.{v}").alias(v) for v in values))


def active_on(day: Column, starts: Column, ends: Column) -> Column:
    """Whether a validity interval with open ends holds day."""
    return (starts.isNull() | (starts <= day)) & (ends.isNull() | (ends >= day))


def not_superseded(items: DataFrame, replacements: DataFrame, cutoff: Column) -> DataFrame:
    """items (id) without those that a replacement (old_id, known_on) known by the cutoff hides."""
    known = replacements.where(F.col("known_on") <= cutoff).select(F.col("old_id").alias("id")).distinct()
    return items.join(known, "id", "left_anti")


def unique_or_null(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys with value where it is the only one, else null."""
    return df.groupBy(*keys).agg(F.when(F.count_distinct(value) == 1, F.min(value)).alias(value))
