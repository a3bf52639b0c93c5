"""Structured Streaming jobs: rates kept by key, duplicates dropped, upserts by batch, and schedules.

Each takes a streaming DataFrame; run_once() drives one over what is there now and gives its output as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..operators.evidence import insert_if_absent


def run_once(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Output of a stream over all that is there, as Parquet under path with its checkpoint beside it; a second run goes on where the first ended."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start(f"{path}/rows")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def deduplicated(stream: DataFrame, key: str, event_time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def tumbling_counts(stream: DataFrame, event_time: str, key: str, width: str, delay: str) -> DataFrame:
    """Rows and their mean value by window and key, given out once the watermark has passed the window."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), key).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


class DecayedRate(StatefulProcessor):
    """Per key: yes and total, halved every half_life days, as of the last day seen.

    Rows of a batch are taken by day; all rows of a day get the rate before that day.  Days may not go back between batches; earlier rows count as of the last day.
    """

    def __init__(self, half_life: float):
        self.half_life = half_life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rate", StructType([StructField("yes", DoubleType()), StructField("total", DoubleType()), StructField("day", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        f = pd.concat(list(rows)).sort_values(["day", "id"])
        yes, total, last = self.state.get() if self.state.exists() else (0.0, 0.0, None)
        out = []
        for day, own in f.groupby("day"):
            if last is not None:
                factor = 2.0 ** (-max(0, day - last) / self.half_life)
                yes, total = yes * factor, total * factor
            out.append(pd.DataFrame({"key": key[0], "id": own["id"], "yes": yes, "total": total}))
            yes, total, last = yes + float(own["outcome"].sum()), total + len(own), int(day)
        self.state.update((yes, total, last))
        yield pd.concat(out)

    def close(self) -> None:
        pass


def decayed_rates(stream: DataFrame, half_life: float) -> DataFrame:
    """key, id and the decayed yes and total of the key before the row's day, of rows (key long, id long, day long, outcome long)."""
    return stream.groupBy("key").transformWithStateInPandas(DecayedRate(half_life), "key long, id long, yes double, total double", "append", "none")


def upserting(spark: SparkSession, path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends the rows of new keys to Parquet under path, one batch at a time.

    Each batch has its own folder, written again if the batch is: so a batch that is tried twice counts once.
    """

    def put(batch: DataFrame, number: int) -> None:
        own = f"{path}/batch={number}"
        done = spark.read.option("basePath", path).schema(batch.schema).parquet(f"{path}/batch=*") if number else None
        new = batch.groupBy(*keys).agg(F.min(F.struct(*[c for c in batch.columns if c not in keys])).alias("r")).select(*keys, "r.*") if done is None else insert_if_absent(done.where(F.input_file_name().rlike("batch=") & ~F.input_file_name().contains(f"batch={number}/")), batch, keys)
        new.write.mode("overwrite").parquet(own)

    return put


def due(schedules: DataFrame, now: F.Column) -> DataFrame:
    """schedules (next_run, cadence_hours, failures, enabled) with claimed, and next_run moved on where claimed; after five failures a schedule is off."""
    on = F.col("enabled") & (F.col("failures") < 5)
    claimed = on & (F.col("next_run") <= now)
    moved = F.greatest(F.col("next_run"), now) + F.make_dt_interval(F.lit(0), F.col("cadence_hours"))
    return schedules.withColumn("claimed", claimed).withColumn("next_run", F.when(claimed, moved).otherwise(F.col("next_run"))).withColumn("enabled", on)
