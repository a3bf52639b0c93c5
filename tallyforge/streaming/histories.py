"""Streams that meet their own history: supersession whatever the order of arrival, and running counts that an event's rows don't see themselves in.

Both keep what they have seen as Parquet, one folder a micro-batch, which is written again if the batch is tried again; a batch reads only the folders of batches before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def earlier(spark: SparkSession, path: str, schema: object, number: int) -> DataFrame:
    """Rows that batches before number have written under path."""
    if not number:
        return spark.createDataFrame([], schema)
    found = spark.read.option("basePath", path).schema(schema).parquet(*(f"{path}/batch={i}" for i in range(number)))
    return found.select(*(c.name for c in schema))


def driven(stream: DataFrame, put: Callable[[DataFrame, int], None], path: str) -> None:
    """Run put over all that the stream has now; a later run goes on where this one ended."""
    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start().awaitTermination()


def superseding(path: str, series: Sequence[str], fetched: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps all items of a stream and the links between neighbours of a series (null-safe) in the order of fetching, whatever the order of arrival.

    An item that arrives is put between the fetch before and the fetch after it, so the link to the next newer fetch of any item is there in the end: one of the two arrived
    last and met the other.  Links are between times, so many items of one fetch make one link.  Nothing that was written is changed.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keys = [F.col(c) for c in series]
        batch.write.mode("overwrite").parquet(f"{path}/items/batch={number}")
        new = spark.read.schema(batch.schema).parquet(f"{path}/items/batch={number}").select(*keys, F.col(fetched).alias("fetched")).distinct()
        times = earlier(spark, f"{path}/times", new.schema, number)
        same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in series]
        touched = new.select(*series).distinct()
        known = times.join(touched, same(times, touched), "left_semi")
        both = new.withColumn("old", F.lit(0)).unionByName(known.withColumn("old", F.lit(1))).groupBy(*series, "fetched").agg(F.max("old").alias("old"))
        w = Window.partitionBy(*series).orderBy("fetched")
        near = both.withColumn("newer", F.lead("fetched").over(w)).withColumn("newer_old", F.lead("old").over(w))
        near.where("newer IS NOT NULL AND (old = 0 OR newer_old = 0)").select(*series, "fetched", "newer").write.mode("overwrite").parquet(f"{path}/links/batch={number}")
        both.where("old = 0").select(*series, "fetched").write.mode("overwrite").parquet(f"{path}/times/batch={number}")

    return put


def versions(spark: SparkSession, path: str, schema: object, series: Sequence[str], fetched: str, item: str) -> DataFrame:
    """All items that superseding has kept, with superseded_by, the smallest item of the next newer fetch of the series (null: the item is current)."""
    items = spark.read.schema(schema).parquet(f"{path}/items/batch=*")
    key = F.to_json(F.struct(*series), {"ignoreNullFields": "false"})
    links = spark.read.parquet(f"{path}/links/batch=*").groupBy(key.alias("_key"), F.col("fetched").alias("_fetched")).agg(F.min("newer").alias("_newer"))
    heads = items.groupBy(key.alias("_key"), F.col(fetched).alias("_newer")).agg(F.min(item).alias("superseded_by"))
    own = items.withColumn("_key", key).withColumn("_fetched", F.col(fetched))
    return own.join(links, ["_key", "_fetched"], "left").join(heads, ["_key", "_newer"], "left").select(*items.columns, "superseded_by")


def closed_sums(stream: DataFrame, levels: dict[str, Column], at: str, outcome: str, unit: str = "1 day", delay: str = "0 seconds") -> DataFrame:
    """level, key, at, yes and n: outcomes summed over each unit of event time for each value of several levels, given out once the watermark has passed the unit.

    A row counts once at every level; it is summed before it is shuffled, so a level with one key for all rows is no hot one.  Later rows of a closed unit are dropped.
    """
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("level"), key.cast("string").alias("key")) for name, key in levels.items())))
    rows = stream.withWatermark(at, delay).select(F.col(at), F.col(outcome).alias("outcome"), each.alias("x"))
    sums = rows.groupBy(F.window(at, unit).alias("unit"), "x.level", "x.key").agg(F.sum("outcome").cast("long").alias("yes"), F.count("outcome").alias("n"))
    return sums.select("level", "key", F.col("unit.start").alias("at"), "yes", "n")


def running_counts(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over closed_sums: for each level, key and unit the yes and n of all units before it, written under path/counts.

    A unit's rows are never in their own counts, however many batches they came in: units are closed when they get here, and later batches hold later units only.  State is
    a row a key and batch under path/totals, so what a batch reads of its own keys is summed, not replayed.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/closed/batch={number}")
        new = spark.read.schema(batch.schema).parquet(f"{path}/closed/batch={number}")
        totals = new.groupBy("level", "key").agg(F.sum("yes").alias("yes"), F.sum("n").alias("n"))
        same = lambda a, b: (a["level"] == b["level"]) & a["key"].eqNullSafe(b["key"])
        state = earlier(spark, f"{path}/totals", totals.schema, number).groupBy("level", "key").agg(F.sum("yes").alias("had_yes"), F.sum("n").alias("had_n"))
        w = Window.partitionBy("level", "key").orderBy("at")
        own = new.select("*", (F.sum("yes").over(w) - F.col("yes")).alias("in_yes"), (F.sum("n").over(w) - F.col("n")).alias("in_n"))
        met = own.join(state, same(own, state), "left").select(own["level"], own["key"], own["at"], (F.col("in_yes") + F.coalesce("had_yes", F.lit(0))).alias("yes"), (F.col("in_n") + F.coalesce("had_n", F.lit(0))).alias("n"))
        met.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        totals.write.mode("overwrite").parquet(f"{path}/totals/batch={number}")

    return put
