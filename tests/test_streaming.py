"""Streams give what batches give, and going on where they ended changes nothing."""

from pyspark.sql import functions as F

from tallyforge.streaming.jobs import deduplicated, run_once, tumbling_counts, upserting


def source(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "key int, ts timestamp, value double").coalesce(1).write.mode("overwrite").parquet(f"{path}/b={i}")
    return spark.readStream.schema("key int, ts timestamp, value double").parquet(f"{path}/b=*")


def at(hour):
    import datetime

    return datetime.datetime(2024, 1, 1 + hour // 24, hour % 24)


def test_deduplication_over_two_runs(spark, tmp_path):
    first = [(1, at(1), 1.0), (2, at(1), 2.0), (1, at(2), 3.0)]
    out = str(tmp_path / "out")
    assert run_once(deduplicated(source(spark, str(tmp_path / "in"), [first]), "key", "ts"), out).count() == 2
    again = source(spark, str(tmp_path / "in"), [first, [(2, at(3), 1.0), (3, at(3), 1.0)]])
    assert sorted(r["key"] for r in run_once(deduplicated(again, "key", "ts"), out).collect()) == [1, 2, 3]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [(1, at(h), float(h)) for h in range(10)] + [(1, at(100), 0.0)]
    found = run_once(tumbling_counts(source(spark, str(tmp_path / "in"), [rows]), "ts", "key", "4 hours", "1 hour"), str(tmp_path / "out")).collect()
    assert sorted((r["n"], r["mean"]) for r in found)[-2:] == [(4, 1.5), (4, 5.5)]


def test_a_batch_tried_twice_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    put = upserting(spark, path, ["k"])
    df = lambda *ks: spark.createDataFrame([(k, f"v{k}") for k in ks], "k int, v string")
    put(df(1, 2, 2), 0)
    put(df(2, 3), 1)
    put(df(2, 3), 1)
    assert sorted(r["k"] for r in spark.read.parquet(path).select(F.col("k")).collect()) == [1, 2, 3]
