"""A Spark session for all tests, and DuckDB over the driver's tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x: object) -> str:
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and hasattr(x, "__len__"):
        return str([plain(v) for v in x])
    if x is None or pd.isna(x):
        return ""
    if isinstance(x, float):
        x = round(x, 5) + 0.0
        return str(int(x)) if x == int(x) else str(x)
    return str(x)


def comparable(df: pd.DataFrame) -> pd.DataFrame:
    names = sorted(df.columns)
    return df[names].map(plain).sort_values(names).reset_index(drop=True)


@pytest.fixture(scope="session")
def same():
    def check(spark_df, sql_df: pd.DataFrame) -> None:
        pd.testing.assert_frame_equal(comparable(spark_df.toPandas()), comparable(sql_df), check_dtype=False)

    return check
