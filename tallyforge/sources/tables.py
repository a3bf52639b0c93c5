"""Readers, and the views in which driver tables stand for votes, bills and evidence.

lineitem is one vote of a member (supplier) in an event (order); the nation's region is the party, the line status the chamber, the order's year the session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, kind: str = "table") -> str:
    """A new folder in the shared folder that the session names; a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: worked out once for all that read it, and kept when executors are lost."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def day_number(value: Column | str) -> Column:
    """Days since 1970-01-01, in no time zone."""
    return F.unix_date(F.to_date(value))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observation_id, event_id, member_id, party, chamber, session, day, outcome, weight of every vote."""
    lines = read(spark, sf_dir, "lineitem")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    members = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(members, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("observation_id"),
        F.col("l_orderkey").alias("event_id"),
        F.col("l_suppkey").alias("member_id"),
        F.col("n_regionkey").alias("party"),
        F.col("l_linestatus").alias("chamber"),
        F.year("o_orderdate").alias("session"),
        day_number("o_orderdate").alias("day"),
        (F.col("l_returnflag") != "R").cast("int").alias("outcome"),
        F.col("l_discount").alias("weight"),
    )


VOTES_SQL = """votes AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey) AS observation_id, l_orderkey AS event_id, l_suppkey AS member_id, n_regionkey AS party,
         l_linestatus AS chamber, year(o_orderdate)::INTEGER AS session, (o_orderdate::DATE - DATE '1970-01-01')::INTEGER AS day,
         (l_returnflag <> 'R')::INTEGER AS outcome, l_discount AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bill_id, stage, day, outcome of every stage event; the outcome is whether its value is 50 or more."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("bill_id"), F.col("event_type").alias("stage"), day_number("ts").alias("day"), (F.col("value") >= 50).cast("int").alias("outcome"))


STAGES_SQL = """stages AS (
  SELECT event_id, user_id AS bill_id, event_type AS stage, (ts::DATE - DATE '1970-01-01')::INTEGER AS day, (value >= 50)::INTEGER AS outcome FROM events)"""


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member_id with a validity interval starts_on..ends_on (day numbers, either may be open)."""
    k = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier")
    return s.select(k.alias("member_id"), F.when(k % 5 != 0, 9131 + (k % 7) * 200).cast("int").alias("starts_on"), F.when(k % 3 != 0, 10500 + (k % 11) * 90).cast("int").alias("ends_on"))


MEMBERSHIPS_SQL = """memberships AS (
  SELECT s_suppkey AS member_id, CASE WHEN s_suppkey % 5 <> 0 THEN (9131 + (s_suppkey % 7) * 200)::INTEGER END AS starts_on,
         CASE WHEN s_suppkey % 3 <> 0 THEN (10500 + (s_suppkey % 11) * 90)::INTEGER END AS ends_on FROM supplier)"""


def money(text: Column | str) -> Column:
    """A sum of money as written ($1,234.50) as a number; 0 where it is none."""
    return F.coalesce(F.regexp_replace(text, "[$,]", "").try_cast("double"), F.lit(0.0))


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Quoted CSV with a header, line breaks inside quotes (which come back as \\n), doubled quotes; broken rows fail."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "FAILFAST").option("sep", sep).csv(path)


def html_text(html: Column | str) -> Column:
    """Visible text: no scripts, styles, comments or tags; common entities resolved; white space squeezed."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))
