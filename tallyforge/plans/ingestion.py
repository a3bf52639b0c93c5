"""Evidence, ingestion and stateful queries (SRC-22 to SRC-29, PRJ-16 to PRJ-22, MDL-15, STR, UDF)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators.asof import not_superseded, strict_prior
from ..operators.rates import rate
from ..sources.tables import STAGES_SQL, day_number, money, read, scratch, stages
from ..streaming.jobs import decayed_rates, deduplicated, due, run_once
from .registry import query

#: Events as evidence: kind by type, stance by value, the rest by id.
SIGNALS_SQL = """signals AS (
  SELECT event_id, user_id, (ts::DATE - DATE '1970-01-01')::INTEGER AS day, CASE event_type WHEN 'view' THEN 'context' WHEN 'click' THEN 'fact' WHEN 'purchase' THEN 'direct_statement' ELSE 'inference' END AS kind,
         CASE WHEN value >= 60 THEN 'supports' WHEN value <= 40 THEN 'opposes' ELSE 'neutral' END AS stance, CASE event_id % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'reputable_secondary' WHEN 2 THEN 'other' ELSE 'unknown' END AS quality,
         CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS relevance, CASE WHEN event_id % 5 <> 0 THEN value / 100 END AS confidence, event_id % 7 <> 0 AS verified FROM events)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v, t = F.col("event_id"), F.col("value"), F.col("event_type")
    return read(spark, sf_dir, "events").select(
        "event_id", "user_id", day_number("ts").alias("day"),
        F.when(t == "view", "context").when(t == "click", "fact").when(t == "purchase", "direct_statement").otherwise("inference").alias("kind"),
        F.when(v >= 60, "supports").when(v <= 40, "opposes").otherwise("neutral").alias("stance"),
        F.when(i % 4 == 0, "official").when(i % 4 == 1, "reputable_secondary").when(i % 4 == 2, "other").otherwise("unknown").alias("quality"),
        F.when(i % 3 == 0, "high").when(i % 3 == 1, "medium").otherwise("low").alias("relevance"),
        F.when(i % 5 != 0, v / 100).alias("confidence"), (i % 7 != 0).alias("verified"),
    )


ADMITTED_SQL = """admitted AS (SELECT *, CASE WHEN NOT coalesce(verified, true) THEN 'source not verified' WHEN day IS NULL THEN 'no usable date' WHEN day >= 19740 THEN 'after cutoff' WHEN stance NOT IN ('supports', 'opposes') THEN 'no direction'
  WHEN kind = 'inference' THEN 'inference' WHEN relevance = 'low' THEN 'low relevance' WHEN quality = 'unknown' THEN 'unknown source' WHEN confidence < 0.5 THEN 'low confidence' ELSE 'admitted' END AS reason FROM signals)"""


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return signals(spark, sf_dir).withColumn("a", E.admission(c("day"), F.lit(19740), c("verified"), c("stance"), c("kind"), c("relevance"), c("quality"), c("confidence")))


@query("prj19_admission", f"WITH {SIGNALS_SQL}, {ADMITTED_SQL} SELECT event_id, reason = 'admitted' AS allowed, reason FROM admitted")
def prj19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admitted(spark, sf_dir).select("event_id", "a.allowed", "a.reason")


@query(
    "prj21_validation_errors",
    f"""WITH {SIGNALS_SQL} SELECT event_id, array_to_string(list_filter([CASE WHEN NOT coalesce(verified, false) THEN 'verified' END, CASE WHEN NOT coalesce(confidence >= 0.2, false) THEN 'confidence' END, CASE WHEN NOT coalesce(day < 19740, false) THEN 'day' END], lambda x: x IS NOT NULL), ',') AS errors FROM signals""",
)
def prj21(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"verified": F.col("verified"), "confidence": F.col("confidence") >= 0.2, "day": F.col("day") < 19740}
    return signals(spark, sf_dir).select("event_id", F.array_join(E.validation_errors(checks), ",").alias("errors"))


@query(
    "mdl15_evidence_impact",
    f"""WITH {SIGNALS_SQL}, {ADMITTED_SQL},
d AS (SELECT user_id, sum((CASE stance WHEN 'supports' THEN 1 WHEN 'opposes' THEN -1 ELSE 0 END * CASE kind WHEN 'direct_statement' THEN 4.0 WHEN 'fact' THEN 0.65 WHEN 'context' THEN 0.35 ELSE 0.25 END
      * CASE quality WHEN 'official' THEN 1.0 WHEN 'reputable_secondary' THEN 0.8 WHEN 'other' THEN 0.55 ELSE 0.35 END * CASE relevance WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.55 ELSE 0.3 END * 0.85 * coalesce(confidence, 0.5))::DECIMAL(38, 12)) AS delta
      FROM admitted WHERE reason = 'admitted' GROUP BY user_id)
SELECT user_id, round(delta, 6)::DOUBLE AS delta, round(least(0.995, greatest(0.005, 1 / (1 + exp(-(ln(0.4 / 0.6) + delta::DOUBLE))))), 6) AS p FROM d""",
)
def mdl15(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    d = E.logit_delta(c("kind"), c("stance"), c("quality"), c("relevance"), F.lit("recent"), c("confidence"))
    g = admitted(spark, sf_dir).where("a.allowed").groupBy("user_id").agg(F.sum(d.cast("decimal(28,12)")).alias("delta"))  # whole units of 1e-12: any order gives the same sum
    return g.select("user_id", F.round("delta", 6).cast("double").alias("delta"), F.round(E.shifted(F.lit(0.4), c("delta").cast("double")), 6).alias("p"))


@query("src04_money", "SELECT c_custkey, coalesce(try_cast(regexp_replace('$' || printf('%,.2f', c_acctbal), '[$,]', '', 'g') AS DOUBLE), 0) AS amount FROM customer")
def src04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", money(F.concat(F.lit("$"), F.format_string("%,.2f", F.col("c_acctbal")))).alias("amount"))


@query("src22_insert_if_absent", "WITH t AS (SELECT user_id, event_type FROM events WHERE value < 10) SELECT user_id, event_type, min(event_id) AS event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = e.user_id AND t.event_type = e.event_type) GROUP BY ALL")
def src22(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return E.insert_if_absent(e.where("value < 10"), e.select("user_id", "event_type", "event_id"), ["user_id", "event_type"])


@query(
    "src23_upsert",
    """WITH o AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier), n AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(o.k, n.k) AS k, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.k = n.k""",
)
def src23(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    new = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return E.upsert(old, new, ["k"])


@query("src28_bounded_read", "SELECT r_regionkey, r_name FROM region")
def src28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bounded_read(read(spark, sf_dir, "region").select("r_regionkey", "r_name"), 100)


@query("src29_row_generator", "SELECT unnest(range(1995, 2002))::INTEGER AS year")
def src29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1995, 2002).select(F.col("id").cast("int").alias("year"))


@query("udf03_event_fingerprint", "SELECT l_orderkey, sha256(string_agg(l_suppkey || ':' || l_returnflag || ':' || l_partkey || ':' || l_linenumber, ',' ORDER BY l_suppkey, l_returnflag, l_partkey, l_linenumber)) AS fingerprint FROM lineitem GROUP BY l_orderkey")
def udf03(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ("l_suppkey", "l_returnflag", "l_partkey", "l_linenumber")
    rows = F.array_sort(F.collect_list(F.struct(*parts)))
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws(":", *(r[p].cast("string") for p in parts))), ",")
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sha2(text.cast("binary"), 256).alias("fingerprint"))


@query("udf05_votes_asof", "SELECT l_suppkey AS member_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY l_suppkey")
def udf05(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import votes

    return votes(spark, sf_dir).where(F.col("day") < 10227).groupBy("member_id").agg(F.count("*").alias("n"))


@query("join05_superseded_asof", "WITH r AS (SELECT event_id - 1 AS old_id, (ts::DATE - DATE '1970-01-01')::INTEGER AS known FROM events WHERE event_id % 3 = 0) SELECT event_id AS id FROM events WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.old_id = event_id AND known <= 19740)")
def join05_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    r = e.where("event_id % 3 = 0").select((F.col("event_id") - 1).alias("old_id"), day_number("ts").alias("known_on"))
    return not_superseded(e.select(F.col("event_id").alias("id")), r, F.lit(19740))


@query("str06_supersession", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1 AS current FROM events")
def str06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.superseded(read(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "current")


@query("str01_due_schedules", "SELECT s_suppkey, s_nationkey < 20 AND s_suppkey % 6 < 5 AND s_suppkey % 48 <= 24 AS claimed FROM supplier")
def str01(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (k % 48).cast("int"))).alias("next_run"), F.lit(24).alias("cadence_hours"), (k % 6).cast("int").alias("failures"), (F.col("s_nationkey") < 20).alias("enabled"))
    return due(s, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")).select("s_suppkey", "claimed")


@query("str10_rolling_budget", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS used FROM events")
def str10(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)).alias("used"))


@query("str11_freshness", "SELECT event_type, max(ts) AS last_seen, count(*) FILTER (WHERE value > 95) AS failures FROM events GROUP BY event_type".replace("max(ts) AS last_seen", "epoch_us(max(ts)) AS last_seen"))
def str11(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "events").groupBy("event_type")
    return g.agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("last_seen"), F.count_if(F.col("value") > 95).alias("failures"))


@query("str12_latest_status", "SELECT user_id, max_by(event_type, event_id) AS status, max(event_id) AS sequence FROM events GROUP BY user_id")
def str12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max("event_id").alias("sequence"))


@query("str09_missing_days", "WITH d AS (SELECT DISTINCT event_type, (ts::DATE - DATE '1970-01-01')::INTEGER AS day FROM events WHERE value > 150), r AS (SELECT event_type, min(day) AS a, max(day) AS b FROM d GROUP BY event_type), s AS (SELECT event_type, unnest(range(a, b + 1))::INTEGER AS day FROM r) SELECT event_type, day FROM s ANTI JOIN d USING (event_type, day)")
def str09(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "events").where("value > 150").select("event_type", day_number("ts").alias("day")).distinct()
    span = d.groupBy("event_type").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return span.select("event_type", F.explode(F.sequence("a", "b")).alias("day")).join(d, ["event_type", "day"], "left_anti")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, in the order of its files."""
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("str07_stream_dedup", "SELECT DISTINCT user_id * 10 + CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS key FROM events")
def str07(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    e = event_stream(spark, sf_dir).select((F.col("user_id") * 10 + F.when(t == "view", 1).when(t == "click", 2).when(t == "purchase", 3).otherwise(4)).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return run_once(deduplicated(e, "key", "ts", "3650 days"), scratch(spark, "stream")).select("key")


@query(
    "str05_stream_decayed_state",
    f"""WITH {STAGES_SQL}, d AS (SELECT bill_id, day, sum(outcome) AS yes, count(*) AS n, 2 ** ((day - min(min(day)) OVER (PARTITION BY bill_id)) / 30.0) AS k FROM stages GROUP BY bill_id, day),
r AS (SELECT bill_id, day, coalesce(sum(yes * k) OVER w, 0) / k AS yes, coalesce(sum(n * k) OVER w, 0) / k AS total FROM d WINDOW w AS (PARTITION BY bill_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id AS id, round(yes, 6) AS yes, round(total, 6) AS total FROM stages JOIN r USING (bill_id, day)""",
)
def str05(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), day_number("ts").cast("long").alias("day"), (F.col("value") >= 50).cast("long").alias("outcome"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = run_once(decayed_rates(e, 30.0), scratch(spark, "stream"))
    return found.select("id", F.round("yes", 6).alias("yes"), F.round("total", 6).alias("total"))


@query("str04_stage_counts", f"WITH {STAGES_SQL}, d AS (SELECT bill_id, day, sum(outcome) AS yes, count(*) AS n FROM stages GROUP BY ALL), p AS (SELECT bill_id, day, coalesce(sum(yes) OVER w, 0)::BIGINT AS yes, coalesce(sum(n) OVER w, 0)::BIGINT AS n FROM d WINDOW w AS (PARTITION BY bill_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id, n, round(yes / nullif(n, 0), 6) AS rate FROM stages JOIN p USING (bill_id, day)")
def str04(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = strict_prior(stages(spark, sf_dir), ["bill_id"], {"yes": F.col("outcome"), "n": F.lit(1)})
    return c.select("event_id", F.col("n").cast("long").alias("n"), F.round(rate(F.col("yes"), F.col("n")), 6).alias("rate"))
