"""Strictly prior rates, shrinkage, decay and calibration (WIN-06 to WIN-11, MDL-01 to MDL-03, MDL-24)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import decayed_prior, strict_prior
from ..operators.metrics import scorecard
from ..operators.rates import baseline_member_rate, calibrate, calibrator, member_probability, prior_counts, rate
from ..sources.tables import STAGES_SQL, VOTES_SQL, day_number, read, stages, votes
from .registry import query

PRIOR = "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def counts_sql(within: str = "") -> str:
    """votes with strictly prior counts, as prior_counts has them: sums by day first, then of the days before."""

    def one(short: str, *keys: str) -> str:
        keys = tuple(k for k in keys if k)
        part = f"PARTITION BY {', '.join(keys)} " if keys else ""
        return f"""{short}_days AS (
  SELECT {"".join(k + ", " for k in keys)}day, coalesce(sum(sum(outcome)) OVER w, 0)::BIGINT AS {short}_yes, coalesce(sum(count(*)) OVER w, 0)::BIGINT AS {short}_n
  FROM votes GROUP BY {"".join(k + ", " for k in keys)}day WINDOW w AS ({part}ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

    using = lambda *keys: ", ".join(k for k in (*keys, "day") if k)
    return f"""{one("g", within)}, {one("p", within, "party")}, {one("m", within, "member_id")},
counts AS (SELECT * FROM votes JOIN g_days USING ({using(within)}) JOIN p_days USING ({using(within, "party")}) JOIN m_days USING ({using(within, "member_id")}))"""


FORECAST_SQL = f"""{VOTES_SQL}, {counts_sql()},
forecast AS (
  SELECT *, (m_yes + 4 * coalesce(p_yes / nullif(p_n, 0), g_yes / nullif(g_n, 0), 0.5)) / (m_n + 4)::DOUBLE AS p FROM counts)"""

SHRUNK_SQL = """party_p AS (
  SELECT *, CASE WHEN p_n > 0 THEN (p_yes + 12 * coalesce(g_yes / nullif(g_n, 0), 0.5)) / (p_n + 12) ELSE coalesce(g_yes / nullif(g_n, 0), 0.5) END AS pp FROM counts),
shrunk AS (
  SELECT *, CASE WHEN g_n >= 20 OR p_n > 0 OR m_n > 0 THEN
      least(0.995, greatest(0.005, CASE WHEN m_n > 0 THEN (m_yes + 3 * pp) / (m_n + 3) ELSE pp END)) END AS p FROM party_p)"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """votes with the baseline forecast p: what the scores are taken of."""
    return prior_counts(votes(spark, sf_dir)).withColumn("p", baseline_member_rate())


def shrunk_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prior_counts(votes(spark, sf_dir), ("chamber",)).withColumn("p", member_probability())


@query(
    "strict_prior_scorecard",
    f"""WITH {FORECAST_SQL},
b AS (SELECT chamber, session, least(9, floor(p * 10)) AS bin, count(*) AS n, sum(p) AS sp, sum(outcome) AS sy, sum((p - outcome) ** 2) AS sq,
             sum(-(outcome * ln(least(1 - 1e-12, greatest(1e-12, p))) + (1 - outcome) * ln(1 - least(1 - 1e-12, greatest(1e-12, p))))) AS ll,
             sum(CASE WHEN (p >= 0.5)::INT = outcome THEN 1 ELSE 0 END) AS hit FROM forecast GROUP BY ALL)
SELECT chamber, session, sum(n)::BIGINT AS n, round(sum(sy) / sum(n), 6) AS positive_rate, round(sum(sq) / sum(n), 6) AS brier, round(sum(ll) / sum(n), 6) AS log_loss,
       round(sum(hit) / sum(n), 6) AS accuracy, round(sum(abs(sp - sy)) / sum(n), 6) AS ece FROM b GROUP BY chamber, session""",
)
def strict_prior_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = scorecard(forecasts(spark, sf_dir), ["chamber", "session"])
    return card.select("chamber", "session", "n", *(F.round(c, 6).alias(c) for c in ("positive_rate", "brier", "log_loss", "accuracy", "ece")))


@query(
    "win06_strict_prior_rates",
    f"""WITH {VOTES_SQL}, {counts_sql()}
SELECT observation_id, g_n, p_n, m_n, round(g_yes / nullif(g_n, 0), 6) AS global_rate, round(p_yes / nullif(p_n, 0), 6) AS party_rate, round(m_yes / nullif(m_n, 0), 6) AS member_rate FROM counts""",
)
def win06(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = prior_counts(votes(spark, sf_dir))
    rates = {"global_rate": "g", "party_rate": "p", "member_rate": "m"}
    return c.select("observation_id", *(F.col(f"{s}_n").cast("long").alias(f"{s}_n") for s in rates.values()), *(F.round(rate(F.col(f"{s}_yes"), F.col(f"{s}_n")), 6).alias(n) for n, s in rates.items()))


@query(
    "win07_stage_base_rate",
    f"""WITH {STAGES_SQL}
SELECT event_id, stage, round(coalesce(sum(outcome) OVER w / nullif(count(*) OVER w, 0), 0.5), 6) AS p FROM stages WINDOW w AS (PARTITION BY stage ORDER BY day {PRIOR})""",
)
def win07(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = strict_prior(stages(spark, sf_dir), ["stage"], {"yes": F.col("outcome"), "n": F.lit(1)})
    return c.select("event_id", "stage", F.round(F.coalesce(rate(F.col("yes"), F.col("n")), F.lit(0.5)), 6).alias("p"))


@query("win08_chamber_isolated_eb", f"WITH {VOTES_SQL}, {counts_sql('chamber')}, {SHRUNK_SQL} SELECT observation_id, chamber, round(p, 6) AS p FROM shrunk")
def win08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shrunk_forecasts(spark, sf_dir).select("observation_id", "chamber", F.round("p", 6).alias("p"))


@query(
    "win09_decayed_rates",
    f"""WITH {VOTES_SQL},
w AS (SELECT *, 2 ** ((day - min(day) OVER (PARTITION BY member_id)) / 180.0) AS k FROM votes)
SELECT observation_id, round(coalesce(sum(outcome * k) OVER x / k, 0), 6) AS m_yes, round(coalesce(sum(k) OVER x / k, 0), 6) AS m_n
FROM w WINDOW x AS (PARTITION BY member_id ORDER BY day {PRIOR})""",
)
def win09(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = decayed_prior(votes(spark, sf_dir), ["member_id"], {"m_yes": F.col("outcome"), "m_n": F.lit(1)}, 180.0)
    return c.select("observation_id", F.round("m_yes", 6).alias("m_yes"), F.round("m_n", 6).alias("m_n"))


CAPS = (5.0, 10.0, 20.0, 40.0, 80.0, float("inf"))


@query(
    "win10_history_cap_grid",
    f"""WITH {VOTES_SQL}, {counts_sql("chamber")},
party_p AS (SELECT *, CASE WHEN p_n > 0 THEN (p_yes + 12 * coalesce(g_yes / nullif(g_n, 0), 0.5)) / (p_n + 12) ELSE coalesce(g_yes / nullif(g_n, 0), 0.5) END AS pp FROM counts),
grid AS (SELECT unnest([5.0, 10.0, 20.0, 40.0, 80.0, 'inf'::DOUBLE])::DOUBLE AS cap),
f AS (SELECT cap, chamber, outcome, CASE WHEN g_n >= 20 OR p_n > 0 OR m_n > 0 THEN least(0.995, greatest(0.005,
        CASE WHEN m_n > 0 THEN (m_yes / m_n * least(m_n, cap) + 3 * pp) / (least(m_n, cap) + 3) ELSE pp END)) END AS p FROM party_p, grid)
SELECT CASE WHEN isinf(cap) THEN 'none' ELSE cap::INT::VARCHAR END AS cap, chamber, count(p) AS n, round(avg((p - outcome) ** 2), 6) AS brier FROM f GROUP BY ALL""",
)
def win10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = prior_counts(votes(spark, sf_dir), ("chamber",))
    grid = c.select("*", F.explode(F.array(*map(F.lit, CAPS))).alias("limit")).withColumn("p", member_probability(F.col("limit")))
    named = F.when(F.col("limit") == float("inf"), "none").otherwise(F.col("limit").cast("int").cast("string"))
    return grid.groupBy(named.alias("cap"), "chamber").agg(F.count("p").alias("n"), F.round(F.avg(F.pow(F.col("p") - F.col("outcome"), 2)), 6).alias("brier"))


@query(
    "win11_prefix_timeline",
    """WITH d AS (SELECT s_suppkey AS member_id, c_mktsegment AS kind, (o_orderdate::DATE - DATE '1970-01-01')::INTEGER AS day, count(*) AS n, sum(greatest(0, l_extendedprice)) AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT member_id, kind, day, sum(n) OVER w::BIGINT AS total_n, round(sum(amount) OVER w, 2) AS total_amount FROM d WINDOW w AS (PARTITION BY member_id, kind ORDER BY day)""".replace("sum(n) OVER w::BIGINT", "(sum(n) OVER w)::BIGINT"),
)
def win11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    lines, orders, customers = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    met = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    d = met.groupBy(F.col("l_suppkey").alias("member_id"), F.col("c_mktsegment").alias("kind"), day_number("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(0.0), F.col("l_extendedprice"))).alias("amount"))
    w = Window.partitionBy("member_id", "kind").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("member_id", "kind", "day", F.sum("n").over(w).alias("total_n"), F.round(F.sum("amount").over(w), 2).alias("total_amount"))


@query("mdl01_member_baseline", f"WITH {FORECAST_SQL} SELECT observation_id, round(p, 6) AS p FROM forecast")
def mdl01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(spark, sf_dir).select("observation_id", F.round("p", 6).alias("p"))


@query(
    "mdl02_analogue_blend",
    f"""WITH {VOTES_SQL}, {counts_sql("chamber")}, {SHRUNK_SQL.replace("OR m_n > 0 THEN", "OR m_n > 0 OR weight > 0 THEN").replace("CASE WHEN m_n > 0 THEN (m_yes + 3 * pp) / (m_n + 3) ELSE pp END",
    "CASE WHEN weight > 0 THEN ((3 + m_n) * CASE WHEN m_n > 0 THEN (m_yes + 3 * pp) / (m_n + 3) ELSE pp END + least(8, weight * 100) * (1 - weight)) / (3 + m_n + least(8, weight * 100)) ELSE CASE WHEN m_n > 0 THEN (m_yes + 3 * pp) / (m_n + 3) ELSE pp END END")}
SELECT observation_id, round(p, 6) AS p FROM shrunk""",
)
def mdl02(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = prior_counts(votes(spark, sf_dir), ("chamber",))
    return c.select("observation_id", F.round(member_probability(analogue=(1 - F.col("weight"), F.col("weight") * 100)), 6).alias("p"))


@query(
    "mdl03_calibrated",
    f"""WITH {FORECAST_SQL},
f AS (SELECT least(9, floor(p * 10))::INT AS bin, count(*) AS n, avg(p) AS mean_p, sum(outcome) AS yes FROM forecast GROUP BY 1 HAVING count(*) >= 25),
c AS (SELECT bin, (yes + 4 * mean_p) / (n + 4) AS c FROM f)
SELECT observation_id, round(p, 6) AS p, round(coalesce(least(0.995, greatest(0.005, c)), p), 6) AS calibrated FROM forecast LEFT JOIN c ON least(9, floor(p * 10))::INT = bin""",
)
def mdl03(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir)
    return calibrate(f, calibrator(f)).select("observation_id", F.round("p", 6).alias("p"), F.round("calibrated", 6).alias("calibrated"))


@query(
    "mdl24_decayed_party_rates",
    f"""WITH {VOTES_SQL},
d AS (SELECT chamber, party, day, sum(outcome) AS yes, count(*) AS n, 2 ** ((day - min(min(day)) OVER (PARTITION BY chamber, party)) / 730.0) AS k FROM votes GROUP BY chamber, party, day),
r AS (SELECT chamber, party, day, sum(yes * k) OVER x / nullif(sum(n * k) OVER x, 0) AS rate FROM d WINDOW x AS (PARTITION BY chamber, party ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT observation_id, round(coalesce(rate, 0.5), 6) AS rate FROM votes JOIN r USING (chamber, party, day)""",
)
def mdl24(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = decayed_prior(votes(spark, sf_dir), ["chamber", "party"], {"yes": F.col("outcome"), "n": F.lit(1)}, 730.0)
    return c.select("observation_id", F.round(F.coalesce(rate(F.col("yes"), F.col("n")), F.lit(0.5)), 6).alias("rate"))
