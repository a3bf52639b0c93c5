"""Scores of forecasts (SCO), group totals and slices (AGG-12 to AGG-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.distribution import count_pmf
from ..operators.metrics import accuracy, brier, calibration_bins, log_loss, ranked_probability_score, ranking
from ..sources.tables import VOTES_SQL, written
from .rates import FORECAST_SQL, SHRUNK_SQL, counts_sql, forecasts, shrunk_forecasts
from .registry import query

TWO_SQL = f"""{VOTES_SQL}, {counts_sql("chamber")}, {SHRUNK_SQL},
two AS (SELECT *, (m_yes + 4 * coalesce(p_yes / nullif(p_n, 0), g_yes / nullif(g_n, 0), 0.5)) / (m_n + 4)::DOUBLE AS q FROM shrunk)"""


def two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p: the shrunk model; q: the baseline on the same history."""
    from ..operators.rates import baseline_member_rate

    return shrunk_forecasts(spark, sf_dir).withColumn("q", baseline_member_rate())


def rounded(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.select(*keys, *(F.round(n, 6).alias(n) for n in names))


@query(
    "sco01_brier_log_loss_accuracy",
    f"""WITH {FORECAST_SQL}
SELECT party, round(avg((p - outcome) ** 2), 6) AS brier,
       round(avg(-(outcome * ln(least(1 - 1e-12, greatest(1e-12, p))) + (1 - outcome) * ln(1 - least(1 - 1e-12, greatest(1e-12, p))))), 6) AS log_loss,
       round(avg(CASE WHEN (p >= 0.5)::INT = outcome THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM forecast GROUP BY party""",
)
def sco01(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y = F.col("p"), F.col("outcome")
    return rounded(forecasts(spark, sf_dir).groupBy("party").agg(brier(p, y).alias("brier"), log_loss(p, y).alias("log_loss"), accuracy(p, y).alias("accuracy")), ["party"], ["brier", "log_loss", "accuracy"])


@query("sco04_calibration_bins", f"WITH {FORECAST_SQL} SELECT chamber, least(9, floor(p * 10))::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(outcome), 6) AS observed FROM forecast GROUP BY ALL")
def sco04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration_bins(forecasts(spark, sf_dir), ["chamber"]), ["chamber", "bin", "n"], ["mean_p", "observed"])


RANK_SQL = f"""WITH {FORECAST_SQL},
t AS (SELECT session, p, sum(outcome) AS pos, sum(1 - outcome) AS neg FROM forecast GROUP BY session, p),
c AS (SELECT *, sum(pos) OVER d AS tp, sum(pos + neg) OVER d AS seen, coalesce(sum(neg) OVER u, 0) AS below FROM t
  WINDOW d AS (PARTITION BY session ORDER BY p DESC ROWS UNBOUNDED PRECEDING), u AS (PARTITION BY session ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("sco06_average_precision", RANK_SQL + " SELECT session, round(sum(pos * tp / seen) / nullif(sum(pos), 0), 6) AS average_precision FROM c GROUP BY session")
def sco06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking(forecasts(spark, sf_dir), ["session"]), ["session"], ["average_precision"])


@query("sco07_roc_auc", RANK_SQL + " SELECT session, round(sum(pos * below + 0.5 * pos * neg) / nullif(sum(pos) * sum(neg), 0), 6) AS roc_auc FROM c GROUP BY session")
def sco07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking(forecasts(spark, sf_dir), ["session"]), ["session"], ["roc_auc"])


PMF_SQL = """m AS (SELECT event_id, p, row_number() OVER (PARTITION BY event_id ORDER BY p) AS i, count(*) OVER (PARTITION BY event_id) AS n FROM forecast),
r AS (
  SELECT event_id, 0::BIGINT AS i, [1.0::DOUBLE] AS pmf FROM m GROUP BY event_id
  UNION ALL
  SELECT r.event_id, m.i, list_transform(range(0, len(r.pmf) + 1), lambda k: coalesce(r.pmf[(k + 1)::INT], 0) * (1 - m.p) + CASE WHEN k > 0 THEN r.pmf[k::INT] ELSE 0 END * m.p)
  FROM r JOIN m ON r.event_id = m.event_id AND m.i = r.i + 1),
pmf AS (SELECT r.event_id, r.pmf, r.i AS n FROM r JOIN (SELECT event_id, max(i) AS n FROM m GROUP BY event_id) x ON r.event_id = x.event_id AND r.i = x.n)"""


@query(
    "sco08_ranked_probability_score",
    f"""WITH RECURSIVE {FORECAST_SQL}, {PMF_SQL},
a AS (SELECT event_id, sum(outcome) AS actual FROM forecast GROUP BY event_id)
SELECT pmf.event_id, round(list_sum(list_transform(range(0, n), lambda k: (list_sum(pmf[1:(k + 1)::INT]) - CASE WHEN actual <= k THEN 1 ELSE 0 END) ** 2)) / n, 6) AS rps
FROM pmf JOIN a USING (event_id)""",
)
def sco08(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = forecasts(spark, sf_dir).groupBy("event_id").agg(F.collect_list("p").alias("chances"), F.sum("outcome").alias("actual"))
    return groups.withColumn("pmf", count_pmf(F.col("chances"))).select("event_id", F.round(ranked_probability_score(F.col("pmf"), F.col("actual")), 6).alias("rps"))


@query(
    "sco09_stage_scorecard",
    f"""WITH {FORECAST_SQL},
s AS (SELECT chamber, count(*) AS n, avg((p - outcome) ** 2) AS b, avg((1 - outcome) ** 2) AS yes, avg(outcome ** 2) AS no FROM forecast GROUP BY chamber)
SELECT chamber, n, round(b, 6) AS brier, round(yes, 6) AS always_yes, round(1 - b / nullif(yes, 0), 6) AS skill_yes, round(no, 6) AS always_no, round(1 - b / nullif(no, 0), 6) AS skill_no FROM s""",
)
def sco09(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y = F.col("p"), F.col("outcome")
    s = forecasts(spark, sf_dir).groupBy("chamber").agg(F.count("*").alias("n"), brier(p, y).alias("brier"), F.avg(F.pow(1 - y, 2)).alias("always_yes"), F.avg(F.pow(y, 2)).alias("always_no"))
    skill = lambda base: 1 - F.col("brier") / F.nullif(F.col(base), F.lit(0.0))
    return rounded(s.withColumn("skill_yes", skill("always_yes")).withColumn("skill_no", skill("always_no")), ["chamber", "n"], ["brier", "always_yes", "skill_yes", "always_no", "skill_no"])


@query(
    "sco10_close_events",
    f"""WITH {FORECAST_SQL},
e AS (SELECT event_id, count(*) AS n, sum(outcome) AS yes, sum(p) AS ey FROM forecast GROUP BY event_id),
m AS (SELECT *, abs(2 * yes - n) AS margin FROM e), k AS (SELECT unnest([1, 2, 4]) AS most)
SELECT most::INT AS most, count(*) AS events, round(avg(abs(ey - yes)), 6) AS mae, round(avg(CASE WHEN (ey > n / 2) = (yes > n / 2) THEN 1.0 ELSE 0.0 END), 6) AS right_side FROM m JOIN k ON margin <= most GROUP BY most""",
)
def sco10(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = forecasts(spark, sf_dir).groupBy("event_id").agg(F.count("*").alias("n"), F.sum("outcome").alias("yes"), F.sum("p").alias("ey"))
    e = e.withColumn("most", F.explode(F.filter(F.array(F.lit(1), F.lit(2), F.lit(4)), lambda k: F.abs(2 * F.col("yes") - F.col("n")) <= k)))
    side = F.when((F.col("ey") > F.col("n") / 2) == (F.col("yes") > F.col("n") / 2), 1.0).otherwise(0.0)
    return rounded(e.groupBy("most").agg(F.count("*").alias("events"), F.avg(F.abs(F.col("ey") - F.col("yes"))).alias("mae"), F.avg(side).alias("right_side")), ["most", "events"], ["mae", "right_side"])


@query(
    "sco12_paired_movement",
    f"""WITH {TWO_SQL}
SELECT chamber, count(*) AS n, count(*) FILTER (WHERE abs(p - q) > 1e-12) AS changed, count(*) FILTER (WHERE abs(p - outcome) < abs(q - outcome) - 1e-12) AS improved,
       count(*) FILTER (WHERE abs(p - outcome) > abs(q - outcome) + 1e-12) AS worsened, round(avg((p - outcome) ** 2) - avg((q - outcome) ** 2), 6) AS brier_delta
FROM two WHERE p IS NOT NULL GROUP BY chamber""",
)
def sco12(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q, y = F.col("p"), F.col("q"), F.col("outcome")
    own, other = F.abs(p - y), F.abs(q - y)
    g = two_models(spark, sf_dir).where("p IS NOT NULL").groupBy("chamber")
    return g.agg(F.count("*").alias("n"), F.count_if(F.abs(p - q) > 1e-12).alias("changed"), F.count_if(own < other - 1e-12).alias("improved"), F.count_if(own > other + 1e-12).alias("worsened"), F.round(brier(p, y) - brier(q, y), 6).alias("brier_delta"))


@query(
    "sco13_prior_outcome_join",
    """WITH r AS (SELECT event_id, user_id AS bill_id, ts, least(1, greatest(0, value / 100)) AS p FROM events WHERE event_type = 'view'),
o AS (SELECT user_id AS bill_id, min(ts) AS ts FROM events WHERE event_type = 'purchase' GROUP BY user_id),
l AS (SELECT r.bill_id, max_by(r.p, (r.ts, r.event_id)) AS p FROM r JOIN o USING (bill_id) WHERE r.ts < o.ts GROUP BY r.bill_id)
SELECT count(*) AS n, round(avg((p - 1) ** 2), 6) AS brier FROM l""",
)
def sco13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import read

    e = read(spark, sf_dir, "events")
    r = e.where("event_type = 'view'").select("event_id", F.col("user_id").alias("bill_id"), "ts", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)).alias("p"))
    o = e.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("bill_id")).agg(F.min("ts").alias("known"))
    last = r.join(o, "bill_id").where("ts < known").groupBy("bill_id").agg(F.max_by("p", F.struct("ts", "event_id")).alias("p"))
    return last.agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("p") - 1, 2)), 6).alias("brier"))


@query(
    "sco15_signal_difference",
    f"""WITH {FORECAST_SQL},
s AS (SELECT chamber, avg(weight) FILTER (WHERE outcome = 1) AS a, avg(weight) FILTER (WHERE outcome = 0) AS b, var_samp(weight) FILTER (WHERE outcome = 1) AS va, var_samp(weight) FILTER (WHERE outcome = 0) AS vb FROM forecast GROUP BY chamber)
SELECT chamber, round((a - b) / sqrt((va + vb) / 2), 6) AS smd FROM s""",
)
def sco15(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k: F.when(F.col("outcome") == k, F.col("weight"))
    g = forecasts(spark, sf_dir).groupBy("chamber").agg(F.avg(of(1)).alias("a"), F.avg(of(0)).alias("b"), F.var_samp(of(1)).alias("va"), F.var_samp(of(0)).alias("vb"))
    return g.select("chamber", F.round((F.col("a") - F.col("b")) / F.sqrt((F.col("va") + F.col("vb")) / 2), 6).alias("smd"))


@query(
    "sco16_candidate_gate",
    f"""WITH {TWO_SQL},
s AS (SELECT session, count(*) AS n, avg((p - outcome) ** 2) - avg((q - outcome) ** 2) AS d FROM two WHERE p IS NOT NULL GROUP BY session)
SELECT session, n, round(d, 6) AS brier_delta, n >= 100 AND d <= -0.0005 AS qualifies FROM s""",
)
def sco16(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q, y = F.col("p"), F.col("q"), F.col("outcome")
    s = two_models(spark, sf_dir).where("p IS NOT NULL").groupBy("session").agg(F.count("*").alias("n"), (brier(p, y) - brier(q, y)).alias("d"))
    return s.select("session", "n", F.round("d", 6).alias("brier_delta"), ((F.col("n") >= 100) & (F.col("d") <= -0.0005)).alias("qualifies"))


@query(
    "sco17_drift",
    f"""WITH {FORECAST_SQL},
s AS (SELECT chamber, session, count(*) AS n, avg((p - outcome) ** 2) AS b FROM forecast GROUP BY ALL),
w AS (SELECT a.chamber, b.session, b.n, b.b - a.b AS d, (b.b - a.b) / nullif(a.b, 0) AS r FROM s a JOIN s b ON a.chamber = b.chamber AND b.session = a.session + 1)
SELECT chamber, session, n, round(d, 6) AS absolute, round(r, 6) AS relative, n >= 30 AND d >= 0.02 AND r >= 0.2 AS drifted FROM w""",
)
def sco17(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = forecasts(spark, sf_dir).groupBy("chamber", "session").agg(F.count("*").alias("n"), brier(F.col("p"), F.col("outcome")).alias("b"))
    before = s.select("chamber", (F.col("session") + 1).alias("session"), F.col("b").alias("a"))
    w = s.join(before, ["chamber", "session"]).withColumn("d", F.col("b") - F.col("a")).withColumn("r", F.col("d") / F.nullif(F.col("a"), F.lit(0.0)))
    return w.select("chamber", "session", "n", F.round("d", 6).alias("absolute"), F.round("r", 6).alias("relative"), ((F.col("n") >= 30) & (F.col("d") >= 0.02) & (F.col("r") >= 0.2)).alias("drifted"))


@query(
    "sco18_equivalence",
    f"WITH {TWO_SQL} SELECT chamber, count(*) AS n, count(*) FILTER (WHERE abs(p - q) > 0.01) AS differing, round(max(abs(p - q)), 6) AS largest FROM two WHERE p IS NOT NULL GROUP BY chamber",
)
def sco18(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.abs(F.col("p") - F.col("q"))
    return two_models(spark, sf_dir).where("p IS NOT NULL").groupBy("chamber").agg(F.count("*").alias("n"), F.count_if(d > 0.01).alias("differing"), F.round(F.max(d), 6).alias("largest"))


@query(
    "sco20_selection_recall",
    f"""WITH {FORECAST_SQL},
r AS (SELECT *, row_number() OVER (ORDER BY abs(p - 0.5), observation_id) AS k, count(*) OVER () AS n, ((p >= 0.5)::INT <> outcome)::INT AS wrong FROM forecast)
SELECT round(sum(wrong) FILTER (WHERE 5 * k <= n) / sum(wrong), 6) AS error_share, round(sum((p - outcome) ** 2) FILTER (WHERE 5 * k <= n) / sum((p - outcome) ** 2), 6) AS brier_share, round(count(*) FILTER (WHERE 5 * k <= n) / count(*), 6) AS uniform_share FROM r""",
)
def sco20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifth of the forecasts nearest to one half, by an exact cut."""
    f = forecasts(spark, sf_dir).select("observation_id", F.abs(F.col("p") - 0.5).alias("d"), F.pow(F.col("p") - F.col("outcome"), 2).alias("sq"), ((F.col("p") >= 0.5).cast("int") != F.col("outcome")).cast("int").alias("wrong"))
    f = written(f)
    whole = f.agg(F.count("*").alias("n"), F.sum("wrong").alias("wrong"), F.sum("sq").alias("sq"))
    taken = nearest(f, "d", "observation_id", f.count() // 5).agg(F.count("*").alias("own_n"), F.sum("wrong").alias("own_wrong"), F.sum("sq").alias("own_sq"))
    share = lambda x: F.round(F.col(f"own_{x}") / F.col(x), 6)
    return whole.crossJoin(taken).select(share("wrong").alias("error_share"), share("sq").alias("brier_share"), share("n").alias("uniform_share"))


def nearest(rows: DataFrame, distance: str, tie: str, n: int, steps: int = 4096) -> DataFrame:
    """The n rows of the least distance (0 to 1), ties by tie.

    Counts by step of the distance, steps at most, find the step of the cut, and counts by distance within it the distance; only rows at that very distance are ordered by tie.
    """

    def cut(counts: DataFrame, by: str, most: int) -> tuple:
        upto = F.sum("n").over(Window.orderBy(by))
        found = counts.withColumn("before", upto - F.col("n")).where((F.col("before") < most) & (F.col("before") + F.col("n") >= most)).first()
        return (found[by], found["before"]) if found else (None, 0)

    stepped = rows.withColumn("_step", F.floor(F.col(distance) * steps))
    step, before = cut(stepped.groupBy("_step").agg(F.count("*").alias("n")), "_step", n)
    at, inside = cut(stepped.where(F.col("_step") == F.lit(step)).groupBy(distance).agg(F.count("*").alias("n")), distance, n - before) if step is not None else (None, 0)
    if at is None:
        return rows.where("false") if n < 1 else rows
    return rows.where(F.col(distance) < at).unionByName(rows.where(F.col(distance) == at).orderBy(tie).limit(n - before - inside))


@query(
    "agg12_slice_scorecards",
    f"WITH {FORECAST_SQL} SELECT coalesce(chamber, 'all') AS chamber, coalesce(session::VARCHAR, 'all') AS session, count(*) AS n, round(avg((p - outcome) ** 2), 6) AS brier FROM forecast GROUP BY GROUPING SETS ((chamber), (session), (chamber, session), ())",
)
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = forecasts(spark, sf_dir).cube("chamber", "session").agg(F.count("*").alias("n"), F.round(brier(F.col("p"), F.col("outcome")), 6).alias("brier"))
    return sets.select(F.coalesce("chamber", F.lit("all")).alias("chamber"), F.coalesce(F.col("session").cast("string"), F.lit("all")).alias("session"), "n", "brier")


@query(
    "agg13_chamber_totals",
    f"""WITH {FORECAST_SQL}, e AS (SELECT chamber, event_id, sum(p) AS ey, sum(outcome) AS yes FROM forecast GROUP BY ALL)
SELECT chamber, count(*) AS events, round(sum(ey), 4) AS expected, sum(yes)::BIGINT AS actual, round(avg(abs(ey - yes)), 6) AS mae FROM e GROUP BY chamber""",
)
def agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = forecasts(spark, sf_dir).groupBy("chamber", "event_id").agg(F.sum("p").alias("ey"), F.sum("outcome").alias("yes"))
    return e.groupBy("chamber").agg(F.count("*").alias("events"), F.round(F.sum("ey"), 4).alias("expected"), F.sum("yes").alias("actual"), F.round(F.avg(F.abs(F.col("ey") - F.col("yes"))), 6).alias("mae"))


@query(
    "agg14_complete_groups",
    f"""WITH {VOTES_SQL}, {counts_sql("chamber")}, {SHRUNK_SQL}
SELECT chamber, event_id, count(*) AS n, round(sum(p), 6) AS expected FROM shrunk GROUP BY chamber, event_id HAVING count(p) = count(*)""",
)
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = shrunk_forecasts(spark, sf_dir).groupBy("chamber", "event_id").agg(F.count("*").alias("n"), F.count("p").alias("known"), F.round(F.sum("p"), 6).alias("expected"))
    return g.where("known = n").drop("known")


@query(
    "agg15_weighted_mean",
    f"""WITH {FORECAST_SQL}, r AS (SELECT chamber, event_id, count(*) AS n, avg((p - outcome) ** 2) AS m FROM forecast GROUP BY ALL)
SELECT chamber, sum(n)::BIGINT AS members, round(sum(m * n) / sum(n), 6) AS brier FROM r GROUP BY chamber""",
)
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = forecasts(spark, sf_dir).groupBy("chamber", "event_id").agg(F.count("*").alias("n"), brier(F.col("p"), F.col("outcome")).alias("m"))
    return r.groupBy("chamber").agg(F.sum("n").alias("members"), F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("brier"))
