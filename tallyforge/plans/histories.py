"""Histories and ledgers in full (AGG-18, JOIN-21, JOIN-25, SRC-23, WIN-18, MDL-13, MDL-20, SCO-14, SCO-15, STR-01 to STR-03, FN-19, FN-33, PRJ-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import policy as B
from ..functions.numeric import entropy_bits, logistic, logit
from ..operators.asof import rejoin, strict_prior_days
from ..operators.distribution import chamber
from ..operators.evidence import insert_if_absent, upsert
from ..operators.learners import coordinate_ridge, standardized
from ..operators.metrics import ranking
from ..sources.tables import STAGES_SQL, day_number, read, stages, written
from .parsers import resolved_authors
from .rates import FORECAST_SQL, forecasts
from .registry import query
from .scoring import PMF_SQL

DAY_SQL = "(ts::DATE - DATE '1970-01-01')::INTEGER"


@query(
    "agg18_signal_features",
    f"""WITH e AS (SELECT user_id, event_id, event_type, value, {DAY_SQL} AS day, user_id || ':' || event_type || ':' || floor(value / 10)::INTEGER AS fingerprint FROM events),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, fingerprint ORDER BY day, event_id) AS k FROM e WHERE day < 19740) WHERE k = 1)
SELECT user_id, 1 AS any_signal, count(*) FILTER (WHERE value >= 60) AS supports, count(*) FILTER (WHERE value <= 40) AS opposes, count(*) FILTER (WHERE value > 40 AND value < 60) AS mixed,
  count(*) FILTER (WHERE event_type = 'purchase' AND value >= 60) AS quoted_support, count(*) FILTER (WHERE event_type = 'purchase' AND value <= 40) AS quoted_oppose, count(*) FILTER (WHERE event_type <> 'view' AND value >= 60) AS explicit_support,
  count(*) FILTER (WHERE event_type <> 'view' AND value <= 40) AS explicit_oppose, round(coalesce(max(value) FILTER (WHERE value >= 60), 0), 6) AS support_confidence, round(coalesce(max(value) FILTER (WHERE value <= 40), 0), 6) AS oppose_confidence,
  round(coalesce(max(value) FILTER (WHERE value > 40 AND value < 60), 0), 6) AS mixed_confidence, (count(*) FILTER (WHERE value >= 60) > 0 AND count(*) FILTER (WHERE value <= 40) > 0)::INTEGER AS both_sides FROM f GROUP BY user_id""",
)
def agg18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve features of a member's signals before a cutoff, each signal once, as first known."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", day_number("ts").alias("day")).where("day < 19740")
    fingerprint = F.concat_ws(":", "user_id", "event_type", F.floor(F.col("value") / 10))
    first = e.withColumn("fingerprint", fingerprint).groupBy("user_id", "fingerprint").agg(F.min(F.struct("day", "event_id", "event_type", "value")).alias("s")).select("user_id", "s.event_type", "s.value")
    v, t = F.col("value"), F.col("event_type")
    sides = {"support": v >= 60, "oppose": v <= 40, "mixed": (v > 40) & (v < 60)}
    n = F.count_if
    best = lambda side: F.round(F.coalesce(F.max(F.when(sides[side], v)), F.lit(0.0)), 6)
    return first.groupBy("user_id").agg(
        F.lit(1).alias("any_signal"), n(sides["support"]).alias("supports"), n(sides["oppose"]).alias("opposes"), n(sides["mixed"]).alias("mixed"), n((t == "purchase") & sides["support"]).alias("quoted_support"), n((t == "purchase") & sides["oppose"]).alias("quoted_oppose"),
        n((t != "view") & sides["support"]).alias("explicit_support"), n((t != "view") & sides["oppose"]).alias("explicit_oppose"), best("support").alias("support_confidence"), best("oppose").alias("oppose_confidence"), best("mixed").alias("mixed_confidence"),
        ((n(sides["support"]) > 0) & (n(sides["oppose"]) > 0)).cast("int").alias("both_sides"),
    )


@query(
    "join21_member_ladder",
    """WITH r AS (SELECT s_suppkey AS member, s_suppkey // 2 AS surname, s_suppkey % 5 AS first FROM supplier),
c AS (SELECT c.c_custkey, count(r.member) AS n, count(r.member) FILTER (WHERE r.first = c.c_custkey % 5) AS k, max(r.member) FILTER (WHERE r.first = c.c_custkey % 5) AS own, max(r.member) AS one FROM customer c LEFT JOIN r ON r.surname = c.c_custkey // 3 GROUP BY c.c_custkey)
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN CASE WHEN n = 1 THEN one END WHEN k = 1 THEN own END AS member,
  CASE WHEN c_custkey % 3 = 2 THEN CASE WHEN n = 1 THEN 'unique_surname' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END WHEN k = 1 THEN CASE WHEN c_custkey % 3 = 0 THEN 'exact' ELSE 'surname_initials' END ELSE 'unmatched' END AS rung FROM c""",
)
def join21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by whole name, then surname and initial, then an only surname; else ambiguous or unmatched."""
    given = lambda k: F.element_at(F.array(*map(F.lit, ("anna", "bert", "carl", "dora", "emil"))), (k % 5 + 1).cast("int"))
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    roster = read(spark, sf_dir, "supplier").select(s.alias("member"), F.concat(given(s), F.lit(" Sur"), F.floor(s / 2)).alias("name"))
    name = F.concat(F.when(c % 3 == 0, F.concat(given(c), F.lit(" "))).when(c % 3 == 1, F.concat(F.left(given(c), F.lit(1)), F.lit(". "))).otherwise(""), F.lit("Sur"), F.floor(c / 3))
    found = resolved_authors(read(spark, sf_dir, "customer").select(c.alias("id"), name.alias("name")), roster)
    return found.select("id", "member", F.when(F.col("status") == "resolved", F.col("method")).when(F.col("status") == "ambiguous", "ambiguous").otherwise("unmatched").alias("rung"))


@query("join25_duplicate_claims", "WITH e AS (SELECT event_id, user_id, event_type || ' ' || floor(value / 25)::INTEGER AS claim FROM events), d AS (SELECT *, min(event_id) OVER (PARTITION BY user_id, claim) AS first_id FROM e) SELECT event_id, first_id FROM d WHERE event_id <> first_id")
def join25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of a claim about one member, each with the first that makes it: a class and its members, not all pairs."""
    i = F.col("event_id")
    raw = F.concat(F.when(i % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.when(i % 3 == 0, " -- ").otherwise("  "), F.floor(F.col("value") / 25), F.when(i % 5 == 0, "!").otherwise(""))
    claim = F.trim(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", " "))
    e = read(spark, sf_dir, "events").select("event_id", "user_id", claim.alias("claim"))
    first = e.groupBy("user_id", "claim").agg(F.min("event_id").alias("first_id"))
    return e.join(first, ["user_id", "claim"]).where("event_id <> first_id").select("event_id", "first_id")


@query(
    "src23_merged_metadata",
    """WITH o AS (SELECT s_suppkey AS k, s_name AS name, s_nationkey::VARCHAR AS a, 'old' AS b, NULL AS c FROM supplier), n AS (SELECT c_custkey AS k, c_name AS name, 'new' AS b, c_nationkey::VARCHAR AS c FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(o.k, n.k) AS k, coalesce(n.name, o.name) AS name, o.a AS a, coalesce(n.b, o.b) AS b, n.c AS c FROM o FULL JOIN n ON o.k = n.k""",
)
def src23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows put in by key whose JSON metadata is united with what is there, the newer entry winning."""
    as_map = lambda j: F.from_json(j, "map<string,string>")
    old = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), as_map(F.to_json(F.struct(F.col("s_nationkey").cast("string").alias("a"), F.lit("old").alias("b")))).alias("metadata"))
    new = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), as_map(F.to_json(F.struct(F.lit("new").alias("b"), F.col("c_nationkey").cast("string").alias("c")))).alias("metadata"))
    return upsert(old, new, ["k"], merged="metadata").select("k", "name", *(F.col("metadata")[x].alias(x) for x in "abc"))


@query(
    "win18_chained_hazards",
    f"""WITH {STAGES_SQL}, s AS (SELECT *, day // 7 AS session FROM stages), d AS (SELECT stage, session, sum(outcome) AS yes, count(*) AS n FROM s GROUP BY ALL), g AS (SELECT session, sum(yes) AS yes, sum(n) AS n FROM d GROUP BY session),
p AS (SELECT stage, session, coalesce(sum(yes) OVER w, 0) AS yes, coalesce(sum(n) OVER w, 0) AS n FROM d WINDOW w AS (PARTITION BY stage ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT session, sum(yes) OVER w AS gy, sum(n) OVER w AS gn FROM g WINDOW w AS (ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT stage, session, n::BIGINT AS at_risk, round((yes + 20 * coalesce(gy / gn, 0.5)) / (n + 20), 6) AS hazard FROM p JOIN q USING (session)""",
)
def win18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's hazard in each session by the sessions before, shrunk towards that of all stages."""
    s = stages(spark, sf_dir).withColumn("session", F.floor(F.col("day") / 7).cast("int"))
    own = strict_prior_days(s, ["stage"], {"yes": F.col("outcome"), "n": F.lit(1)}, "session")
    whole = strict_prior_days(s, [], {"gy": F.col("outcome"), "gn": F.lit(1)}, "session")
    base = F.coalesce(F.col("gy") / F.nullif(F.col("gn"), F.lit(0)), F.lit(0.5))
    return rejoin(own, whole, ["session"]).select("stage", "session", F.col("n").cast("long").alias("at_risk"), F.round((F.col("yes") + 20 * base) / (F.col("n") + 20), 6).alias("hazard"))


X = "least(1 - 1e-6, greatest(1e-6, p))"


@query(
    "mdl13_coordinate_ridge",
    f"""WITH RECURSIVE {FORECAST_SQL}, s AS (SELECT avg(weight) AS wm, stddev_samp(weight) AS ws, avg(party) AS pm, stddev_samp(party) AS ps FROM forecast),
r AS (SELECT outcome AS y, p, ln({X} / (1 - {X})) AS o, (weight - wm) / CASE WHEN ws > 1e-9 THEN ws ELSE 1 END AS x1, (party - pm) / CASE WHEN ps > 1e-9 THEN ps ELSE 1 END AS x2 FROM forecast, s),
fit AS (SELECT 0 AS i, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 UNION ALL
  SELECT i + 1, CASE WHEN i % 2 = 0 THEN b1 + step ELSE b1 END, CASE WHEN i % 2 = 1 THEN b2 + step ELSE b2 END FROM (
    SELECT i, b1, b2, (sum(x * (y - q)) - 5 * CASE WHEN i % 2 = 0 THEN b1 ELSE b2 END) / (sum(x * x * greatest(1e-8, q * (1 - q))) + 5) AS step
    FROM (SELECT i, b1, b2, y, CASE WHEN i % 2 = 0 THEN x1 ELSE x2 END AS x, 1 / (1 + exp(-(o + b1 * x1 + b2 * x2))) AS q FROM fit, r WHERE i < 24) GROUP BY i, b1, b2)),
l AS (SELECT b1, b2, avg((1 / (1 + exp(-(o + greatest(-1, least(1, b1 * x1 + b2 * x2))))) - y) ** 2) - avg((p - y) ** 2) AS d FROM r, (SELECT * FROM fit WHERE i = 24) GROUP BY b1, b2)
SELECT round(b1, 6) AS weight, round(b2, 6) AS party, round(d, 9) AS brier_delta FROM l""",
)
def mdl13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ridge fitted coordinate by coordinate over the forecast; its shift of the log odds is held to one."""
    names = ["weight", "party"]
    rows = written(standardized(written(forecasts(spark, sf_dir).select("outcome", "p", "weight", F.col("party").cast("double").alias("party"))), names))
    offset = logit(F.col("p"), 1e-6)
    beta = coordinate_ridge(rows, names, "outcome", offset, penalty=5.0, rounds=12, tolerance=1e-13)
    shift = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sum((float(b) * F.col(n) for n, b in zip(names, beta, strict=True)), F.lit(0.0))))
    p = logistic(offset + shift)
    delta = F.avg(F.pow(p - F.col("outcome"), 2)) - F.avg(F.pow(F.col("p") - F.col("outcome"), 2))
    return rows.agg(delta.alias("d")).select(*(F.round(F.lit(float(b)), 6).alias(n) for n, b in zip(names, beta, strict=True)), F.round("d", 9).alias("brier_delta"))


@query(
    "mdl20_replay_statuses",
    f"""WITH RECURSIVE {FORECAST_SQL}, {PMF_SQL}, c AS (SELECT event_id, n, unnest(range(0, len(pmf)))::INTEGER AS k, unnest(pmf) AS x FROM pmf),
i AS (SELECT event_id, least(1, sum(x) FILTER (WHERE k >= n // 2 + 1)) AS passage FROM c GROUP BY event_id),
e AS (SELECT event_id, min(session) AS session, count(*) AS n, min(g_n) AS g_n, max(m_n) AS m_n, sum(p) AS ey, sum(outcome) AS yes FROM forecast GROUP BY event_id),
s AS (SELECT *, CASE WHEN g_n = 0 THEN 'no-prior-history' WHEN n < 3 THEN 'insufficient-members' WHEN m_n < 5 THEN 'no-member-history' ELSE 'evaluated' END AS status, (yes >= n // 2 + 1)::INT AS passed FROM e JOIN i USING (event_id))
SELECT session, status, count(*) AS events, CASE WHEN status = 'evaluated' THEN round(avg(abs(ey - yes)), 6) END AS yes_error, CASE WHEN status = 'evaluated' THEN round(avg((passage - passed) ** 2), 6) END AS brier FROM s GROUP BY session, status""",
)
def mdl20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole replay, event by event on what was known before it: strictly prior rates, members' chances, the count's distribution, and why events are not scored."""
    f = written(forecasts(spark, sf_dir).select("event_id", "session", "outcome", "p", "g_n", "m_n"))
    e = f.groupBy("event_id").agg(F.min("session").alias("session"), F.min("g_n").alias("g_n"), F.max("m_n").alias("m_n"), F.sum("outcome").alias("yes"))
    met = chamber(f, ["event_id"]).join(e, "event_id")
    status = F.when(F.col("g_n") == 0, "no-prior-history").when(F.col("members") < 3, "insufficient-members").when(F.col("m_n") < 5, "no-member-history").otherwise("evaluated")
    passed = (F.col("yes") >= F.col("required_yes")).cast("int")
    scored = lambda x: F.when(F.col("status") == "evaluated", F.round(F.avg(x), 6))
    return met.withColumn("status", status).groupBy("session", "status").agg(F.count("*").alias("events"), scored(F.abs(F.col("expected_yes") - F.col("yes"))).alias("yes_error"), scored(F.pow(F.col("independent_p") - passed, 2)).alias("brier"))


BUCKET = 4096


def vector_digest(rows: DataFrame, number: str, line: Column, by: list[str]) -> DataFrame:
    """by and digest: of the digests of BUCKET numbers each, in order, so that no task holds all lines."""
    buckets = rows.select(*by, F.floor(F.col(number) / BUCKET).alias("b"), line.alias("line")).groupBy(*by, "b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n").cast("binary"), 256).alias("d"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"])
    return buckets.groupBy(*by).agg(F.sha2(F.array_join(ordered, "\n").cast("binary"), 256).alias("digest"))


@query(
    "sco14_gated_scorecard",
    f"""WITH {FORECAST_SQL}, l AS (SELECT chamber, event_id // {BUCKET} AS b, observation_id || ':' || round(p * 1000000)::BIGINT AS line, outcome, p FROM forecast),
d AS (SELECT chamber, b, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM l GROUP BY ALL), x AS (SELECT chamber, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM d GROUP BY chamber)
SELECT chamber, count(*) AS bills, sum(outcome)::BIGINT AS positives, round(avg(p), 6) AS mean_p, round(avg((p - outcome) ** 2), 6) AS brier, count(*) >= 100 AS complete, any_value(digest) AS digest FROM l JOIN x USING (chamber) GROUP BY chamber""",
)
def sco14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a served vector of forecasts, whether it is complete, and its digest, by which a vector that was changed is known."""
    f = written(forecasts(spark, sf_dir).select("chamber", "event_id", "observation_id", "outcome", "p"))
    digest = vector_digest(f, "event_id", F.concat("observation_id", F.lit(":"), F.round(F.col("p") * 1_000_000).cast("long")), ["chamber"])
    card = f.groupBy("chamber").agg(F.count("*").alias("bills"), F.sum("outcome").alias("positives"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg(F.pow(F.col("p") - F.col("outcome"), 2)), 6).alias("brier"))
    return card.join(digest, "chamber").select("chamber", "bills", "positives", "mean_p", "brier", (F.col("bills") >= 100).alias("complete"), "digest")


@query(
    "sco15_signal_stats",
    f"""WITH {FORECAST_SQL}, e AS (SELECT event_id, (sum(outcome) < count(*) // 2 + 1)::INT AS failed, round(avg(CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END), 9) AS risk FROM forecast GROUP BY event_id),
m AS (SELECT (avg(risk) FILTER (WHERE failed = 1) - avg(risk) FILTER (WHERE failed = 0)) / sqrt((var_samp(risk) FILTER (WHERE failed = 1) + var_samp(risk) FILTER (WHERE failed = 0)) / 2) AS smd, count(*) AS n FROM e),
t AS (SELECT risk, sum(failed) AS pos, sum(1 - failed) AS neg FROM e GROUP BY risk), c AS (SELECT *, sum(pos) OVER (ORDER BY risk DESC) AS tp, sum(pos + neg) OVER (ORDER BY risk DESC) AS seen, coalesce(sum(neg) OVER (ORDER BY risk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t)
SELECT any_value(n) AS events, round(any_value(smd), 6) AS mean_difference, round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision, round(sum(pos * below + 0.5 * pos * neg) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM c, m""",
)
def sco15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a risk tells events that failed: difference of means in pooled deviations, and ranking."""
    e = forecasts(spark, sf_dir).groupBy("event_id").agg((F.sum("outcome") < F.floor(F.count("*") / 2) + 1).cast("int").alias("outcome"), F.round(F.avg(entropy_bits(F.col("p"))), 9).alias("p"))
    e = written(e.withColumn("k", F.lit(0)))
    side = lambda f, y: f(F.when(F.col("outcome") == y, F.col("p")))
    pooled = F.sqrt((side(F.var_samp, 1) + side(F.var_samp, 0)) / 2)
    m = e.groupBy("k").agg(F.count("*").alias("events"), F.round((side(F.avg, 1) - side(F.avg, 0)) / pooled, 6).alias("mean_difference"))
    return m.join(ranking(e, ["k"]), "k").select("events", "mean_difference", F.round("average_precision", 6).alias("average_precision"), F.round("roc_auc", 6).alias("roc_auc"))


@query(
    "str01_claimed_runs",
    """WITH s AS (SELECT s_suppkey, TIMESTAMP '2024-01-01' + to_hours((s_suppkey % 48)::INT) AS next_run, s_nationkey < 20 AND s_suppkey % 6 < 5 AS live FROM supplier)
SELECT s_suppkey, strftime(next_run, '%Y-%m-%d %H') AS run_at, strftime(next_run + INTERVAL 24 HOUR, '%Y-%m-%d %H') AS next_run FROM s WHERE live AND next_run <= TIMESTAMP '2024-01-02'""",
)
def str01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due schedules are claimed, a run of each is put in once, however often the claim is tried, and its next time moves on."""
    k = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (k % 48).cast("int"))).alias("run"), ((F.col("s_nationkey") < 20) & (k % 6 < 5)).alias("live"))
    due = s.where(F.col("live") & (F.col("run") <= F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))).select("s_suppkey", F.date_format("run", "yyyy-MM-dd HH").alias("run_at"), F.date_format(F.col("run") + F.make_dt_interval(F.lit(1)), "yyyy-MM-dd HH").alias("next_run"))
    runs = insert_if_absent(due.where("false"), due, ["s_suppkey", "run_at"])
    return runs.unionByName(insert_if_absent(runs, due, ["s_suppkey", "run_at"]))


@query(
    "str02_disabled_loops",
    """WITH e AS (SELECT user_id, event_id, ts, (value < 60)::INT AS failed FROM events), g AS (SELECT *, sum(1 - failed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
c AS (SELECT *, sum(failed) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM g)
SELECT user_id, max(streak)::BIGINT AS longest, max(streak) < 5 AS enabled, arg_min(event_id, (ts, event_id)) FILTER (WHERE streak = 5) AS disabled_by FROM c GROUP BY user_id""",
)
def str02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row by user; the fifth disables the schedule."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("value") < 60).cast("int").alias("failed"))
    upto = lambda *by: Window.partitionBy(*by).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    c = e.withColumn("run", F.sum(1 - F.col("failed")).over(upto("user_id"))).withColumn("streak", F.sum("failed").over(upto("user_id", "run")))
    return c.groupBy("user_id").agg(F.max("streak").alias("longest"), (F.max("streak") < 5).alias("enabled"), F.min(F.when(F.col("streak") == 5, F.struct("ts", "event_id")))["event_id"].alias("disabled_by"))


@query(
    "str03_later_outcomes",
    f"""WITH f AS (SELECT c_custkey, (19723 + c_custkey % 20)::INTEGER AS made_on FROM customer), o AS (SELECT user_id, event_id, {DAY_SQL} AS day FROM events WHERE event_type = 'purchase' AND value > 60)
SELECT c_custkey, CASE WHEN count(event_id) = 1 THEN max(event_id) END AS resolved_by, CASE WHEN count(event_id) = 1 THEN 'resolved' WHEN count(event_id) = 0 THEN 'open' ELSE 'ambiguous' END AS status FROM f LEFT JOIN o ON user_id = c_custkey AND day > made_on GROUP BY c_custkey""",
)
def str03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast is resolved by the one outcome known later than it; with several it waits for a person."""
    f = read(spark, sf_dir, "customer").select("c_custkey", (19723 + F.col("c_custkey") % 20).cast("int").alias("made_on"))
    o = read(spark, sf_dir, "events").where("event_type = 'purchase' AND value > 60").select(F.col("user_id").alias("c_custkey"), "event_id", day_number("ts").alias("day"))
    later = f.join(o, "c_custkey").where("day > made_on").groupBy("c_custkey").agg(F.count("*").alias("n"), F.max("event_id").alias("e"))
    met = f.join(later, "c_custkey", "left")
    return met.select("c_custkey", F.when(F.col("n") == 1, F.col("e")).alias("resolved_by"), F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("open").alias("status"))


PLANTED = ("", "A bill on sports betting and wagering taxes of 12.5 percent", "Raffle and bingo rules; lawful gambling", "The state lottery", "Betting on elections is a crime", "Wetlands, with one casino mentioned", "Historical horse racing at 3% of revenue")
PLANTED_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(PLANTED)) + " END"
HITS_SQL = " + ".join(f"len(regexp_extract_all(text, '(?i){t}'))" for t in B.TERMS)
TITLE_HIT_SQL = " OR ".join(f"regexp_matches(title, '(?i){t}')" for t in B.DIRECT)


@query(
    "fn19_gambling_terms",
    rf"""WITH d AS (SELECT doc_id, {PLANTED_SQL} AS title, {PLANTED_SQL} || chr(10) || text AS text FROM documents), h AS (SELECT *, {HITS_SQL} AS hits, {TITLE_HIT_SQL} AS direct, regexp_matches(title, '(?i)\bbetting on elections?\b') AS elections FROM d)
SELECT doc_id, hits::INTEGER AS hits, CASE WHEN direct THEN 'direct' WHEN elections OR hits >= 3 THEN 'embedded' ELSE 'mention' END AS scope, CASE {" ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{n}'" for n, p in B.TOPICS.items())} ELSE 'other_gambling' END AS topic,
  coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(title, '(?i)(\d+(?:\.\d+)?)\s*(?:%|percent)', 1))), ','), '') AS percents FROM h WHERE direct OR elections OR hits > 0""",
)
def fn19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a text is about gambling: counted terms, scope by title, the first topic found, and percentages."""
    title = F.element_at(F.array(*map(F.lit, PLANTED)), (F.col("doc_id") % 7 + 1).cast("int"))
    d = read(spark, sf_dir, "documents").select("doc_id", title.alias("title"), F.concat(title, F.lit("\n"), "text").alias("text"))
    d = d.select("doc_id", "title", B.term_hits(F.col("text")).alias("hits"), B.topic(F.col("text")).alias("topic")).withColumn("scope", B.scope(F.col("title"), F.col("hits"))).where("scope IS NOT NULL")
    percents = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("title", F.lit(r"(?i)(\d+(?:\.\d+)?)\s*(?:%|percent)"), F.lit(1)))), ",")
    return d.select("doc_id", "hits", "scope", "topic", percents.alias("percents"))


DESIGNS = [
    "Prediction markets; poker and fantasy sports prohibited",
    "Sports betting|Tribal nations and a licensed operator may offer mobile sports betting and retail betting at a tax of 12.5 percent. They pay 20 percent of net as a tax and serve persons at least 21 years of age; up to 11 mobile licenses. Problem gambling and youth sports get a share.",
    "Wetlands|A casino, a casino and bingo.",
    "Horse racing|The license of a" + chr(10) + "racetrack. Mobile wagering is prohibited. In-game data by geofencing, at rates of 101 percent.",
    "Schools|Nothing of the kind.",
    "Betting on elections|Collegiate games may be wagered on; a constitutional amendment; the general fund",
    "Lottery|Payments to tribes and Running Aces, a distribution of the racetrack; college games; not more than 3 operators; under 18 years of age. Retail wagering in a hall is not permitted",
]
#: Per text: hits, scope, topic, license, mobile, retail, track, rates, age, operators, college, recipients, flags.
TOLD = [
    (3, "direct", "prediction_markets", "unknown", None, None, "none", "", None, None, "unknown", "", ""),
    (3, "direct", "sports_betting", "hybrid", True, True, "none", "12.5,20.0", 21, 11, "unknown", "problem_gambling,youth_sports,tribal_nations", "responsible_gaming_funding"),
    (3, "embedded", "charitable_gambling", "unknown", None, None, "none", "", None, None, "unknown", "", ""),
    (2, "direct", "horse_racing", "unknown", True, None, "licensee", "", None, None, "unknown", "horse_racing", "in_game_wagering,geolocation"),
    None,
    (2, "embedded", "election_betting", "unknown", None, None, "none", "", None, None, "allowed", "general_fund", "constitutional_amendment"),
    (2, "direct", "lottery", "tribal_exclusive", None, True, "licensee", "", 18, 3, "prohibited", "horse_racing,tribal_nations", ""),
]
DESIGN_FIELDS = ("hits", "scope", "topic", "license_model", "mobile_allowed", "retail_allowed", "racetrack_role", "tax_rates", "minimum_age", "operator_count", "college_policy", "revenue_recipients", "policy_flags")


def design_case_sql(i: int) -> str:
    value = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'"
    return "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN {value(own[i])}" for k, own in enumerate(TOLD) if own) + " END"


@query("fn19_design_fields", f"SELECT doc_id, {', '.join(f'{design_case_sql(i)} AS {name}' for i, name in enumerate(DESIGN_FIELDS))} FROM documents WHERE doc_id % 7 <> 4")
def fn19_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve fields of a bill's design, of texts planted for the documents' ids."""
    bill = F.get(F.array(*map(F.lit, DESIGNS)), (F.col("doc_id") % 7).cast("int"))
    own = B.design(F.substring_index(bill, "|", 1), F.when(bill.contains("|"), F.substring_index(bill, "|", -1)))
    d = read(spark, sf_dir, "documents").select("doc_id", own.alias("d")).where("d IS NOT NULL").select("doc_id", "d.*")
    return d.select("doc_id", *(F.array_join(c, ",").alias(c) if c in ("tax_rates", "revenue_recipients", "policy_flags") else c for c in DESIGN_FIELDS))


@query(
    "prj18_two_clock_admission",
    """WITH r AS (SELECT l_suppkey AS member_id, l_shipdate::DATE AS activity_on, CASE WHEN l_partkey % 7 <> 0 THEN l_shipdate::DATE + (l_partkey % 60)::INT END AS available_on FROM lineitem)
SELECT member_id, count(*) FILTER (WHERE activity_on < DATE '1998-06-01') AS by_activity, count(*) FILTER (WHERE available_on < DATE '1998-06-01') AS by_availability FROM r GROUP BY member_id""",
)
def prj18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each clock would have admitted before a cutoff: the day of the deed, or the day it was known; rows without the clock's date are not admitted."""
    deed = F.to_date("l_shipdate")
    r = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("member_id"), deed.alias("activity_on"), F.when(F.col("l_partkey") % 7 != 0, F.date_add(deed, (F.col("l_partkey") % 60).cast("int"))).alias("available_on"))

    def clock(name: str) -> Column:
        return F.count_if(F.coalesce(F.col(name) < F.lit("1998-06-01").cast("date"), F.lit(False)))

    return r.groupBy("member_id").agg(clock("activity_on").alias("by_activity"), clock("available_on").alias("by_availability"))


@query(
    "mdl26_snapshot_evidence",
    f"""WITH s AS (SELECT o_orderkey AS snapshot, o_custkey AS bill, (19723 + o_orderkey % 30)::INTEGER AS cutoff FROM orders), e AS (SELECT user_id, event_type, {DAY_SQL} AS day FROM events),
a AS (SELECT DISTINCT l_orderkey AS snapshot, l_suppkey AS author FROM lineitem),
b AS (SELECT snapshot, count(user_id) AS n FROM s LEFT JOIN e ON user_id = bill AND event_type IN ('view', 'click') AND day < cutoff GROUP BY snapshot),
m AS (SELECT s.snapshot, count(user_id) AS n, count(DISTINCT author) AS authors FROM s JOIN a USING (snapshot) LEFT JOIN e ON user_id = author AND event_type = 'purchase' AND day < cutoff GROUP BY s.snapshot)
SELECT b.snapshot, b.n AS bill_items, m.n AS author_items, m.authors FROM b LEFT JOIN m USING (snapshot)""",
)
def mdl26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence known before each snapshot, by its bill and by each of its authors once: running counts by day, looked up as of the cutoff."""
    from ..operators.asof import asof_join

    s = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snapshot"), F.col("o_custkey").alias("bill"), (19723 + F.col("o_orderkey") % 30).cast("int").alias("cutoff"))
    e = read(spark, sf_dir, "events").select("user_id", "event_type", day_number("ts").alias("day"))

    def running(rows: DataFrame, key: str) -> DataFrame:
        d = rows.groupBy(F.col("user_id").alias(key), F.col("day").alias("known")).agg(F.count("*").alias("n"))
        return d.withColumn("n", F.sum("n").over(Window.partitionBy(key).orderBy("known").rowsBetween(Window.unboundedPreceding, 0)))

    bills = asof_join(s, running(e.where("event_type IN ('view', 'click')"), "bill"), ["bill"], "cutoff", "known", ["n"]).select("snapshot", F.coalesce("n", F.lit(0)).alias("bill_items"))
    authors = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snapshot"), F.col("l_suppkey").alias("author")).distinct().join(s.select("snapshot", "cutoff"), "snapshot")
    own = asof_join(authors, running(e.where("event_type = 'purchase'"), "author"), ["author"], "cutoff", "known", ["n"]).groupBy("snapshot").agg(F.sum(F.coalesce("n", F.lit(0))).alias("author_items"), F.count("*").alias("authors"))
    return bills.join(own, "snapshot", "left").select("snapshot", "bill_items", "author_items", "authors")


@query(
    "api_forecast_list",
    """WITH f AS (SELECT o_orderkey, o_orderdate, o_orderstatus, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 AND o_orderstatus <> 'P'),
r AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS latest, arg_max(l_discount, (l_linenumber, l_suppkey, l_partkey)) AS p FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS id, c_name || ' · ' || o_orderkey AS label, o_orderstatus AS status, coalesce(n, 0) AS revisions, latest::INTEGER AS latest, p AS latest_p FROM f LEFT JOIN r ON l_orderkey = o_orderkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""",
)
def api_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An owner's newest forecasts with the number of their revisions and the latest one."""
    f = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").where("c_nationkey = 3").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).where("o_orderstatus <> 'P'")
    top = f.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(max(1, min(100, 20)))
    met = top.join(read(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey", "c_name", "o_orderstatus")
    last = F.max(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_discount"))
    g = met.agg(F.count("l_orderkey").alias("revisions"), last.alias("last"))
    return g.select(F.col("o_orderkey").alias("id"), F.concat("c_name", F.lit(" · "), "o_orderkey").alias("label"), F.col("o_orderstatus").alias("status"), "revisions", F.col("last.l_linenumber").cast("int").alias("latest"), F.col("last.l_discount").alias("latest_p"))


RANK_SQL = "CASE stage WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END"


@query(
    "win17_state_changes",
    f"""WITH {STAGES_SQL}, d AS (SELECT bill_id, day, max({RANK_SQL}) AS top FROM stages WHERE outcome = 1 GROUP BY bill_id, day),
s AS (SELECT bill_id, day, coalesce(max(top) OVER (PARTITION BY bill_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before, max(top) OVER (PARTITION BY bill_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS after FROM d)
SELECT bill_id, (day + 1)::INTEGER AS cutoff, before::INTEGER AS state_before, after::INTEGER AS state FROM s WHERE after > before""",
)
def win17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of each bill on the day after its state rose; what happens on one day is one change."""
    t = F.col("stage")
    rank = F.when(t == "view", 1).when(t == "click", 2).when(t == "purchase", 3).otherwise(0)
    d = stages(spark, sf_dir).where("outcome = 1").groupBy("bill_id", "day").agg(F.max(rank).alias("top"))
    w = Window.partitionBy("bill_id").orderBy("day")
    s = d.select("bill_id", "day", F.coalesce(F.max("top").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)).alias("before"), F.max("top").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("after"))
    return s.where("after > before").select("bill_id", (F.col("day") + 1).cast("int").alias("cutoff"), F.col("before").alias("state_before"), F.col("after").alias("state"))


@query("prj05_json_set", """SELECT event_id, '{"a":"' || event_id || '","b":"' || CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END || '"}' AS j FROM events""")
def prj05_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field of a JSON object set, the others kept."""
    i = F.col("event_id")
    old = F.from_json(F.to_json(F.struct(i.cast("string").alias("a"), F.lit("old").alias("b"))), "a string, b string")
    return read(spark, sf_dir, "events").select("event_id", old.alias("o")).select("event_id", F.to_json(F.when(i % 2 == 0, F.col("o").withField("b", F.lit("new"))).otherwise(F.col("o"))).alias("j"))


@query(
    "mdl03_chained_calibration",
    f"""WITH {FORECAST_SQL}, b AS (SELECT least(9, floor(p * 10))::INT AS bin, session, count(*) AS n, sum(p) AS sp, sum(outcome) AS yes FROM forecast GROUP BY ALL),
c AS (SELECT bin, session, coalesce(sum(n) OVER w, 0) AS n, sum(sp) OVER w AS sp, sum(yes) OVER w AS yes FROM b WINDOW w AS (PARTITION BY bin ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT session, count(*) AS n, count(*) FILTER (WHERE c.n >= 25) AS calibrated, round(avg((CASE WHEN c.n >= 25 THEN least(0.995, greatest(0.005, (yes + 4 * sp / c.n) / (c.n + 4))) ELSE p END - outcome) ** 2), 6) AS brier
FROM forecast f JOIN c ON least(9, floor(p * 10))::INT = c.bin AND f.session = c.session GROUP BY f.session""".replace("SELECT session, count(*) AS n, count(*) FILTER", "SELECT f.session, count(*) AS n, count(*) FILTER"),
)
def mdl03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts calibrated by what their bins came to in earlier sessions; bins without enough of those pass through."""
    from ..functions.numeric import clamp
    from ..operators.rates import HIGH, LEAST_BIN, LOW, SMOOTHING, bin_of

    f = forecasts(spark, sf_dir).select("session", "outcome", "p", bin_of(F.col("p")).alias("bin"))
    past = strict_prior_days(f, ["bin"], {"bn": F.lit(1), "sp": F.col("p"), "yes": F.col("outcome")}, "session")
    enough = F.col("bn") >= LEAST_BIN
    q = F.when(enough, clamp((F.col("yes") + SMOOTHING * F.col("sp") / F.col("bn")) / (F.col("bn") + SMOOTHING), LOW, HIGH)).otherwise(F.col("p"))
    return rejoin(f, past, ["bin", "session"]).groupBy("session").agg(F.count("*").alias("n"), F.count_if(enough).alias("calibrated"), F.round(F.avg(F.pow(q - F.col("outcome"), 2)), 6).alias("brier"))
