"""Joins, aggregates, windows, sorts and sets (JOIN, AGG, WIN, SRT, SET, PRJ) on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.asof import active_on, asof_join, latest, strict_prior, unique_or_null
from ..operators.evidence import first_seen
from ..sources.tables import MEMBERSHIPS_SQL, STAGES_SQL, VOTES_SQL, day_number, memberships, read, stages, votes
from .registry import query

DAY = "({0}::DATE - DATE '1970-01-01')::INTEGER"


@query(
    "join01_star",
    """SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def join01(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, customer, nation, region = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    bills = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "r_name", "n_name", "c_mktsegment")
    g = line.join(bills, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("r_name", "n_name", "c_mktsegment")
    return g.agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("join02_left_counts", "SELECT c_custkey, count(o_orderkey) AS orders, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join02(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce(F.round("total", 2), F.lit(0.0)).alias("total"))


@query("join03_on_constant", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 1")
def join03(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").where("n_regionkey = 1")
    return read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query("join04_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def join04(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(r, "o_orderkey", "left_semi")


@query("join05_no_later_row", f"SELECT event_id FROM events a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND (b.ts > a.ts OR (b.ts = a.ts AND b.event_id > a.event_id)))")
def join05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that no later row of their series replaces: by the series' last row, not by pairs."""
    last = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    return last.select(F.col("last.event_id").alias("event_id"))


@query(
    "join06_asof_strict",
    f"""SELECT a.event_id, b.day AS prior_day, b.value AS prior_value FROM (SELECT event_id, user_id, {DAY.format("ts")} AS day FROM events) a
LEFT JOIN LATERAL (SELECT {DAY.format("ts")} AS day, max(value) AS value FROM events e WHERE e.user_id = a.user_id AND {DAY.format("ts")} < a.day GROUP BY 1 ORDER BY 1 DESC LIMIT 1) b ON true""",
)
def join06(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "value", day_number("ts").alias("day"))
    found = asof_join(e.select("event_id", "user_id", "day"), e.select("user_id", F.col("day").alias("prior_day"), "value"), ["user_id"], "day", "prior_day", ["value"])
    return found.select("event_id", "prior_day", F.col("value").alias("prior_value"))


@query(
    "join07_version_asof",
    f"""WITH e AS (SELECT event_id, user_id, event_type, {DAY.format("ts")} AS day FROM events),
v AS (SELECT user_id, day, max(event_id) AS version FROM e WHERE event_type = 'click' GROUP BY user_id, day)
SELECT e.event_id, (SELECT version FROM v WHERE v.user_id = e.user_id AND v.day <= e.day ORDER BY v.day DESC LIMIT 1) AS version FROM e WHERE event_type = 'purchase'""",
)
def join07(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", day_number("ts").alias("day"))
    versions = e.where("event_type = 'click'").select("user_id", F.col("day").alias("published"), F.col("event_id").alias("version"))
    return asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "day"), versions, ["user_id"], "day", "published", ["version"], strict=False).select("event_id", "version")


@query("join08_interval", f"WITH {VOTES_SQL}, {MEMBERSHIPS_SQL} SELECT v.party, count(*) AS votes, count(*) FILTER (WHERE (starts_on IS NULL OR starts_on <= day) AND (ends_on IS NULL OR ends_on >= day)) AS active FROM votes v JOIN memberships USING (member_id) GROUP BY v.party")
def join08(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = votes(spark, sf_dir).join(memberships(spark, sf_dir), "member_id")
    return met.groupBy("party").agg(F.count("*").alias("votes"), F.count_if(active_on(F.col("day"), F.col("starts_on"), F.col("ends_on"))).alias("active"))


@query("join09_expression_key", r"SELECT s_suppkey, n_name FROM supplier JOIN nation ON regexp_replace(s_name, '\D', '', 'g')::BIGINT % 25 = n_nationkey")
def join09(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", (F.regexp_replace("s_name", r"\D", "").cast("long") % 25).cast("int").alias("n_nationkey"))
    return s.join(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("s_suppkey", "n_name")


@query("join11_null_safe", f"WITH {MEMBERSHIPS_SQL} SELECT starts_on, count(*) AS n, sum(m)::BIGINT AS matched FROM memberships JOIN (SELECT starts_on AS s, count(*) AS m FROM memberships GROUP BY starts_on) ON starts_on IS NOT DISTINCT FROM s GROUP BY starts_on")
def join11(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memberships(spark, sf_dir)
    counts = m.groupBy(F.col("starts_on").alias("s")).agg(F.count("*").alias("m"))
    return m.join(counts, F.col("starts_on").eqNullSafe(F.col("s"))).groupBy("starts_on").agg(F.count("*").alias("n"), F.sum("m").alias("matched"))


@query(
    "join12_peer_agreement",
    f"""WITH {VOTES_SQL}, one AS (SELECT event_id, member_id, max(outcome) AS outcome FROM votes GROUP BY ALL)
SELECT a.member_id, b.member_id AS peer, count(*) AS shared, sum((a.outcome = b.outcome)::INT)::BIGINT AS aligned FROM one a JOIN one b ON a.event_id = b.event_id AND a.member_id <> b.member_id GROUP BY ALL HAVING count(*) >= 3""",
)
def join12(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = votes(spark, sf_dir).groupBy("event_id", "member_id").agg(F.max("outcome").alias("outcome"))
    pairs = one.join(one.select("event_id", F.col("member_id").alias("peer"), F.col("outcome").alias("other")), "event_id").where("member_id <> peer")
    return pairs.groupBy("member_id", "peer").agg(F.count("*").alias("shared"), F.count_if(F.col("outcome") == F.col("other")).alias("aligned")).where("shared >= 3")


@query(
    "join14_symmetric_pairs",
    "WITH p AS (SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_discount >= 0.09) SELECT x, count(*) AS n FROM (SELECT a AS x FROM p UNION ALL SELECT b FROM p) GROUP BY x",
)
def join14(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem").where("l_discount >= 0.09"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return p.select(F.col("a").alias("x")).unionByName(p.select(F.col("b").alias("x"))).groupBy("x").agg(F.count("*").alias("n"))


@query("join15_densified_roster", f"WITH {VOTES_SQL}, i AS (SELECT DISTINCT session FROM votes), c AS (SELECT member_id, session, count(*) AS n FROM votes GROUP BY ALL) SELECT s_suppkey AS member_id, session, coalesce(n, 0) AS n FROM supplier CROSS JOIN i LEFT JOIN c ON c.member_id = s_suppkey AND c.session = i.session".replace("session, coalesce", "i.session AS session, coalesce"))
def join15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member with every session: sessions are a handful, put in an array and exploded."""
    v = votes(spark, sf_dir)
    sessions = v.agg(F.collect_set("session").alias("sessions"))
    roster = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("member_id")).crossJoin(F.broadcast(sessions)).select("member_id", F.explode("sessions").alias("session"))
    return roster.join(v.groupBy("member_id", "session").agg(F.count("*").alias("n")), ["member_id", "session"], "left").select("member_id", "session", F.coalesce("n", F.lit(0)).alias("n"))


@query("join16_lateral_explode", "WITH w AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, unnest(range(0, len(l)))::INTEGER AS at, len(unnest(l))::INTEGER AS length FROM w")
def join16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).select("doc_id", "at", F.length("line").alias("length"))


@query("join17_scalar_subqueries", "SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS lines, (SELECT max(l_discount) FROM lineitem WHERE l_suppkey = s_suppkey) AS top FROM supplier")
def join17(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("lines"), F.max("l_discount").alias("top"))
    return read(spark, sf_dir, "supplier").select("s_suppkey").join(g, "s_suppkey", "left").select("s_suppkey", F.coalesce("lines", F.lit(0)).alias("lines"), "top")


@query("join23_unique_or_null", "SELECT s_nationkey, CASE WHEN count(DISTINCT s_suppkey) = 1 THEN min(s_suppkey) END AS member FROM supplier GROUP BY s_nationkey")
def join23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_or_null(read(spark, sf_dir, "supplier"), ["s_nationkey"], "s_suppkey").withColumnRenamed("s_suppkey", "member")


@query(
    "join21_name_ladder",
    r"""WITH n AS (SELECT s_suppkey, lower(s_name) AS name, (s_suppkey % 40)::VARCHAR AS surname FROM supplier),
w AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'supplier#' || lpad((c_custkey % 150)::VARCHAR, 9, '0') ELSE 'x' END AS name, (c_custkey % 60)::VARCHAR AS surname FROM customer),
e AS (SELECT name, min(s_suppkey) AS id, count(*) AS k FROM n GROUP BY name), u AS (SELECT surname, min(s_suppkey) AS id, count(*) AS k FROM n GROUP BY surname)
SELECT c_custkey, CASE WHEN e.k = 1 THEN e.id WHEN u.k = 1 THEN u.id END AS member, CASE WHEN e.k = 1 THEN 'exact' WHEN u.k = 1 THEN 'surname' WHEN u.k > 1 THEN 'ambiguous' ELSE 'unmatched' END AS rule
FROM w LEFT JOIN e ON w.name = e.name LEFT JOIN u ON w.surname = u.surname""",
)
def join21(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "supplier").select("s_suppkey", F.lower("s_name").alias("name"), (F.col("s_suppkey") % 40).cast("string").alias("surname"))
    k = F.col("c_custkey")
    wanted = read(spark, sf_dir, "customer").select("c_custkey", F.when(k % 2 == 0, F.concat(F.lit("supplier#"), F.lpad((k % 150).cast("string"), 9, "0"))).otherwise("x").alias("name"), (k % 60).cast("string").alias("surname"))
    exact = n.groupBy("name").agg(F.min("s_suppkey").alias("eid"), F.count("*").alias("ek"))
    same = n.groupBy("surname").agg(F.min("s_suppkey").alias("uid"), F.count("*").alias("uk"))
    met = wanted.join(exact, "name", "left").join(same, "surname", "left")
    rule = F.when(F.col("ek") == 1, "exact").when(F.col("uk") == 1, "surname").when(F.col("uk") > 1, "ambiguous").otherwise("unmatched")
    return met.select("c_custkey", F.when(F.col("ek") == 1, F.col("eid")).when(F.col("uk") == 1, F.col("uid")).alias("member"), rule.alias("rule"))


@query(
    "join25_contradictions",
    """WITH e AS (SELECT event_id, user_id, event_type, value >= 50 AS supports, ts::DATE AS d FROM events)
SELECT a.event_id AS first_id, b.event_id AS second_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.d = b.d AND a.supports <> b.supports AND a.event_id < b.event_id""",
)
def join25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of rows of a key and day that contradict each other.  The sides meet by an equality join, so that pairs of one side are never made."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.col("value") >= 50).alias("supports"), F.to_date("ts").alias("d"))
    b = e.select(F.col("event_id").alias("second_id"), "user_id", "event_type", (~F.col("supports")).alias("supports"), "d")
    return e.join(b, ["user_id", "event_type", "d", "supports"]).where("event_id < second_id").select(F.col("event_id").alias("first_id"), "second_id")


@query(
    "join26_one_hop",
    """WITH e AS (SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 45), label AS (SELECT s_suppkey AS b, s_acctbal < 0 AS flagged FROM supplier)
SELECT a, bool_or(flagged) AS touched, count(*) FILTER (WHERE flagged) AS by FROM e JOIN label USING (b) GROUP BY a""".replace(" AS by ", " AS flagged_by "),
)
def join26(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem").where("l_quantity >= 45"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    label = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("b"), (F.col("s_acctbal") < 0).alias("flagged"))
    return e.join(label, "b").groupBy("a").agg(F.bool_or("flagged").alias("touched"), F.count_if("flagged").alias("flagged_by"))


@query("agg01_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, min(l_discount) AS low, max(l_discount) AS high, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY ALL")
def agg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"), F.round(F.avg("l_extendedprice"), 4).alias("price"))


@query(
    "agg02_conditional",
    "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(DISTINCT l_orderkey) AS events, count(DISTINCT l_partkey) FILTER (WHERE l_discount > 0.05) AS deep, bool_or(l_tax > 0.07) AS taxed, bool_and(l_quantity < 50) AS small FROM lineitem GROUP BY l_suppkey",
)
def agg02(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "lineitem").groupBy("l_suppkey")
    return g.agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_distinct("l_orderkey").alias("events"), F.count_distinct(F.when(F.col("l_discount") > 0.05, F.col("l_partkey"))).alias("deep"), F.bool_or(F.col("l_tax") > 0.07).alias("taxed"), F.bool_and(F.col("l_quantity") < 50).alias("small"))


@query("agg06_ordered_strings", "SELECT s_nationkey, string_agg(s_name, ', ' ORDER BY s_name) AS names FROM supplier GROUP BY s_nationkey")
def agg06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), ", ").alias("names"))


@query("agg08_having", "SELECT l_partkey, count(*) AS n, round(avg(l_quantity), 4) AS quantity FROM lineitem GROUP BY l_partkey HAVING count(*) >= 30 AND avg(l_quantity) > 25")
def agg08(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("q"))
    return g.where("n >= 30 AND q > 25").select("l_partkey", "n", F.round("q", 4).alias("quantity"))


@query("agg09_counters", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM events WHERE value > 90) AS high, (SELECT max(c_acctbal) FROM customer) AS balance")
def agg09(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").agg(F.count("*").alias("orders"))
    e = read(spark, sf_dir, "events").agg(F.count_if(F.col("value") > 90).alias("high"))
    return o.crossJoin(e).crossJoin(read(spark, sf_dir, "customer").agg(F.max("c_acctbal").alias("balance")))


@query(
    "agg16_strongest_then_sum",
    f"""WITH {VOTES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY member_id, event_id ORDER BY weight DESC, observation_id) AS k FROM votes) SELECT member_id, round(sum(weight) FILTER (WHERE k = 1), 4) AS score, count(*) FILTER (WHERE k = 1) AS n FROM r GROUP BY member_id""",
)
def agg16(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = votes(spark, sf_dir).groupBy("member_id", "event_id").agg(F.max("weight").alias("weight"))
    return best.groupBy("member_id").agg(F.round(F.sum("weight"), 4).alias("score"), F.count("*").alias("n"))


@query("agg17_first_seen", "SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def agg17(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return first_seen(e, F.struct("user_id", "event_type"), F.col("ts"), F.col("event_id")).select("user_id", "event_type", "event_id")


@query("agg18_feature_vector", "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, round(ln(1 + count(*) FILTER (WHERE event_type = 'view')), 6) AS views, round(max(value), 4) AS top FROM events GROUP BY user_id")
def agg18(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "events").groupBy("user_id")
    return g.agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.round(F.log1p(F.count_if(F.col("event_type") == "view").cast("double")), 6).alias("views"), F.round(F.max("value"), 4).alias("top"))


@query("agg20_coverage", "SELECT source, count(*) AS documents, count(l.doc_id) AS labelled, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def agg20(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    return met.groupBy("source").agg(F.count("*").alias("documents"), F.count("l").alias("labelled"), F.count_if(F.col("l").isNull()).alias("missing"))


@query(
    "agg23_top_two_margin",
    """WITH t AS (SELECT o_custkey, l_suppkey, sum(l_quantity) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT o_custkey, v, row_number() OVER (PARTITION BY o_custkey ORDER BY v DESC, l_suppkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM t)
SELECT o_custkey, any_value(n) AS candidates, round(max(v) FILTER (WHERE k = 1) - coalesce(max(v) FILTER (WHERE k = 2), 0), 4) AS margin, any_value(n) = 1 AS uncontested FROM r GROUP BY o_custkey""",
)
def agg23(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.sum("l_quantity").alias("v"))
    two = t.withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("v"), "l_suppkey"))).where("k <= 2")  # groups are cut short by the plan
    two = two.groupBy("o_custkey").agg(F.sort_array(F.collect_list("v"), asc=False).alias("v"))
    g = t.groupBy("o_custkey").agg(F.count("*").alias("candidates")).join(two, "o_custkey")
    return g.select("o_custkey", "candidates", F.round(F.col("v")[0] - F.coalesce(F.get("v", F.lit(1)), F.lit(0.0)), 4).alias("margin"), (F.col("candidates") == 1).alias("uncontested"))


@query("win01_ranked_peer", "WITH s AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) SELECT s_nationkey, s_suppkey FROM s WHERE k = 1")
def win01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(read(spark, sf_dir, "supplier"), ["s_nationkey"], F.desc("s_acctbal"), F.col("s_suppkey")).select("s_nationkey", "s_suppkey")


@query("win03_dense_rank", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderdate::DATE)::BIGINT AS day_rank FROM orders")
def win03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the distinct days, joined back: the global window sees one row a day."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    days = o.select("d").distinct().withColumn("day_rank", F.row_number().over(Window.orderBy("d")).cast("long"))
    return o.join(days, "d").select("o_orderkey", "day_rank")


@query("win04_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def win04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("o_orderkey"))


@query(
    "win12_mid_rank",
    """SELECT p_partkey, round(CASE WHEN count(*) OVER b = 1 THEN 0.5 ELSE (rank() OVER w - 1 + (count(*) OVER t - 1) / 2) / (count(*) OVER b - 1) END, 6) AS percentile
FROM part WINDOW b AS (PARTITION BY p_brand), w AS (PARTITION BY p_brand ORDER BY p_size), t AS (PARTITION BY p_brand, p_size)""",
)
def win12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties share the mean of their ranks; counted on one row per value."""
    p = read(spark, sf_dir, "part")
    v = p.groupBy("p_brand", "p_size").agg(F.count("*").alias("t"))
    v = v.withColumn("below", F.sum("t").over(Window.partitionBy("p_brand").orderBy("p_size")) - F.col("t")).withColumn("n", F.sum("t").over(Window.partitionBy("p_brand")))
    at = F.when(F.col("n") == 1, 0.5).otherwise((F.col("below") + (F.col("t") - 1) / 2) / (F.col("n") - 1))
    return p.join(v.withColumn("percentile", F.round(at, 6)), ["p_brand", "p_size"]).select("p_partkey", "percentile")


@query(
    "win14_day_then_learn",
    f"""WITH {STAGES_SQL}, d AS (SELECT stage, day, sum(outcome) AS yes, count(*) AS n FROM stages GROUP BY ALL),
p AS (SELECT stage, day, coalesce(sum(yes) OVER w, 0) AS yes, coalesce(sum(n) OVER w, 0) AS n FROM d WINDOW w AS (PARTITION BY stage ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, round((yes + 10 * 0.5) / (n + 10), 6) AS rate FROM stages JOIN p USING (stage, day)""",
)
def win14(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = strict_prior(stages(spark, sf_dir), ["stage"], {"yes": F.col("outcome"), "n": F.lit(1)})
    return c.select("event_id", F.round((F.col("yes") + 5.0) / (F.col("n") + 10), 6).alias("rate"))


@query(
    "win15_reverse_replay",
    """WITH a AS (SELECT user_id, event_id, ts, event_type IN ('view', 'click') AS adds FROM events), cutoff AS (SELECT TIMESTAMP '2024-01-15' AS c),
f AS (SELECT user_id, min_by(adds, (ts, event_id)) AS first_after FROM a, cutoff WHERE ts >= c GROUP BY user_id), n AS (SELECT user_id, max_by(adds, (ts, event_id)) AS now FROM a GROUP BY user_id)
SELECT user_id, coalesce(NOT first_after, now) AS member_then FROM n LEFT JOIN f USING (user_id)""",
)
def win15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State at a cutoff from the state now: the first change after the cutoff tells what held before it."""
    a = read(spark, sf_dir, "events").withColumn("adds", F.col("event_type").isin("view", "click"))
    after = F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    g = a.groupBy("user_id").agg(F.min_by(F.when(after, F.col("adds")), F.when(after, F.struct("ts", "event_id"))).alias("first"), F.max_by("adds", F.struct("ts", "event_id")).alias("now"))
    return g.select("user_id", F.coalesce(~F.col("first"), F.col("now")).alias("member_then"))


@query(
    "win16_hash_chain",
    """WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT user_id, (day - DATE '1970-01-01')::INTEGER AS day, sha256(user_id || ':' || (day - DATE '1970-01-01') || ':' || n) AS seal FROM d)
SELECT user_id, day, coalesce(lag(seal) OVER (PARTITION BY user_id ORDER BY day), '') AS prior_seal FROM s""",
)
def win16(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "events").groupBy("user_id", day_number("ts").alias("day")).agg(F.count("*").alias("n"))
    s = d.withColumn("seal", F.sha2(F.concat_ws(":", "user_id", "day", "n").cast("binary"), 256))
    return s.select("user_id", "day", F.coalesce(F.lag("seal").over(Window.partitionBy("user_id").orderBy("day")), F.lit("")).alias("prior_seal"))


@query(
    "win17_lifecycle_snapshots",
    f"""WITH {STAGES_SQL}, k AS (SELECT bill_id, day, max(CASE stage WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 4 ELSE 3 END) AS rank, count(*) AS n FROM stages GROUP BY bill_id, day)
SELECT bill_id, day, coalesce(max(rank) OVER w, 0)::INTEGER AS state, coalesce(sum(n) OVER w, 0)::BIGINT AS prior_events FROM k WINDOW w AS (PARTITION BY bill_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def win17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("stage") == "view", 1).when(F.col("stage") == "click", 2).when(F.col("stage") == "purchase", 4).otherwise(3)
    k = stages(spark, sf_dir).groupBy("bill_id", "day").agg(F.max(rank).alias("rank"), F.count("*").alias("n"))
    w = Window.partitionBy("bill_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return k.select("bill_id", "day", F.coalesce(F.max("rank").over(w), F.lit(0)).alias("state"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("prior_events"))


@query(
    "win18_hazard_rates",
    f"""WITH {STAGES_SQL}, m AS (SELECT stage, day // 30 AS period, count(*) AS n, sum(outcome) AS yes FROM stages GROUP BY ALL)
SELECT stage, period::INTEGER AS period, n, round(coalesce(sum(yes) OVER w / nullif(sum(n) OVER w, 0), 0.5), 6) AS hazard FROM m WINDOW w AS (PARTITION BY stage ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def win18(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stages(spark, sf_dir).groupBy("stage", F.floor(F.col("day") / 30).cast("int").alias("period")).agg(F.count("*").alias("n"), F.sum("outcome").alias("yes"))
    w = Window.partitionBy("stage").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    return m.select("stage", "period", "n", F.round(F.coalesce(F.sum("yes").over(w) / F.sum("n").over(w), F.lit(0.5)), 6).alias("hazard"))


@query("win19_ntile_sample", "WITH t AS (SELECT p_brand, p_partkey, ntile(5) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part) SELECT p_brand, b::INTEGER AS b, min(p_partkey) AS p_partkey FROM t GROUP BY ALL")
def win19(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.ntile(5).over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("b"))
    return t.groupBy("p_brand", "b").agg(F.min("p_partkey").alias("p_partkey"))


@query("srt01_nulls_last", f"WITH {MEMBERSHIPS_SQL}, r AS (SELECT member_id, row_number() OVER (ORDER BY ends_on DESC NULLS LAST, starts_on ASC NULLS FIRST, member_id) AS k FROM memberships) SELECT member_id, k::INTEGER AS k FROM r WHERE k <= 50")
def srt01(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = memberships(spark, sf_dir).orderBy(F.desc_nulls_last("ends_on"), F.asc_nulls_first("starts_on"), "member_id").limit(50)
    return top.withColumn("k", F.row_number().over(Window.orderBy(F.desc_nulls_last("ends_on"), F.asc_nulls_first("starts_on"), "member_id"))).select("member_id", "k")


@query("srt03_offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def srt03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query("srt06_strongest_mean", "WITH r AS (SELECT l_suppkey, l_discount - 0.05 AS d, row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(l_discount - 0.05) DESC, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) SELECT l_suppkey, round(avg(d), 6) AS mean FROM r WHERE k <= 8 GROUP BY l_suppkey")
def srt06(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount") - 0.05
    r = read(spark, sf_dir, "lineitem").select("l_suppkey", d.alias("d"), F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc(F.abs(d)), "l_orderkey", "l_linenumber", "l_partkey")).alias("k"))
    return r.where("k <= 8").groupBy("l_suppkey").agg(F.round(F.avg("d"), 6).alias("mean"))


@query(
    "srt11_interleaved_rankings",
    """WITH a AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS k, 0 AS src FROM supplier), b AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_name DESC, s_suppkey) AS k, 1 AS src FROM supplier),
u AS (SELECT id, min(2 * k + src) AS key FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id)
SELECT id, row_number() OVER (ORDER BY key)::INTEGER AS place FROM u ORDER BY key LIMIT 30""",
)
def srt11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first 30 of either ranking can be among the first 30 of both."""
    s = read(spark, sf_dir, "supplier")
    tops = []
    for src, order in enumerate(([F.desc("s_acctbal"), F.col("s_suppkey")], [F.desc("s_name"), F.col("s_suppkey")])):
        top = s.orderBy(*order).limit(30)
        tops.append(top.select(F.col("s_suppkey").alias("id"), (2 * F.row_number().over(Window.orderBy(*order)) + src).alias("key")))
    u = tops[0].unionByName(tops[1]).groupBy("id").agg(F.min("key").alias("key")).orderBy("key").limit(30)
    return u.select("id", F.row_number().over(Window.orderBy("key")).alias("place"))


@query("srt12_hash_sample", "SELECT event_id FROM events ORDER BY md5(event_id::VARCHAR), event_id LIMIT 100")
def srt12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id").orderBy(F.md5(F.col("event_id").cast("string").cast("binary")), "event_id").limit(100)


@query("set01_union_all", "SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS amount, NULL::VARCHAR AS note FROM orders UNION ALL SELECT 'event', event_id, value, event_type FROM events")
def set01(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    e = read(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("value").alias("amount"), F.col("event_type").alias("note"))
    return o.unionByName(e, allowMissingColumns=True)


@query("set02_union_distinct", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def set02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).union(read(spark, sf_dir, "customer").select("c_nationkey")).distinct()


@query("prj01_json_paths", "SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.k') IS NOT NULL AS has_k, len(json_keys(props))::INTEGER AS n_keys FROM events")
def prj01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.k").isNotNull().alias("has_k"), F.size(F.json_object_keys("props")).alias("n_keys"))


@query("prj09_coalesced_dates", f"WITH {MEMBERSHIPS_SQL} SELECT member_id, coalesce(starts_on, ends_on, 9000) AS observed_on, CASE WHEN starts_on IS NOT NULL THEN 'start' WHEN ends_on IS NOT NULL THEN 'end' ELSE 'default' END AS basis FROM memberships")
def prj09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memberships(spark, sf_dir).select("member_id", F.coalesce("starts_on", "ends_on", F.lit(9000)).alias("observed_on"), F.when(F.col("starts_on").isNotNull(), "start").when(F.col("ends_on").isNotNull(), "end").otherwise("default").alias("basis"))


@query("prj12_patterns", "SELECT p_partkey FROM part WHERE p_name ILIKE '%a%' AND p_type LIKE '%S%' AND regexp_matches(p_brand, '^Brand#[1-3]')")
def prj12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where(F.col("p_name").ilike("%a%") & F.col("p_type").like("%S%") & F.col("p_brand").rlike("^Brand#[1-3]")).select("p_partkey")


@query("prj14_guarded_cast", r"SELECT s_suppkey, CASE WHEN regexp_matches(replace(s_name, 'Supplier#', ''), '^[0-9]{1,9}$') THEN replace(s_name, 'Supplier#', '')::INTEGER END AS number FROM supplier")
def prj14(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.replace(F.col("s_name"), F.lit("Supplier#"), F.lit(""))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.when(digits.rlike("^[0-9]{1,9}$"), digits.try_cast("int")).alias("number"))


@query("prj15_least_greatest", f"WITH {MEMBERSHIPS_SQL} SELECT member_id, least(starts_on, ends_on) AS low, greatest(starts_on, ends_on) AS high FROM memberships")
def prj15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memberships(spark, sf_dir).select("member_id", F.least("starts_on", "ends_on").alias("low"), F.greatest("starts_on", "ends_on").alias("high"))


@query("fn26_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, (make_date(year(o_orderdate)::INT, 1, 1) - DATE '1970-01-01')::INTEGER AS year_start, (last_day(o_orderdate::DATE) - DATE '1970-01-01')::INTEGER AS month_end FROM orders")
def fn26(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.unix_date(F.make_date(F.year(d), F.lit(1), F.lit(1))).alias("year_start"), F.unix_date(F.last_day(d)).alias("month_end"))


@query("fn27_guarded_percent", "WITH c AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS b FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, CASE WHEN a + b > 0 THEN round(100.0::DOUBLE * a / (a + b), 2) END AS percent FROM c")
def fn27(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_returnflag") == "N").alias("b"))
    return c.select("l_suppkey", F.when(F.col("a") + F.col("b") > 0, F.round(100.0 * F.col("a") / (F.col("a") + F.col("b")), 2)).alias("percent"))


@query("fn37_byte_helpers", "SELECT doc_id, octet_length(encode(text))::INTEGER AS bytes, left(text, 8) AS head, upper(lang) AS lang FROM documents")
def fn37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("bytes"), F.left("text", F.lit(8)).alias("head"), F.upper("lang").alias("lang"))
