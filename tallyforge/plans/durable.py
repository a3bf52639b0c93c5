"""Durable histories and dossiers (STR-04, STR-06, UDF-04, FN-32, FN-33, §2.14): streams in several batches with late rows, tables that only grow, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, vector_digest
from ..operators.dossier import dossiers, section
from ..operators.ledger import Ledger, Refused
from ..sources.tables import day_number, read, scratch, votes, written
from ..streaming.histories import closed_sums, driven, running_counts, superseding, versions
from .registry import query

BATCHES = 4


def in_batches(rows: DataFrame, number: F.Column, path: str) -> DataFrame:
    """rows as a stream of one micro-batch a value of number (0 to BATCHES - 1), in that order."""
    for i in range(BATCHES):
        rows.where(number == i).repartition(1).write.parquet(f"{path}/step={i}")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/step=*")


@query(
    "str06_stream_supersession",
    """WITH e AS (SELECT event_id, user_id % 40 AS member, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS topic, ts::DATE AS fetched FROM events),
f AS (SELECT member, topic, fetched, min(event_id) AS head FROM e GROUP BY ALL), n AS (SELECT *, lead(head) OVER (PARTITION BY member, topic ORDER BY fetched) AS superseded_by FROM f)
SELECT e.event_id, n.superseded_by, n.superseded_by IS NULL AS current FROM e JOIN n ON e.member = n.member AND e.topic IS NOT DISTINCT FROM n.topic AND e.fetched = n.fetched""",
)
def str06_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of series that arrive out of order, in four batches: each is superseded by the next newer fetch, on arrival of either."""
    path = scratch(spark, "stream")
    e = read(spark, sf_dir, "events")
    rows = e.select("event_id", (F.col("user_id") % 40).alias("member"), F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("topic"), F.to_date("ts").alias("fetched"))
    stream = in_batches(rows, F.pmod(F.xxhash64("event_id"), F.lit(BATCHES)), f"{path}/in")
    driven(stream, superseding(f"{path}/table", ["member", "topic"], "fetched"), path)
    found = versions(spark, f"{path}/table", rows.schema, ["member", "topic"], "fetched", "event_id")
    return found.select("event_id", "superseded_by", F.col("superseded_by").isNull().alias("current"))


@query(
    "str04_stream_counts",
    """WITH v AS (SELECT event_id, user_id AS member, user_id % 3 AS party, ts::DATE AS day, (value >= 50)::INTEGER AS outcome FROM events),
k AS (SELECT event_id, day, outcome, unnest(['global', 'party', 'member']) AS level, unnest(['all', party::VARCHAR, member::VARCHAR]) AS key FROM v),
d AS (SELECT level, key, day, sum(outcome) AS yes, count(*) AS n FROM k GROUP BY ALL),
p AS (SELECT *, sum(yes) OVER w - yes AS before_yes, sum(n) OVER w - n AS before_n FROM d WINDOW w AS (PARTITION BY level, key ORDER BY day))
SELECT k.event_id, k.level, p.before_yes::BIGINT AS yes, p.before_n::BIGINT AS n FROM k JOIN p ON k.level = p.level AND k.key = p.key AND k.day = p.day""",
)
def str04_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all members, of a party and of a member before each row's day, kept by a stream in several batches; a last row far ahead closes the last day."""
    path = scratch(spark, "stream")
    e = read(spark, sf_dir, "events")
    at = F.to_date("ts").cast("timestamp")
    rows = e.select("event_id", F.col("user_id").alias("member"), (F.col("user_id") % 3).alias("party"), at.alias("at"), (F.col("value") >= 50).cast("int").alias("outcome"))
    first, last = rows.agg(F.min(F.unix_date(F.to_date("at"))), F.max(F.unix_date(F.to_date("at")))).first()
    if first is None:
        return rows.select("event_id", F.lit("global").alias("level"), F.lit(0).cast("long").alias("yes"), F.lit(0).cast("long").alias("n"))
    # Batches in the order of time; the mark at the end is of a day of its own.
    step = F.least(F.floor((F.unix_date(F.to_date("at")) - first) * BATCHES / (last - first + 1)), F.lit(BATCHES - 1))
    mark = spark.range(1).select(F.lit(None).cast(rows.schema["event_id"].dataType).alias("event_id"), F.lit(None).cast(rows.schema["member"].dataType).alias("member"), F.lit(None).cast(rows.schema["party"].dataType).alias("party"), F.date_from_unix_date(F.lit(last + 2)).cast("timestamp").alias("at"), F.lit(0).alias("outcome"))
    stream = in_batches(rows.unionByName(mark), step, f"{path}/in")
    levels = {"global": F.lit("all"), "party": F.col("party"), "member": F.col("member")}
    driven(closed_sums(stream, levels, "at", "outcome"), running_counts(f"{path}/table"), path)
    counts = spark.read.parquet(f"{path}/table/counts/batch=*")
    each = rows.select("event_id", "at", F.explode(F.array(*(F.struct(F.lit(n).alias("level"), k.cast("string").alias("key")) for n, k in levels.items()))).alias("x")).select("event_id", "at", "x.*")
    return each.join(counts, ["level", "key", "at"]).select("event_id", "level", "yes", "n")


@query("udf04_append_only", "SELECT event_id, event_type AS status, 2 AS versions, true AS refused_change, true AS refused_writer FROM events WHERE event_id % 3 <> 2")
def udf04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of events: a second commit with repeats adds what is new, one with a changed row adds nothing, nor does one that began from an older version."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    ledger = Ledger(spark, scratch(spark, "ledger"), e.schema.simpleString()[7:-1].replace(":", " "), ["event_id"])
    seen = ledger.append(e.where("event_id % 3 = 0"))
    ledger.append(e.where("event_id % 3 <> 2"), seen)

    def refused(rows: DataFrame, version: int | None = None) -> bool:
        try:
            ledger.append(rows, version)
        except Refused:
            return True
        return False

    change = refused(e.where("event_id % 3 = 2").unionByName(e.where("event_id % 30 = 0").withColumn("event_type", F.lit("edited"))))
    writer = refused(e.where("event_id % 3 = 2"), seen)
    return ledger.rows().select("event_id", F.col("event_type").alias("status"), F.lit(len(ledger.entries())).alias("versions"), F.lit(change).alias("refused_change"), F.lit(writer).alias("refused_writer"))


@query(
    "fn32_canonical_digest",
    """SELECT event_id, sha256('{"a":{"id":' || event_id || ',"list":[{"x":1,"y":null},"q, \\"' || event_type || '\\""]},"b":' || (event_id % 7) || ',"kind":"' || event_type || '"}') AS digest, true AS same FROM events""",
)
def fn32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of nested JSON, equal for shuffled keys, blanks and spellings of numbers."""
    i, t = F.col("event_id"), F.col("event_type")
    one = F.concat(F.lit('{"kind":"'), t, F.lit('", "b": '), i % 7, F.lit('.0, "a":{"list": [{"y":null,"x":1.0}, "q, \\"'), t, F.lit('\\""], "id":'), i, F.lit("}}"))
    two = F.concat(F.lit('{"a":{"id":'), i, F.lit(',"list":[{"x":1,"y":null},"q, \\"'), t, F.lit('\\""]},"b":'), i % 7, F.lit(',"kind":"'), t, F.lit('"}'))
    digest = lambda c: F.sha2(canonical_json(c).cast("binary"), 256)
    return read(spark, sf_dir, "events").select("event_id", digest(one).alias("digest"), (digest(one) == digest(two)).alias("same"))


@query(
    "fn33_prediction_digest",
    """WITH p AS (SELECT user_id, event_id, (event_id % 997 + 1) / (1013.0::DOUBLE + user_id % 50) AS p FROM events),
t AS (SELECT user_id, event_id::VARCHAR || ':' || CASE WHEN p >= 0.1 THEN printf('%.17f', p) WHEN p >= 0.01 THEN printf('%.18f', p) WHEN p >= 0.001 THEN printf('%.19f', p) ELSE printf('%.20f', p) END AS line, event_id::VARCHAR AS id FROM p)
SELECT user_id, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY id)) AS digest FROM t GROUP BY user_id""",
)
def fn33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of vectors of chances in 17 significant digits."""
    p = (F.col("event_id") % 997 + 1).cast("double") / (F.lit(1013.0) + F.col("user_id") % 50)
    return read(spark, sf_dir, "events").withColumn("p", p).groupBy("user_id").agg(F.count("*").alias("n"), vector_digest(F.col("event_id"), F.col("p")).alias("digest"))


#: The last day that a dossier knows, the issue that it is on, and the lengths of its sections.
ASOF, ISSUE, VOTES, PEERS, EVIDENCE, SHARED = 10900, "1-URGENT", 6, 5, 4, 2


@query(
    "api_issue_dossier",
    f"""WITH v AS (SELECT l_suppkey AS member_id, l_orderkey AS event_id, n_regionkey AS party, (o_orderdate::DATE - DATE '1970-01-01')::INTEGER AS day, min((l_returnflag <> 'R')::INTEGER) AS yea
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE o_orderpriority = '{ISSUE}' AND (o_orderdate::DATE - DATE '1970-01-01') <= {ASOF} GROUP BY ALL),
g AS (SELECT event_id, party, sum(yea) AS y, count(*) - sum(yea) AS n FROM v GROUP BY ALL),
w AS (SELECT v.*, CASE WHEN y > n THEN yea = 1 WHEN n > y THEN yea = 0 END AS aligned, row_number() OVER (PARTITION BY member_id ORDER BY day DESC, event_id) AS rank FROM v JOIN g USING (event_id, party)),
p AS (SELECT a.member_id, b.member_id AS peer, count(*) AS shared, sum((a.yea = b.yea)::INTEGER)::BIGINT AS agreed FROM v a JOIN v b ON a.event_id = b.event_id AND a.member_id <> b.member_id GROUP BY ALL HAVING count(*) >= {SHARED}),
q AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY agreed / shared DESC, shared DESC, peer) AS rank FROM p),
e AS (SELECT user_id AS member_id, event_id, event_type AS kind, value >= 50 AS supports, (ts::DATE - DATE '1970-01-01')::INTEGER AS day FROM events),
s AS (SELECT *, lead(day) OVER (PARTITION BY member_id, kind, supports ORDER BY day, event_id) AS next FROM e),
x AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY day DESC, event_id DESC) AS rank FROM s WHERE day <= 19750 AND (kind = 'purchase' OR next IS NULL OR next > 19750)),
d AS (SELECT s_suppkey AS member_id,
  coalesce((SELECT string_agg('{{"event_id":' || event_id || ',"day":' || day || ',"yea":' || yea || ',"aligned":' || coalesce(aligned::VARCHAR, 'null') || '}}', ',' ORDER BY rank) FROM w WHERE w.member_id = s_suppkey AND rank <= {VOTES}), '') AS votes,
  coalesce((SELECT string_agg('{{"peer":' || peer || ',"shared":' || shared || ',"agreed":' || agreed || '}}', ',' ORDER BY rank) FROM q WHERE q.member_id = s_suppkey AND rank <= {PEERS}), '') AS peers,
  coalesce((SELECT string_agg('{{"event_id":' || event_id || ',"kind":"' || kind || '","supports":' || supports || ',"day":' || day || '}}', ',' ORDER BY rank) FROM x WHERE x.member_id = s_suppkey AND rank <= {EVIDENCE}), '') AS evidence FROM supplier)
SELECT member_id, '{{"votes":[' || votes || '],"peers":[' || peers || '],"evidence":[' || evidence || ']}}' AS document FROM d""",
)
def issue_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member's votes on an issue with the party's side, the members who vote alike, and evidence that is not superseded (statements stay), all as of a day."""
    issue = read(spark, sf_dir, "orders").where(F.col("o_orderpriority") == ISSUE).select(F.col("o_orderkey").alias("event_id"))
    v = votes(spark, sf_dir).where(F.col("day") <= ASOF).join(issue, "event_id", "left_semi")
    v = written(v.groupBy("member_id", "event_id", "party", "day").agg(F.min("outcome").alias("yea")))
    g = v.groupBy("event_id", "party").agg(F.sum("yea").alias("y"), F.count_if(F.col("yea") == 0).alias("n"))
    aligned = F.when(F.col("y") > F.col("n"), F.col("yea") == 1).when(F.col("n") > F.col("y"), F.col("yea") == 0)
    cast = section(v.join(g, ["event_id", "party"]).withColumn("aligned", aligned), "votes", [-F.col("day"), F.col("event_id")], ["event_id", "day", "yea", "aligned"], VOTES)
    other = v.select("event_id", F.col("member_id").alias("peer"), F.col("yea").alias("other"))
    alike = v.join(other, "event_id").where("peer <> member_id").groupBy("member_id", "peer").agg(F.count("*").alias("shared"), F.count_if(F.col("yea") == F.col("other")).alias("agreed")).where(F.col("shared") >= SHARED)
    peers = section(alike, "peers", [-(F.col("agreed") / F.col("shared")), -F.col("shared"), F.col("peer")], ["peer", "shared", "agreed"], PEERS)
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("member_id"), "event_id", F.col("event_type").alias("kind"), (F.col("value") >= 50).alias("supports"), day_number("ts").alias("day"))
    later = F.lead("day").over(Window.partitionBy("member_id", "kind", "supports").orderBy("day", "event_id"))
    known = e.withColumn("next", later).where("day <= 19750 AND (kind = 'purchase' OR next IS NULL OR next > 19750)")
    evidence = section(known, "evidence", [-F.col("day"), -F.col("event_id")], ["event_id", "kind", "supports", "day"], EVIDENCE)
    members = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("member_id"))
    return dossiers(members, {"votes": cast, "peers": peers, "evidence": evidence})
