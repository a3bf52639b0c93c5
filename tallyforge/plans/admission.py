"""Admission of evidence, and the rows of the survey that others had in part (PRJ-19, PRJ-21, FN-12, MDL-14, MDL-23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import admission as A
from ..functions import policy as B
from ..functions import text as T
from ..functions.numeric import clamp
from ..functions.similarity import jaccard, with_design
from ..operators.asof import strict_prior
from ..sources.tables import read
from .histories import DESIGNS, TOLD
from .rates import FORECAST_SQL, forecasts
from .registry import query
from .texts import TITLE_SQL, jac

GOOD, OLD, NEW = "ab" * 32, "2024-01-05T00:00:00Z", "2024-03-01T10:00:00Z"


def planted(forms: list[dict], schema: str) -> Column:
    """The form of an event's number as a struct; fields that a form doesn't give are null."""
    names = [x.split()[0] for x in schema.split(", ")]
    rows = [F.struct(*(F.lit(form.get(n)).cast(kind).alias(n) for n, kind in (x.split() for x in schema.split(", ")))) for form in forms]
    assert all(set(form) <= set(names) for form in forms)
    return F.get(F.array(*rows), (F.col("event_id") % len(forms)).cast("int"))


PROOF = {"canonical_url": "https://x.example", "content_sha256": GOOD, "available_at": OLD}
PROOFS = [
    (PROOF | {"proof": "official_publication_timestamp", "published_at": OLD}, ""),
    (PROOF | {"proof": "independent_archive_capture", "archive_url": "HTTPS://a.example", "captured_at": "2024-01-05T01:00:00+01:00"}, ""),
    (PROOF | {"proof": "independent_archive_capture", "archive_url": "http://a.example", "captured_at": NEW}, "archive capture requires https archiveUrl|archive availableAt must equal capturedAt"),
    (PROOF | {"proof": "independent_archive_capture", "captured_at": ""}, "archive capture requires https archiveUrl|archive capture requires capturedAt"),
    (PROOF | {"proof": "official_publication_timestamp"}, "official publication requires publishedAt"),
    (PROOF | {"proof": "publisher_page_metadata", "published_at": NEW, "canonical_url": "http://x"}, "canonicalUrl must be https|publisher metadata availableAt cannot precede publishedAt"),
    (PROOF | {"proof": "publisher_page_metadata", "published_at": "soon"}, "publishedAt must be a valid timestamp"),
    (PROOF | {"proof": "regulatory_filing_or_disclosure_timestamp", "filing_at": NEW}, "regulatory availableAt cannot precede filingAt"),
    (PROOF | {"proof": "regulatory_filing_or_disclosure_timestamp", "filing_at": OLD}, ""),
    ({"proof": "regulatory_filing_or_disclosure_timestamp", "available_at": "never"}, "canonicalUrl must be https|contentSha256 must be sha256|availableAt must be a valid timestamp|regulatory disclosure requires filingAt"),
    ({}, "canonicalUrl must be https|contentSha256 must be sha256|availableAt must be a valid timestamp"),
]
CUTOFF = "2024-02-01"


def case_sql(values: list[str | None]) -> str:
    return f"CASE event_id % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + " END"


@query("prj21_availability_errors", f"SELECT event_id, {case_sql([e for _, e in PROOFS])} AS errors, event_id % {len(PROOFS)} IN (0, 1, 8) AS available FROM events")
def prj21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that can be wrong with a proof of when something was public, and whether it was before a cutoff."""
    row = planted([f for f, _ in PROOFS], "proof string, available_at string, canonical_url string, archive_url string, captured_at string, published_at string, filing_at string, content_sha256 string")
    e = read(spark, sf_dir, "events").select("event_id", row.alias("row"))
    return e.select("event_id", F.array_join(A.availability_errors(F.col("row")), "|").alias("errors"), A.available_before(F.col("row"), F.lit(CUTOFF).cast("timestamp")).alias("available"))


FILED = {"source_hash": GOOD, "subtype": "candidate_contribution_record", "filer": "12345", "row_key": GOOD, "year": "2023", "available_on": "2024-01-31"}
SITE = {"source_hash": GOOD, "website": True, "extraction": A.EXTRACTION, "excerpt": "words", "actionable": False, "eligible": True, "index_proof": A.INDEX_PROOF, "archive_proof": A.ARCHIVE_PROOF, "observed_at": OLD, "captured_at": OLD, "published_at": "2024-01-05T00:00:00+00:00", "cdx_sha1": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"}
HOLD = ("context", None, "WEBSITE_LITERAL_SOURCE_OR_CLOCK_HOLD")
USES = [
    ({"source_hash": "bad"} | {"fetched_at": OLD}, ("context", None, "INVALID_SOURCE_IDENTITY")),
    (FILED, ("historical_finance_research", "2024-01-31", None)),
    (FILED | {"available_on": "2024-02-01"}, ("context", None, "FINANCE_EXACT_ROW_PUBLICATION_UNPROVED")),
    (FILED | {"subtype": "independent_expenditure_record"}, ("context", None, "MISSING_CANONICAL_TRANSACTION_IDENTITY")),
    (FILED | {"subtype": "independent_expenditure_record", "spender": "777", "website": True}, ("historical_finance_research", "2024-01-31", None)),
    (FILED | {"year": "1999"}, ("context", None, "MISSING_CANONICAL_TRANSACTION_IDENTITY")),
    (SITE, ("website_text_research", OLD, None)),
    (SITE | {"observed_at": NEW, "captured_at": NEW, "published_at": NEW}, HOLD), (SITE | {"actionable": None}, HOLD), (SITE | {"cdx_sha1": "abc"}, HOLD), (SITE | {"captured_at": NEW}, HOLD), (SITE | {"excerpt": ""}, HOLD),
    ({"source_hash": GOOD, "fetched_at": OLD}, ("context", OLD, "CONTEXT_ONLY_NO_DIRECTIONAL_ADMISSION")),
    ({"source_hash": GOOD, "fetched_at": NEW, "website": False}, ("context", None, "OBSERVED_AFTER_CUTOFF")),
    ({"source_hash": GOOD}, ("context", None, "OBSERVED_AFTER_CUTOFF")),
]


@query("prj19_evidence_use", f"SELECT event_id, {', '.join(f'{case_sql([u[i] for _, u in USES])} AS {n}' for i, n in enumerate(('allowed_use', 'available_at', 'reason')))} FROM events")
def prj19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What evidence may be used for as of a cutoff: finance records, texts of websites, and context."""
    schema = "source_hash string, subtype string, filer string, spender string, row_key string, year string, available_on string, extraction string, excerpt string, index_proof string, archive_proof string, observed_at string, captured_at string, published_at string, cdx_sha1 string, fetched_at string, website boolean, actionable boolean, eligible boolean"
    row = planted([f for f, _ in USES], schema)
    e = read(spark, sf_dir, "events").select("event_id", row.alias("row"))
    return e.select("event_id", A.evidence_use(F.col("row"), F.lit(CUTOFF).cast("timestamp")).alias("use")).select("event_id", "use.*")


#: Places of the parts of a design in what is told of the planted texts.
PARTS = (2, 3, 4, 5, 6, 10)


def agreement(i: int, j: int) -> str:
    a, b = TOLD[i], TOLD[j]
    return "NULL" if a is None or b is None else f"{sum(a[k] == b[k] for k in PARTS)} / 6.0"


@query(
    "fn12_design_blend",
    f"""WITH d AS (SELECT doc_id, list_distinct({TITLE_SQL.format("left(text, 60)")}) AS k FROM documents),
p AS (SELECT a.doc_id, {jac("k")} AS s, CASE a.doc_id % 7 {" ".join(f"WHEN {i} THEN {agreement(i, (i + 1) % 7)}" for i in range(7))} END AS g FROM d a JOIN d b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(CASE WHEN g IS NULL OR s = 1 THEN s ELSE 0.7 * s + 0.3 * g END, 6) AS similarity FROM p""",
)
def fn12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each document to the next, blended with that of their (planted) designs where both have one."""
    bill = F.get(F.array(*map(F.lit, DESIGNS)), (F.col("doc_id") % 7).cast("int"))
    own = B.design(F.substring_index(bill, "|", 1), F.when(bill.contains("|"), F.substring_index(bill, "|", -1)))
    d = read(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.title_tokens(F.left("text", F.lit(60)))).alias("k"), own.alias("design"))
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("k").alias("other_k"), F.col("design").alias("other"))
    return d.join(b, "doc_id").select("doc_id", F.round(with_design(jaccard(F.col("k"), F.col("other_k")), F.col("design"), F.col("other")), 6).alias("similarity"))


# The prior and least support of a rate, and the share of its distance from the whole that shifts a forecast.
CONTEXT_PRIOR, LEAST_EVENTS, BLEND = 12, 5, 0.5


@query(
    "mdl14_context_shift",
    f"""WITH {FORECAST_SQL},
e AS (SELECT event_id, day, o_orderstatus AS chamber, avg(outcome) AS share, unnest(['priority:' || o_orderpriority, 'bucket:' || (o_custkey % 4)]) AS key FROM forecast JOIN orders ON event_id = o_orderkey GROUP BY event_id, day, o_orderstatus, o_orderpriority, o_custkey),
o AS (SELECT DISTINCT event_id, day, chamber, share FROM e),
g AS (SELECT chamber, day, sum(sum(share)) OVER w AS s, sum(count(*)) OVER w AS n FROM o GROUP BY chamber, day WINDOW w AS (PARTITION BY chamber ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT chamber, key, day, sum(sum(share)) OVER w AS s, sum(count(*)) OVER w AS n FROM e GROUP BY chamber, key, day WINDOW w AS (PARTITION BY chamber, key ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT e.event_id, g.s / g.n AS whole, sum(ln(1 + f.n) * (f.s + {CONTEXT_PRIOR} * (g.s / g.n)) / (f.n + {CONTEXT_PRIOR})) FILTER (WHERE f.n >= {LEAST_EVENTS}) / sum(ln(1 + f.n)) FILTER (WHERE f.n >= {LEAST_EVENTS}) AS context
  FROM e JOIN g USING (chamber, day) JOIN f USING (chamber, key, day) WHERE g.n > 0 GROUP BY e.event_id, g.s, g.n)
SELECT event_id, round(any_value(coalesce({BLEND} * (context - whole), 0)), 6) AS shift, round(sum(CASE WHEN context IS NULL THEN p ELSE least(0.995, greatest(0.005, p + {BLEND} * (context - whole))) END), 6) AS expected_yes
FROM forecast LEFT JOIN c USING (event_id) GROUP BY event_id""",
)
def mdl14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of an event's members shifted by what its process is known for: strictly prior shares of yes by key, drawn to the chamber's and weighed by how much is known of each."""
    f = forecasts(spark, sf_dir)
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("chamber"), F.concat(F.lit("priority:"), "o_orderpriority").alias("a"), F.concat(F.lit("bucket:"), F.col("o_custkey") % 4).alias("b"))
    e = f.groupBy("event_id", "day").agg(F.avg("outcome").alias("share")).join(o, "event_id")
    e = strict_prior(e, ["chamber"], {"g_sum": F.col("share"), "g_n": F.lit(1)})
    k = e.select("event_id", "chamber", "day", "share", "g_sum", "g_n", F.explode(F.array("a", "b")).alias("key"))
    k = strict_prior(k, ["chamber", "key"], {"k_sum": F.col("share"), "k_n": F.lit(1)}).where("g_n > 0")
    whole = F.col("g_sum") / F.col("g_n")
    weight = F.when(F.col("k_n") >= LEAST_EVENTS, F.log1p(F.col("k_n").cast("double")))
    rate = (F.col("k_sum") + CONTEXT_PRIOR * whole) / (F.col("k_n") + CONTEXT_PRIOR)
    c = k.groupBy("event_id").agg((BLEND * (F.sum(weight * rate) / F.sum(weight) - F.max(whole))).alias("shift"))
    shifted = F.when(F.col("shift").isNull(), F.col("p")).otherwise(clamp(F.col("p") + F.col("shift"), 0.005, 0.995))
    return f.join(c, "event_id", "left").groupBy("event_id").agg(F.round(F.coalesce(F.max("shift"), F.lit(0.0)), 6).alias("shift"), F.round(F.sum(shifted), 6).alias("expected_yes"))


@query(
    "mdl23_district_features",
    """WITH v AS (SELECT l_partkey % 1500 AS district, l_suppkey AS candidate, sum(l_quantity)::BIGINT AS votes FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY votes DESC, candidate) AS k FROM v)
SELECT district, round(100.0 * (max(votes) - coalesce(max(votes) FILTER (WHERE k = 2), 0)) / sum(votes), 6) AS margin, round(ln(1 + sum(votes)), 6) AS log_votes, round(ln(1 + count(*)), 6) AS log_candidates, (count(*) = 1)::INTEGER AS uncontested FROM r GROUP BY district""",
)
def mdl23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin of the first two, votes, candidates and whether there was but one, of each district."""
    v = read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 1500).alias("district"), F.col("l_suppkey").alias("candidate")).agg(F.sum("l_quantity").cast("long").alias("votes"))
    # Two aggregates tell the second: the votes of the first are taken out of the best two.
    top = v.groupBy("district").agg(F.max("votes").alias("first"), F.max_by("candidate", F.struct("votes", -F.col("candidate"))).alias("winner"), F.sum("votes").alias("all"), F.count("*").alias("n"))
    second = v.join(top.select("district", "winner"), "district").where("candidate <> winner").groupBy("district").agg(F.max("votes").alias("second"))
    m = top.join(second, "district", "left")
    margin = 100.0 * (F.col("first") - F.coalesce("second", F.lit(0))) / F.col("all")
    log1p = lambda c: F.round(F.log1p(F.col(c).cast("double")), 6)
    return m.select("district", F.round(margin, 6).alias("margin"), log1p("all").alias("log_votes"), log1p("n").alias("log_candidates"), (F.col("n") == 1).cast("int").alias("uncontested"))
