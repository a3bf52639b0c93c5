"""Statements, positions and speeches (FN-35, FN-38): sentences of many events planted in one text, each far from the next, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import statements as S
from ..sources.tables import read
from .parsers import planted
from .registry import query

#: Digits of the largest event ids, which are bills' numbers here.
DIGITS = 19
#: Longer than a window, and without words that matter.
FILLER = " Then the clerk read out a list of other things." * 6 + "\n"


def sentences(spark: SparkSession, sf_dir: str, forms: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """id and text: the sentences of twelve events, each in the form of its number; {i} is the number, {x} what more has under x."""
    i = F.col("event_id")
    text = F.get(F.array(*map(F.lit, forms)), (i % len(forms)).cast("int"))
    for name, value in ({"i": i.cast("string")} | (more or {})).items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    rows = read(spark, sf_dir, "events").select(F.expr("event_id div 12").alias("id"), "event_id", F.concat(text, F.lit(FILLER)).alias("t"))
    return planted(rows, ["id"], "event_id", F.col("t"), "Notes.\n").withColumnRenamed("doc", "text")


ON_BILLS = [
    "Sen. Doe will vote no on HF{i}.", "Senator Ann Doe backed H.F. No. {i} today.", "I support House File {i}.", "We cannot support S. F. No. {i}!", "Sen. Roe supports SF{i}.", "I support HF{i} and oppose nothing.",
    "Rep. Doe endorses S F {i}. I support HF{i}.", "Sen. Doe supports SF{i}." + FILLER + "Sen. Doe, as said, supports SF{i}.", "Doe supports HF{i}.", "I read HF{i}.",
]


@query(
    "fn38_explicit_statements",
    """WITH e AS (SELECT event_id AS i, event_id // 12 AS id, event_id % 10 AS form FROM events)
SELECT id, CASE WHEN form IN (0, 1, 2) THEN 'HF' ELSE 'SF' END || i AS bill, CASE WHEN form IN (0, 3) THEN 'opposes' ELSE 'supports' END AS stance FROM e WHERE form IN (0, 1, 2, 3, 6, 7)""",
)
def fn38(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a member's texts say for or against bills: every mention in a window of its own."""
    return S.bill_statements(sentences(spark, sf_dir, ON_BILLS).withColumn("name", F.lit("Ann Döe")), digits=DIGITS).select("id", "bill", "stance")


ON_ISSUES = ["I support better schools in {i} towns.", "Senator Doe opposes the property tax of {i}.", "We will fight to keep {i} hospital doors open.", "My top priority is clean energy and police in {i}.", "My top priority is affordable housing in {i}.", "Nobody there spoke on transit in {i}.", "I like schools {i}", "I support and oppose the union plan {i}."]


@query(
    "fn35_issue_positions",
    """WITH e AS (SELECT event_id AS i, event_id // 12 AS id, event_id % 8 AS form FROM events)
SELECT id, CASE form WHEN 0 THEN 'education' WHEN 1 THEN 'taxes_revenue' WHEN 2 THEN 'health' ELSE 'housing' END AS family, CASE form WHEN 0 THEN 'explicit_support' WHEN 1 THEN 'explicit_opposition' WHEN 2 THEN 'promise_action' ELSE 'priority_statement' END AS commitment,
       CASE form WHEN 0 THEN 'supports' WHEN 1 THEN 'opposes' ELSE 'unclear' END AS stance,
       CASE form WHEN 0 THEN 'I support better schools in ' || i || ' towns.' WHEN 1 THEN 'Senator Doe opposes the property tax of ' || i || '.' WHEN 2 THEN 'We will fight to keep ' || i || ' hospital doors open.' ELSE 'My top priority is affordable housing in ' || i || '.' END AS sentence
FROM e WHERE form IN (0, 1, 2, 4)""",
)
def fn35_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that bind a member to one family of issues."""
    return S.issue_positions(sentences(spark, sf_dir, ON_ISSUES).withColumn("name", F.lit("Ann Doe"))).select("id", "family", "commitment", "stance", "sentence")


ON_SPEECHES = ["{title} {last} said HF{i} deserves support.", "Ann {full} argued against HF{i}.", "{other} {last} said HF{i} deserves support.", "{title} Bo C. {last} spoke on HF{i}.", "{title} {last} likes HF{i}."]


@query(
    "fn35_speeches",
    """WITH e AS (SELECT event_id AS i, event_id // 12 AS id, event_id % 5 AS form, event_id % 25 AS member FROM events)
SELECT id, 'HF' || i AS bill, member, CASE form WHEN 0 THEN 'supports' WHEN 1 THEN 'opposes' ELSE 'unclear' END AS stance FROM e WHERE form IN (0, 1, 3)""",
)
def fn35_speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members who spoke on bills, met by surname and verified by pattern."""
    nation = read(spark, sf_dir, "nation")
    members = nation.select(F.col("n_nationkey").cast("long").alias("member"), F.concat(F.lit("Ann "), F.initcap("n_name")).alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "house").otherwise("senate").alias("chamber"))
    names = {r["n_nationkey"]: r["n_name"].title() for r in nation.select("n_nationkey", "n_name").collect()}  # 25 rows, to write the texts with
    k = (F.col("event_id") % 25).cast("int")
    pick = lambda f: F.get(F.array(*(F.lit(f(names[j])) for j in range(25))), k)
    title = lambda even: F.when((k % 2 == 0) == even, "Rep.").otherwise("Senator")
    docs = sentences(spark, sf_dir, ON_SPEECHES, {"full": pick(str), "last": pick(lambda n: n.split()[-1]), "title": title(True), "other": title(False)})
    return S.speeches(docs, members, digits=DIGITS).select("id", "bill", "member", "stance")
