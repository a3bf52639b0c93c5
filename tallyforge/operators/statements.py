"""Statements on bills, positions on issues, and speeches, from running text.

Every mention of a bill has a window of its own, cut out of the text around it, in which stance, bill and speaker are matched by their places.  A text with many mentions is taken apart once; no
window looks the text through again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_ascii
from .segmentation import segmented

#: The ways a bill is written, and the most digits of its number unless told otherwise.
MENTION = r"(?i:\b(?:[HS]F|[HS]\s*\.?\s*F\s*\.?|(?:House|Senate)\s+File)\s*(?:No\.?\s*)?\d(?:\s*\d){0,%d}\b)"
DIGITS = 6
#: Words of a stance on a bill.
SUPPORT = r"(?i)\b(?:support(?:s|ed|ing)?|back(?:s|ed|ing)?|endorse(?:s|d|ment)?|vote(?:d|s|ing)?\s+(?:yes|aye|for)|vote(?:d|s|ing)?\s+in\s+favor(?:\s+of)?|vote(?:d|s|ing)?\s+to\s+pass|will\s+vote\s+(?:yes|aye|for))\b"
DENIED = r"(?i)\b(?:(?:do|does|did)\s+not\s+support|(?:cannot|can't|won't|wouldn't)\s+support|will\s+not\s+support|will\s+not\s+vote\s+for|(?:cannot|can't|won't|wouldn't)\s+vote\s+for)\b"
OPPOSE = r"(?i)\b(?:oppose(?:s|d|ing)?|against|reject(?:s|ed|ing)?|vote(?:d|s|ing)?\s+(?:no|nay|against)|will\s+vote\s+(?:no|nay|against))\b"
#: Characters around a mention, and the most between stance and bill, and stance and speaker.
WINDOW, REACH = 180, 120
#: Words of a speech about a bill, and characters around its mention.
SPEECH = r"(?i)\b(?:said|stated|argued|urged|told|called\s+for|spoke|explained|asked|responded)\b"
SPEECH_FOR = r"(?i)\b(?:support(?:s|ed|ing)?|back(?:s|ed|ing)?|urge(?:s|d|ing)?\s+(?:passage|a\s+yes\s+vote)|vote\s+(?:yes|aye|for)|in\s+favor\s+of)\b"
SPEECH_AGAINST = r"(?i)\b(?:oppose(?:s|d|ing)?|against|reject(?:s|ed|ing)?|urge(?:s|d|ing)?\s+(?:rejection|a\s+no\s+vote)|vote\s+(?:no|nay|against))\b"
SPEECH_WINDOW = 220
#: Families of issues, and words that bind a speaker to one.
FAMILIES = {
    "education": r"(?i)\b(?:education|schools?|teachers?|students?|colleges?|universit(?:y|ies)|tuition|literacy)\b",
    "health": r"(?i)\b(?:health(?:\s*care)?|hospital|patient|pharmacy|medicaid|mncare|insurance coverage|medical (?:care|costs?|coverage|treatment|services?))\b",
    "human_services": r"(?i)\b(?:human services|child care|childcare|disabilit(?:y|ies)|foster care|public assistance|long-term care)\b",
    "taxes_revenue": r"(?i)\b(?:tax(?:es|ation)?|revenue|tax credit|deduction|exemption|property tax)\b",
    "public_safety": r"(?i)\b(?:public safety|police|law enforcement|crime|criminal|correction|firearm|gun|violence)\b",
    "housing": r"(?i)\b(?:housing|tenant|landlord|rent|residential|homeownership|homelessness)\b",
    "transportation": r"(?i)\b(?:transportation|highway|road|transit|vehicle|driver|bridge|rail)\b",
    "environment_natural_resources": r"(?i)\b(?:environment|natural resources|water|climate|pollution|wetland|clean energy|renewable energy)\b",
    "labor_employment": r"(?i)\b(?:labor|employment|employer|employee|worker|wage|workplace|paid leave|family leave|medical leave|union)\b",
    "elections": r"(?i)\b(?:election|ballot|voter|voting|campaign finance|redistricting)\b",
    "agriculture": r"(?i)\b(?:agriculture|farm|farmer|crop|livestock|rural development)\b",
    "commerce_consumer": r"(?i)\b(?:commerce|consumer|business|insurance|licens(?:e|ing)|small business|banking)\b",
    "local_government": r"(?i)\b(?:local government|county|municipal|municipality|township|city government)\b",
    "judiciary_civil_law": r"(?i)\b(?:judiciary|court|judge|civil law|attorney|legal system|lawsuit)\b",
    "state_government": r"(?i)\b(?:state government|state agency|department|commission|government accountability|state budget)\b",
}
FIRST_PERSON = r"(?i)\b(?:i|we|my|our)\b"
FAVORS = r"(?i)\b(?:support|back|favor|endorse)(?:s|ed|ing)?\b"
RESISTS = r"(?i)\b(?:oppose|reject)(?:s|d|ing)?\b"
PROMISES = r"(?i)\b(?:i|we)\s+(?:will|pledge\s+to|promise\s+to|am\s+committed\s+to|are\s+committed\s+to|commit\s+to)\b"
PRIORITIZES = r"(?i)\b(?:my|our)\s+(?:top\s+)?priorit(?:y|ies)\b|\b(?:i|we)\s+(?:will\s+)?(?:fight|work)\s+to\b"
SHORTEST, LONGEST = 18, 900


def blank(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def surname(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), r"\s+"), -1)


def quoted(text: Column) -> Column:
    """A pattern that matches text itself."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def attribution(name: Column) -> Column:
    """A pattern for the first person, or for the title and surname of name, its parts joined by hyphens, blanks or nothing."""
    parts = F.filter(F.split(plain_ascii(surname(name)), r"[^a-z0-9]+"), lambda p: p != "")
    last = F.when(F.size(parts) > 0, F.array_join(parts, r"[-\s]?")).otherwise(r"[^\s\S]")
    return F.concat(F.lit(r"(?i)\b(?:i|we|(?:rep(?:resentative)?|sen(?:ator)?)\.?\s+(?:[a-z][a-z'.-]*\s+){0,3}"), last, F.lit(r")\b"))


def mentions(docs: DataFrame, text: str, window: int, digits: int = DIGITS) -> DataFrame:
    """docs without text (its other columns must tell texts apart), with at, bill (HF12) and excerpt for every mention: the mention and window characters on either side, white space
    squeezed; bill_at: where it stands there, from 0; raw: the mention as there."""
    keys = [c for c in docs.columns if c != text]
    own = Window.partitionBy(*keys).orderBy("at")
    s = segmented(docs, text, {"bill": MENTION % (digits - 1)})
    # A mention has three characters at least, so no window holds more pieces than this.
    near = window // 3 + 1
    tails = F.collect_list(F.right(F.concat("anchor", "body"), F.lit(window))).over(own.rowsBetween(-near, -1))
    heads = F.collect_list(F.left(F.concat("anchor", "body"), F.lit(window))).over(own.rowsBetween(1, near))
    s = s.withColumn("left", F.right(F.array_join(tails, ""), F.lit(window))).withColumn("right", F.left(F.concat("body", F.array_join(heads, "")), F.lit(window))).where("at > 0")
    left, raw = F.ltrim(blank(F.col("left"))), blank(F.col("anchor"))
    chamber = F.when(F.col("anchor").rlike(r"(?i)^h"), "HF").otherwise("SF")
    number = F.regexp_replace(F.regexp_extract("anchor", r"(\d[\d\s]*)$", 1), r"\s", "")
    return s.select(*keys, "at", F.concat(chamber, number).alias("bill"), F.length(left).alias("bill_at"), raw.alias("raw"), F.concat(left, raw, F.rtrim(blank(F.col("right")))).alias("excerpt"))


def place(text: Column, pattern: Column | str) -> Column:
    """Where pattern is first found, from 0; -1 if nowhere."""
    return F.regexp_instr(text, F.lit(pattern) if isinstance(pattern, str) else pattern) - 1


def found(text: Column, pattern: Column | str) -> Column:
    return F.regexp_substr(text, F.lit(pattern) if isinstance(pattern, str) else pattern)


def bill_statements(docs: DataFrame, text: str = "text", name: str = "name", digits: int = DIGITS) -> DataFrame:
    """docs without text (its other columns must tell texts apart), with bill, stance and excerpt: what a text of a member (name) says for or against a bill, each bill and stance once, by its
    first mention.

    A mention counts if its window holds words of one stance (support that is denied opposes) and the member in the first person or by title and surname, the stance within REACH of both, and
    the three stand in one sentence.  A window with both stances says nothing.
    """
    keys = [c for c in docs.columns if c != text]
    m = mentions(docs, text, WINDOW, digits)
    e = F.col("excerpt")
    m = m.select("*", place(e, DENIED).alias("no_at"), F.length(found(e, DENIED)).alias("no_n"), place(e, SUPPORT).alias("for_at"), F.length(found(e, SUPPORT)).alias("for_n"), place(e, OPPOSE).alias("against_at"), F.length(found(e, OPPOSE)).alias("against_n"), attribution(F.col(name)).alias("who"))
    # Support inside a denial is no support; a denial opposes unless other words do.
    inside = (F.col("no_at") >= 0) & (F.col("for_at") >= F.col("no_at")) & (F.col("for_at") < F.col("no_at") + F.col("no_n"))
    m = m.withColumn("for_at", F.when(inside, -1).otherwise(F.col("for_at")))
    denied = (F.col("against_at") < 0) & (F.col("no_at") >= 0)
    m = m.withColumn("against_n", F.when(denied, F.col("no_n")).otherwise(F.col("against_n"))).withColumn("against_at", F.when(denied, F.col("no_at")).otherwise(F.col("against_at")))
    m = m.where((F.col("for_at") >= 0) != (F.col("against_at") >= 0)).withColumn("supports", F.col("for_at") >= 0)
    m = m.withColumn("stance_at", F.greatest("for_at", "against_at")).withColumn("stance_n", F.when(F.col("supports"), F.col("for_n")).otherwise(F.col("against_n")))
    m = m.withColumn("who_at", place(e, F.col("who"))).withColumn("who_n", F.length(found(e, F.col("who")))).where("who_at >= 0")
    m = m.where((F.abs(F.col("stance_at") - F.col("bill_at")) <= REACH) & (F.abs(F.col("who_at") - F.col("stance_at")) <= REACH))
    begin = F.least("bill_at", "stance_at", "who_at")
    end = F.greatest(F.col("bill_at") + F.length("raw"), F.col("stance_at") + F.col("stance_n"), F.col("who_at") + F.col("who_n"))
    span = F.regexp_replace(F.substr("excerpt", begin + 1, end - begin), r"(?i)\b[HS]\s*\.\s*F\s*\.\s*(?:No\.)?", "BILL")
    m = m.where(~F.regexp_replace(span, r"(?i)\b(Sen|Rep)\.\s+", "$1").rlike(r"[.!?]\s+[A-Z]"))
    stance = F.when(F.col("supports"), "supports").otherwise("opposes")
    return m.groupBy(*keys, "bill", stance.alias("stance")).agg(F.min_by("excerpt", "at").alias("excerpt"))


def issue_positions(docs: DataFrame, text: str = "text", name: str = "name") -> DataFrame:
    """docs without text, with sentence, family, commitment and stance for every sentence of 18 to 900 characters that speaks in the first person or names the member's surname, is of
    exactly one family of issues, and commits to something: support, opposition, a promise or a priority (these two with stance unclear)."""
    sentences = F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("\n")), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(blank(s)))
    s = docs.select(*(c for c in docs.columns if c != text), F.explode(sentences).alias("sentence")).where(F.length("sentence").between(SHORTEST, LONGEST))
    x = F.col("sentence")
    last = F.regexp_replace(surname(F.col(name)), r"[^\p{L}'-]", "")
    named = F.when(last != "", F.regexp_like(x, F.concat(F.lit(r"(?i)\b"), quoted(last), F.lit(r"\b"))))
    families = F.filter(F.array(*(F.when(x.rlike(p), f) for f, p in FAMILIES.items())), lambda f: f.isNotNull())
    s = s.where(x.rlike(FIRST_PERSON) | F.coalesce(named, F.lit(False))).withColumn("families", families).where("size(families) = 1")
    favors, resists = x.rlike(FAVORS), x.rlike(RESISTS)
    commitment = F.when(favors & ~resists, "explicit_support").when(resists & ~favors, "explicit_opposition").when(x.rlike(PROMISES), "promise_action").when(x.rlike(PRIORITIZES), "priority_statement")
    s = s.withColumn("family", F.col("families")[0]).drop("families").withColumn("commitment", commitment).where("commitment IS NOT NULL")
    return s.withColumn("stance", F.when(F.col("commitment") == "explicit_support", "supports").when(F.col("commitment") == "explicit_opposition", "opposes").otherwise("unclear"))


def speeches(docs: DataFrame, members: DataFrame, text: str = "text", digits: int = DIGITS) -> DataFrame:
    """docs without text (its other columns must tell texts apart), with bill, member, stance and excerpt: members (member, name, chamber) who stand by full name, or by their chamber's title and
    surname, in the window of a bill's mention that tells of a speech.  Each member, bill, stance and excerpt once.

    Windows meet members by an equality join on the surname's last word; the patterns then decide.  A window with both stances or none is unclear.
    """
    keys = [c for c in docs.columns if c != text]
    m = mentions(docs, text, SPEECH_WINDOW, digits).withColumn("excerpt", F.left("excerpt", F.lit(700))).where(F.col("excerpt").rlike(SPEECH))
    e = F.col("excerpt")
    supports, opposes = e.rlike(SPEECH_FOR), e.rlike(SPEECH_AGAINST)
    m = m.withColumn("stance", F.when(supports == opposes, "unclear").when(supports, "supports").otherwise("opposes"))
    word = lambda t: F.element_at(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), -1)
    m = m.withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("excerpt"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))))
    people = members.where(F.lower("name").rlike(r"[\p{L}\p{N}]")).select("member", "name", "chamber", word(F.col("name")).alias("word"))
    full = F.array_join(F.transform(F.split(F.trim("name"), r"\s+"), quoted), r"\s+")
    title = F.when(F.col("chamber") == "house", r"(?:Rep(?:resentative)?\.?)").otherwise(r"(?:Sen(?:ator)?\.?)")
    pattern = F.concat(F.lit(r"(?i)(?:\b"), full, F.lit(r"\b|\b"), title, F.lit(r"\s+(?:[A-Z][A-Za-z'.-]*\s+){0,3}"), quoted(surname(F.col("name"))), F.lit(r"\b)"))
    met = m.join(people.withColumn("pattern", pattern), "word").where(F.regexp_like("excerpt", F.col("pattern")))
    return met.groupBy(*keys, "bill", "member", "stance", F.left("excerpt", F.lit(120)).alias("_head")).agg(F.min_by("excerpt", "at").alias("excerpt")).drop("_head")
