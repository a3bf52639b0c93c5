"""Votes, outcomes and appointments from journals and vote pages, however many a text holds.

A text is cut at its headings, questions, tallies and lists; each tally makes an event, with the nearest earlier bill, the question before it, the lists that follow it at once
and the result after these.  An event whose lists disagree with its tally stays, and says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import text as T
from .segmentation import carried, listed_segments, number_of, segmented, squeezed, whole_text

#: How senate journals write a bill, a question, a tally, its lists, and what ends these.
BILL = r"(?i:[HS]\.?\s*F\.?\s*(?:No\.?\s*)?\d+)"
SENATE = {
    "roll": r"(?i:The roll was called,\s*and there were yeas\s+\d+\s+and nays\s+\d+, as follows:)",
    "yeas": r"(?i:Those who voted in the affirmative were:)",
    "nays": r"(?i:Those who voted in the negative were:)",
    "question": r"(?i:The question (?:was taken on|recurred on|was taken:))",
    "bill": BILL,
    "end": r"(?i:The motion|So(?:\s|,)|The amendment|RECONSIDERATION|MOTIONS|SPECIAL|MESSAGES|CALENDAR|CONSENT|GENERAL ORDERS|MEMBERS EXCUSED|ADJOURNMENT)",
}
#: Page furniture in lists of names, and lines that end a list.
FURNITURE = [r"(?i)--\s*\d+\s+of\s+\d+\s*--", r"(?i)\b\d+(?:ST|ND|RD|TH) DAY\b", r"(?i)\bJOURNAL OF THE SENATE\b", r"(?i)\[[^\]]+DAY[^\]]*\]", r"\b\d{3,5}\b"]
LIST_END = r"(?i)^(?:So the bill|The question|The roll|Those who|MOTIONS|SPECIAL|MESSAGES|CALENDAR|CONSENT|GENERAL ORDERS)"
#: Results after a roll call, the first that is found counts.
RESULTS = [
    (r"(?i)\b(?:motion|amendment)\s+(?:did\s+not\s+prevail|was\s+not\s+adopted)\b", False),
    (r"(?i)\b(?:motion\s+prevailed|amendment\s+was\s+adopted)\b", True),
    (r"(?i)\bvote\s+was\s+not\s+reconsidered\b", False),
    (r"(?i)\bvote\s+was\s+reconsidered\b", True),
    (r"(?i)\bfailed to (?:re)?pass\b", False),
    (r"(?is)\bSo,?\s+(?:the bill|the bill, as amended).{0,120}\b(?:re)?passed\b", True),
]
#: Characters in which a roll call's bill, motion and result are looked for.
BILL_REACH, MOTION_REACH, RESULT_REACH = 2600, 900, 700
VOTE_KINDS = {"passage": r"\b(?:repassage|passage|final passage)\b", "amendment": r"\bamendment\b", "motion": r"\b(?:motions?|reconsider|recall|re-refer)\b", "procedural": r"\b(?:rule|procedural|adjourn|table)\b"}


def first_number(text: Column, nth: int) -> Column:
    return F.get(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), F.lit(nth)).try_cast("long")


def canonical_bill(text: Column) -> Column:
    """HF12 for H. F. No. 012; null where there is none."""
    return F.get(P.bill_numbers(text), F.lit(0))


def names_listed(block: Column) -> Column:
    """Names of a list in columns: parted by line ends or by two blanks, without page furniture, up to a line that ends the list."""
    clean = F.replace(block, F.lit("\f"), F.lit("\n"))
    for p in FURNITURE:
        clean = F.regexp_replace(clean, p, " ")
    tokens = F.filter(F.transform(F.split(clean, r"\r?\n|\s{2,}"), lambda t: F.trim(t)), lambda t: t != "")
    stop = F.array_min(F.transform(tokens, lambda t, i: F.when(t.rlike(LIST_END), i)))
    own = F.filter(F.slice(tokens, F.lit(1), F.coalesce(stop, F.size(tokens))), lambda t: (F.length(t) <= 120) & t.rlike(r"\p{L}"))
    own = F.transform(own, lambda t: F.regexp_replace(t, r"[;.]$", ""))
    return F.filter(own, lambda t: (t != "") & (F.length(t) <= 60) & (F.size(F.split(t, r"\s+")) <= 5))


def first_of(text: Column, rules: list[tuple[str, object]]) -> Column:
    """The value of the first pattern that text has."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(v)) for p, v in rules))


def senate_roll_calls(docs: DataFrame, text: str = "doc") -> DataFrame:
    """docs' other columns (which must tell texts apart) with a row for every roll call: roll (from 1), bill, vote_kind, motion, amendment, passed, yeas, nays, yea_names, nay_names
    and names_match.

    bill: the nearest one before, within BILL_REACH characters.  motion: from the last question after the roll call before; without one, MOTION_REACH characters.  passed is null
    where no result is told before the next question.  Names beyond the stated count are none.
    """
    keys = [c for c in docs.columns if c != text]
    own = Window.partitionBy(*keys).orderBy("at")
    s = segmented(docs, text, SENATE).withColumn("roll", number_of(keys, "roll"))
    bill = carried("bill", F.struct(canonical_bill(F.col("anchor")).alias("id"), F.col("begin").alias("begin")), keys)
    s = s.withColumn("bill", bill).withColumn("last", F.lag("kind").over(own)).withColumn("last2", F.lag("kind", 2).over(own)).withColumn("gap", F.trim(F.regexp_replace(F.lag("body").over(own), r"\s", "")))
    yeas = (F.col("kind") == "yeas") & (F.col("last") == "roll") & (F.col("gap") == "")
    nays = (F.col("kind") == "nays") & (F.col("last") == "yeas") & (F.col("last2") == "roll")
    of = lambda when, what: F.max(F.when(when, F.col(what)))
    is_roll = F.col("kind") == "roll"
    g = s.groupBy(*keys, "roll").agg(of(is_roll, "anchor").alias("tally"), of(is_roll, "begin").alias("begin"), F.max(F.when(is_roll, F.col("bill"))).alias("bill"), of(yeas, "body").alias("yeas"), of(nays, "body").alias("nays"), F.max(F.when(yeas | nays, F.col("at"))).alias("listed"), listed_segments().alias("rows"))
    asked = F.array_max(F.transform(F.filter("rows", lambda r: r["kind"] == "question"), lambda r: r["at"]))
    context = whole_text(F.filter("rows", lambda r: r["at"] >= F.coalesce(F.col("asked"), F.lit(0))))
    after = F.array_min(F.transform(F.filter("rows", lambda r: (r["kind"] == "question") & (r["at"] > F.col("listed"))), lambda r: r["at"]))
    result = whole_text(F.filter("rows", lambda r: (r["at"] > F.col("listed")) & (r["at"] < F.coalesce(F.col("after"), F.lit(2**31 - 1)))))
    g = g.withColumn("asked", asked).withColumn("after", after).withColumn("context", F.when(F.col("asked").isNull(), F.right(context, F.lit(MOTION_REACH))).otherwise(context)).withColumn("result", squeezed(F.left(result, F.lit(RESULT_REACH))))
    g = g.withColumn("motion", squeezed(F.lag("context").over(Window.partitionBy(*keys).orderBy("roll"))))
    g = g.where("yeas IS NOT NULL").withColumn("vote_kind", T.first_class("motion", VOTE_KINDS))
    n_yeas, n_nays = first_number(F.col("tally"), 0), first_number(F.col("tally"), 1)
    yea_names = F.slice(names_listed(F.col("yeas")), F.lit(1), n_yeas.cast("int"))
    nay_names = F.slice(F.coalesce(names_listed(F.col("nays")), F.array().cast("array<string>")), F.lit(1), n_nays.cast("int"))
    amendment = F.element_at(F.regexp_extract_all("motion", F.lit(r"\(([A-Z]+-?\d+[A-Z]?)\)"), F.lit(1)), -1)
    amendment = F.when(F.regexp_count("motion", F.lit(r"\(([A-Z]+-?\d+[A-Z]?)\)")) > 0, amendment).otherwise(F.nullif(F.regexp_extract("motion", r"\b([A-Z][A-Za-z'.-]+)\s+amendment\b", 1), F.lit("")))
    near = F.when(F.col("begin") - F.col("bill.begin") <= BILL_REACH, F.col("bill.id"))
    g = g.select(*keys, F.col("roll").cast("int").alias("roll"), near.alias("bill"), "vote_kind", "motion", F.when(F.col("vote_kind") == "amendment", amendment).alias("amendment"), first_of(F.col("result"), RESULTS).alias("passed"), n_yeas.alias("yeas"), n_nays.alias("nays"), yea_names.alias("yea_names"), nay_names.alias("nay_names"))
    return g.withColumn("names_match", (F.size("yea_names") == F.col("yeas")) & (F.size("nay_names") == F.col("nays")))


#: How house journals write a passage vote with its tally, other questions, bill headings and pages, and the sentence of a result.
HOUSE = {
    "roll": r"(?i:The question was taken on the (?:re)?passage of the bill(?:, as amended,?)? and the roll was called\.(?: ?Pursuant to rule[^.]*\..{0,250}?)? ?There were \d+ yeas? and \d+ nays?)",
    "question": r"(?i:The question was taken)",
    "heading": r"(?i:[HS]\.? ?F\.? ?No\.? ?\d+ ?, ?A (?:bill for an act|(?:memorial )?resolution))",
    "page": r"Top of Page \d+",
}
RESULT = r"(?i)The (?:bill|resolution)(?:, as amended,?)? (?:was (?:not )?(?:(?:re)?passed|adopted)|did (?:not )?(?:pass|adopt))[^.]*\."
OUTCOME_REACH = 12_000


def house_outcomes(docs: DataFrame, text: str = "doc") -> DataFrame:
    """docs' other columns (which must tell texts apart) with bill, yeas, nays, passed, result and page of every passage vote whose result is told before the next question or heading.

    text: visible text, white space squeezed.  bill and page: the nearest heading and page mark before; a vote before any heading has no bill and is left out.
    """
    keys = [c for c in docs.columns if c != text]
    s = segmented(docs, text, HOUSE)
    s = s.withColumn("bill", carried("heading", canonical_bill(F.col("anchor")), keys)).withColumn("page", carried("page", first_number(F.col("anchor"), 0), keys)).withColumn("section", number_of(keys, "roll", "question", "heading"))
    first = lambda c: F.min_by(c, "at")
    g = s.groupBy(*keys, "section").agg(first("kind").alias("kind"), first("anchor").alias("anchor"), first("bill").alias("bill"), first("page").alias("page"), whole_text(listed_segments()).alias("block"))
    counts = F.regexp_extract_all("anchor", F.lit(r"(\d+) (?:yeas?|nays?)"), F.lit(1))
    result = F.nullif(F.regexp_extract(F.left(F.substr("block", F.length("anchor") + 1), F.lit(OUTCOME_REACH)), RESULT, 0), F.lit(""))
    g = g.where("kind = 'roll' AND bill IS NOT NULL").withColumn("result", result).where("result IS NOT NULL")
    count = lambda i: F.element_at(counts, i).try_cast("long")
    return g.select(*keys, F.col("section").cast("int").alias("section"), "bill", count(-2).alias("yeas"), count(-1).alias("nays"), (~F.col("result").rlike(r"(?i)\b(?:was|did) not\b")).alias("passed"), "result", "page")


#: Lines of a page of recorded votes.
PAGE_LABEL = r"(?i)^(?:Bill #|Description|Amendment|Yeas|Nays|J pg\.|Date)$"
NO_NAME = r"(?i)^(?:Date:|Journal Page|Bill #|Description|Amendment|Yeas|Nays|Those who|Please see|As recorded|Notice!)|^\d+$|^\d+\s+YEA|^\d{2}/\d{2}/\d{4}$"
YEAS_HEAD, NAYS_HEAD = r"(?i)^Those who voted in the affirmative were:?$", r"(?i)^Those who voted in the negative were:?$"
PAGE_BILL = r"(?i)^[HS]\.?F\.?\s*(?:NO\.?\s*)?0*\d+\b"
HOUSE_KINDS = VOTE_KINDS


def html_lines(html: Column) -> Column:
    """Visible lines: ends of blocks, rows and cells end a line."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>", " ")
    bare = F.regexp_replace(bare, r"(?i)</?(?:p|div|tr|td|th|li|h[1-6]|br|table|section|article)\b[^>]*>", "\n")
    bare = F.regexp_replace(bare, r"<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.filter(F.transform(F.split(bare, r"\r?\n"), squeezed), lambda x: x != "")


def vote_page_events(docs: DataFrame, text: str = "doc") -> DataFrame:
    """docs' other columns (which must tell pages apart) with a row for every tally line of a page of recorded votes that has a bill heading before it, and a date and both lists
    after it: event (from 1), bill, occurred_on, page, motion, vote_kind, yeas, nays, yea_names, nay_names and names_match.

    motion: the lines between the bill's heading and the tally, labels left out; 'Recorded floor vote' where there are none, or another tally stands in between.
    """
    keys = [c for c in docs.columns if c != text]
    lines = docs.select(*keys, F.posexplode(html_lines(F.col(text))).alias("at", "line"))
    kind = F.when(F.col("line").rlike(r"(?i)^\d+\s+YEA\s+and\s+\d+\s+Nay$"), "tally").when(F.col("line").rlike(PAGE_BILL), "bill")
    lines = lines.withColumn("kind", kind).withColumn("bill", carried("bill", canonical_bill(F.col("line")), keys)).withColumn("tally", number_of(keys, "tally"))
    first = lambda c: F.min_by(c, "at")
    g = lines.groupBy(*keys, "tally").agg(first("line").alias("head"), first("bill").alias("bill"), F.array_sort(F.collect_list(F.struct("at", "line", "kind"))).alias("rows"))
    place = lambda p, after, within: F.array_min(F.transform("rows", lambda r, i: F.when(r["line"].rlike(p) & (i > after) & (i < after + within), i)))
    headed = F.array_max(F.transform("rows", lambda r, i: F.when(r["kind"] == "bill", i)))
    told = F.transform(F.filter(F.slice("rows", F.coalesce(headed, F.lit(0)) + 2, F.size("rows")), lambda r: ~r["line"].rlike(PAGE_LABEL)), lambda r: r["line"])
    before = Window.partitionBy(*keys).orderBy("tally")
    g = g.withColumn("motion", F.lag(F.when(headed.isNotNull(), F.array_join(told, " "))).over(before)).where("tally > 0 AND bill IS NOT NULL")
    date = r"(?i)^Date:\s*\d{2}/\d{2}/\d{4}$"
    g = g.withColumn("dated", place(date, F.lit(0), 10)).withColumn("affirmed", place(YEAS_HEAD, F.col("dated"), 20)).withColumn("denied", place(NAYS_HEAD, F.col("affirmed"), 2**30)).where("denied IS NOT NULL")

    def names(begin: str, end: Column, n: Column) -> Column:
        own = F.transform(F.slice("rows", F.col(begin) + 2, F.greatest(end - F.col(begin) - 1, F.lit(0))), lambda r: r["line"])
        stop = F.array_min(F.transform(own, lambda x, i: F.when(x.rlike(PAGE_BILL) | x.rlike(r"(?i)^Bill #$"), i)))
        own = F.slice(own, F.lit(1), F.coalesce(stop, F.size(own)))
        return F.slice(F.filter(own, lambda x: (F.length(x) <= 80) & ~x.rlike(NO_NAME) & x.rlike(r"\p{L}")), F.lit(1), n.cast("int"))

    yeas, nays = first_number(F.col("head"), 0), first_number(F.col("head"), 1)
    day = F.to_date(F.regexp_extract(F.get("rows", F.col("dated"))["line"], r"(\d{2}/\d{2}/\d{4})", 1), "MM/dd/yyyy")
    page = first_number(F.get("rows", place(r"(?i)^Journal Page\s+\d+", F.col("dated"), 8))["line"], 0)
    motion = F.coalesce(F.nullif(squeezed(F.col("motion")), F.lit("")), F.lit("Recorded floor vote"))
    g = g.select(*keys, F.row_number().over(before).alias("event"), "bill", day.alias("occurred_on"), page.alias("page"), motion.alias("motion"), yeas.alias("yeas"), nays.alias("nays"), names("affirmed", F.col("denied"), yeas).alias("yea_names"), names("denied", F.size("rows"), nays).alias("nay_names"))
    return g.withColumn("vote_kind", T.first_class("motion", HOUSE_KINDS)).withColumn("names_match", (F.size("yea_names") == F.col("yeas")) & (F.size("nay_names") == F.col("nays")))


#: How the journals of both chambers appoint conferees, and what ends a list of them.
HOUSE_LEAD = r"(?i:The Speaker announced the appointment of the following members of the House to a Conference Committee on (?:H|S)\.? ?F\.? ?(?:No\.? ?)?\d+ ?:)"
HOUSE_STOP = r"(?i)\b(?:MOTIONS AND RESOLUTIONS|CALENDAR FOR THE DAY|MESSAGES FROM THE SENATE|ANNOUNCEMENTS? BY THE SPEAKER|ADJOURNMENT|RECESS|REPORT FROM THE COMMITTEE|FISCAL CALENDAR|Journal of the House|Top of Page|There being no objection|The motion prevailed|The Speaker announced the appointment)\b"
SENATE_LEAD = r"(?i:recommends that the following Senators be and they hereby are appointed as a Conference Committee on ?:)"
SENATE_STOP = r"(?i)\b(?:Senator \p{Lu}[\p{L}'’-]*\.?(?: (?!Senator\b)\p{Lu}[\p{L}'’.-]*)* moved that the foregoing appointments be approved|CONFERENCE COMMITTEE EXCUSED|MOTIONS AND RESOLUTIONS|MEMBERS EXCUSED|SPECIAL ORDERS|ADJOURNMENT|RECESS|JOURNAL OF THE SENATE)\b"
SENATE_ROW = r"(?i:(?:H|S)\.? ?F\.? ?(?:No\.? ?)?\d+ ?: ?Senators? )"
HOUSE_REACH, SENATE_REACH = 700, 1800


def conferees(docs: DataFrame, text: str = "doc") -> DataFrame:
    """docs' other columns (which must tell texts apart) with chamber, bill and member of all appointments to conference committees, each once a text.

    A house list ends at its first full stop that is not an initial's; a senate text has a row for each bill, to its full stop.
    """
    keys = [c for c in docs.columns if c != text]
    s = segmented(docs.withColumn(text, squeezed(F.col(text))), text, {"house": HOUSE_LEAD, "senate": SENATE_LEAD}).where("at > 0")
    reach = F.when(F.col("kind") == "house", HOUSE_REACH).otherwise(SENATE_REACH)
    block = F.when(F.col("kind") == "house", F.get(F.split("body", HOUSE_STOP, 2), F.lit(0))).otherwise(F.get(F.split("body", SENATE_STOP, 2), F.lit(0)))
    s = s.withColumn("block", F.trim(F.left(F.trim(block), reach)))
    # An initial after a comma belongs to the name before it.
    kept = F.get(F.split(F.regexp_replace("block", r",\s*([A-Z])\.", "§$1§"), r"\."), F.lit(0))
    names = F.transform(F.split(F.regexp_replace(kept, r"^[^\p{L}]+", ""), r"(?i)\s*[;,]\s*(?:and\s+)?|\s+and\s+"), lambda n: F.regexp_replace(F.trim(n), "§([A-Z])§", ", $1."))
    house = s.where("kind = 'house'").select(*keys, "kind", canonical_bill(F.col("anchor")).alias("bill"), F.explode(F.filter(names, lambda n: n.rlike(r"^\p{Lu}[\p{L}'’.-]*(?:,\s*[A-Z]\.)?$"))).alias("member"))
    rows = F.arrays_zip(F.regexp_extract_all("block", F.lit(SENATE_ROW), F.lit(0)).alias("head"), F.slice(F.split("block", SENATE_ROW, -1), F.lit(2), F.size(F.split("block", SENATE_ROW, -1))).alias("list"))
    listed = s.where("kind = 'senate'").select(*keys, "kind", F.explode(rows).alias("r"))
    ended = F.get(F.split("r.list", r"(?i)\.\s*(?=(?:H|S)\.? ?F\.?|Senator\b|$)", 2), F.lit(0))
    members = F.transform(F.split(ended, r"(?i)\s*,\s*(?:and\s+)?|\s+and\s+"), lambda n: F.regexp_replace(F.trim(n), r"[.;]+$", ""))
    senate = listed.select(*keys, "kind", canonical_bill(F.col("r.head")).alias("bill"), F.explode(F.filter(members, lambda n: n.rlike(r"^\p{Lu}[\p{L}'’.-]*(?:\s+\p{Lu}[\p{L}'’.-]*)*$"))).alias("member"))
    return house.unionByName(senate).withColumnRenamed("kind", "chamber").distinct()


#: Stages that the words of an official action tell, each on its own.
STAGES = {
    "committee_referral": r"(?is)\b(?:referred|re-referred|rereferred|re-refer(?:red)?)\s+to\b|\bcomm(?:ittee)?\.?\s*report\b.*\bre-refer\s+to\b",
    "committee_report": r"(?i)\bcomm(?:ittee)?\.?\s*report\b",
    "second_reading": r"(?i)\bsecond reading\b",
    "floor_scheduled": r"(?i)\b(?:placed on (?:the )?calendar|calendar for the day|special order|general orders)\b",
    "amendment_activity": r"(?i)\bamend(?:ed|ment|ments|ing)\b",
    "author_added": r"(?i)\bauthors? added\b",
    "rules_referral": r"(?i)\brules (?:and|&) administration\b",
    "cross_chamber_received": r"(?i)\b(?:received|returned) from (?:the )?(?:house|senate)\b",
}
COMPANION = r"(?i)\b(?:comparison with|companion|substitut(?:e|ed|ion|ing))\b"


def process_stages(actions: DataFrame, description: str = "description", bill: str = "bill") -> DataFrame:
    """actions with stage and companions, a row for each stage that a description tells; actions that tell none go.

    Rules count only where a bill is referred.  companions: other bills named beside a word of comparison, in order, each once.
    """
    text = F.col(description)
    told = {name: text.rlike(p) for name, p in STAGES.items()}
    told["rules_referral"] = told["rules_referral"] & told["committee_referral"]
    others = F.array_distinct(F.filter(P.bill_numbers(text), lambda b: ~b.eqNullSafe(F.upper(F.regexp_replace(F.col(bill), r"\s|(?<=F)0+", "")))))
    others = F.when(text.rlike(COMPANION), others).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    rows = [F.when(t, F.struct(F.lit(name).alias("stage"), none.alias("companions"))) for name, t in told.items()]
    rows.append(F.when(F.size(others) > 0, F.struct(F.lit("companion_reference").alias("stage"), others.alias("companions"))))
    return actions.select("*", F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))
