"""Votes from committee minutes: a fold over the lines of a text.

What a line says (a bill's heading, a motion, a tally, names, a result) follows from the line alone and is found by Spark expressions.  Which vote it belongs to depends on all
lines before it: a heading closes what is open, a motion opens a vote, a tally goes to the open one unless that has a tally.  That fold runs over one small number a line
and gives the number of the line's vote.  The rest is grouping.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .journals import canonical_bill
from .segmentation import carried, squeezed

#: What lines of minutes look like.
HEADING = r"(?i)^[HS]\s*\.?\s*F\s*\.?\s*\d+\s*:"
PER_LINE = r"(?i)^(?:Senator|Sen\.)\s+(.+?)\s*[-–—:]\s*(Yea|Yeas|Aye|Yes|Nay|No|Absent|Excused|Pass|Abstain(?:ed)?|Not Voting)\s*\.?\s*$"
SIDE_LIST = r"(?i)^(Yeas?|Ayes?|Nays?|Noes?)\s*:\s*(.+)$"
INLINE = r"(?i)(?:(\d+)\s*[/-]\s*(\d+)\s*)?\(?\s*(?:Ayes|Yeas|Aye|Yea)\s*:\s*([^;)\n]*?)\s*[;.]\s*(?:Nays|Noes|Nay|No)\s*:\s*([^)\n]*)\)?"
TALLY_WORDS = r"(?i)\b(\d{1,2})\s+(?:Yeas?|Ayes?|Yes)(?:\s+votes?)?\s*,?\s+and\s+(\d{1,2})\s+(?:Nays?|Noes?|No)\b"
TALLY_BEFORE = r"(?i)\b(\d{1,2})\s*(?:-|–|to)\s*(\d{1,2})\s+roll[- ]call\b"
TALLY_AFTER = r"(?i)\broll[- ]call(?:\s+vote)?\s*(?:of|was|:)?\s*(\d{1,2})\s*(?:-|–|to)\s*(\d{1,2})\b"
MOTION = r"(?i)\b(?:moved|moves|offers|offered)\b|^\s*motion\s+(?:to|that|by)\b"
REQUEST = r"(?i)\brequested\s+(?:a\s+)?roll[- ]call\b"
SUMMARY = r"-\s*MOTION\s+[A-Z ]+\s*\.?\s*$"
FAILED = r"(?i)\b(?:motion|amendment)\s+(?:failed|fails|lost|did not (?:prevail|carry|pass)|(?:was|is) not adopted|not adopted)\b|\bnot adopted\b|\b(?:does|did) not prevail\b"
PASSED = r"(?i)\b(?:motion|amendment)\s+(?:prevailed|prevails|passed|carried|carries|(?:was|is) adopted|adopted)\b|\b(?:was|is|are) adopted\b"
#: Kinds of motions, the first that fits; 'as amended' makes no amendment.
KINDS = [
    (r"(?i)\b(?:lays? over|layed over|laid over|re-?refer|table|reconsider|adjourn|suspend|withdraw|return(?:ed)? to)\b", "procedural"),
    (r"(?i)\b(?:recommend(?:ed)? to pass|be passed|do pass|recommended for (?:passage|adoption)|be adopted|recommendation)\b", "committee_recommendation"),
    (r"(?i)\b(?:final passage|repass)\b", "passage"),
]
AMENDMENTS = [(r"(?i)\boral amendment\b", "oral"), (r"(?i)\bauthor'?s amendment\b", "author"), (r"(?i)\bdelete[- ]everything amendment\b", "delete-everything")]
#: What a line says to the fold.
IS_HEADING, IS_NAMES, IS_MOTION, IS_REQUEST, HAS_TALLY, HAS_COUNTS, HAS_RESULT = (1 << i for i in range(7))


def vote_numbers(codes: list[int]) -> list[int]:
    """For each line of a text the number of its vote (from 1), 0 where none is open; negative on the line that opens it.

    State: whether a vote is open, and whether it has counts and a result.  At the end of the text an open vote stays as it is.
    """
    out, n, is_open, counted, decided = [], 0, False, False, False
    for code in codes:
        if code & IS_HEADING:
            is_open = False
            out.append(0)
            continue
        names = code & IS_NAMES
        begins = not is_open if names else code & IS_MOTION or (code & IS_REQUEST and (not is_open or decided)) or (code & HAS_TALLY and (not is_open or counted))
        if begins:
            n, is_open, counted, decided = n + 1, True, False, False
        if not names:
            counted, decided = counted or bool(code & HAS_COUNTS), decided or bool(is_open and code & HAS_RESULT)
        out.append((-n if begins else n) if is_open else 0)
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def vote_numbers_of(codes: pd.Series) -> pd.Series:
    return codes.map(vote_numbers)


def name_list(text: Column) -> Column:
    names = F.transform(F.split(F.regexp_replace(text, r"\.\s*$", ""), r"(?i)\s*(?:,|;|\band\b)\s*"), lambda n: F.trim(F.regexp_replace(F.regexp_replace(n, r"(?i)^(?:Senators?|Sen\.)\s+", ""), r"(?i)\s*\((?:chair|vice chair)\)\s*$", "")))
    return F.filter(names, lambda n: n.rlike(r"^\p{L}[\p{L} .'-]{0,60}$"))


def choices(names: Column, choice: Column | str) -> Column:
    choice = F.lit(choice) if isinstance(choice, str) else choice
    return F.transform(names, lambda n: F.struct(n.alias("name"), choice.alias("choice")))


def told(line: Column) -> Column:
    """A struct of all that a line says."""
    part = lambda p, i: F.regexp_extract(line, p, i)
    number = lambda p, i: part(p, i).try_cast("int")
    inline, words = line.rlike(INLINE), line.rlike(TALLY_WORDS)
    numbers = ~inline & ~words & (line.rlike(TALLY_BEFORE) | line.rlike(TALLY_AFTER))
    heading = line.rlike(HEADING)
    per_line = ~heading & line.rlike(PER_LINE)
    side = ~heading & ~per_line & ~inline & line.rlike(SIDE_LIST)
    names_only = per_line | side
    label = F.lower(part(PER_LINE, 2))
    cast = F.when(label.isin("yea", "yeas", "aye", "yes"), "yea").when(label.isin("nay", "no"), "nay").otherwise("other")
    members = (
        F.when(per_line, choices(F.array(F.trim(part(PER_LINE, 1))), cast))
        .when(side, choices(name_list(part(SIDE_LIST, 2)), F.when(F.lower(part(SIDE_LIST, 1)).rlike("^(?:yea|aye)"), "yea").otherwise("nay")))
        .when(inline, F.concat(choices(name_list(part(INLINE, 3)), "yea"), choices(name_list(part(INLINE, 4)), "nay")))
        .otherwise(F.array().cast("array<struct<name:string,choice:string>>"))
    )
    count = lambda i: F.when(inline, number(INLINE, i)).when(words, number(TALLY_WORDS, i)).when(numbers, F.coalesce(number(TALLY_BEFORE, i), number(TALLY_AFTER, i)))
    counts = count(1).isNotNull() & count(2).isNotNull()
    result = F.when(line.rlike(FAILED), "failed").when(line.rlike(PASSED), "passed")
    bits = {IS_HEADING: heading, IS_NAMES: names_only, IS_MOTION: line.rlike(MOTION), IS_REQUEST: line.rlike(REQUEST), HAS_TALLY: inline | words | numbers, HAS_COUNTS: counts, HAS_RESULT: result.isNotNull()}
    code = F.lit(0)
    for bit, there in bits.items():
        code = code + F.when(there, bit).otherwise(0)
    method = F.when(names_only | inline | words | numbers | line.rlike(r"(?i)\broll[- ]call\b"), "roll_call").when(line.rlike(r"(?i)\bvoice vote\b"), "voice")
    only = lambda x: F.when(~names_only, x)
    return F.struct(line.alias("line"), code.alias("code"), F.when(heading, "heading").alias("kind"), members.alias("members"), F.when(counts & ~names_only, count(1)).alias("yeas"), F.when(counts & ~names_only, count(2)).alias("nays"), only(result).alias("result"), method.alias("method"))


def committee_votes(docs: DataFrame, text: str = "doc") -> DataFrame:
    """docs' other columns (which must tell texts apart) with a row for every vote of a committee's minutes: vote (from 1), form, bill, kind, mover, amendment, motion, method, outcome,
    yeas, nays, members (name and choice) and names_match.

    Nothing is dropped: a tally without a motion, names without a tally and votes without a result have nulls.  Without a stated tally, yeas and nays count the names, if there are any;
    names_match is null unless there are both.  bill: named in the motion, else of the heading above.
    """
    keys = [c for c in docs.columns if c != text]
    lines = F.filter(F.transform(F.split(F.col(text), r"\r?\n"), squeezed), lambda x: x != "")
    rows = docs.select(*keys, F.transform(lines, told).alias("lines"))
    rows = rows.withColumn("votes", vote_numbers_of(F.coalesce(F.transform("lines", lambda x: x["code"]), F.array().cast("array<int>"))))
    s = rows.select(*keys, F.posexplode(F.arrays_zip(F.col("lines").alias("line"), F.col("votes").alias("vote"))).alias("at", "z")).select(*keys, "at", "z.line.*", F.abs("z.vote").alias("vote"), (F.col("z.vote") < 0).alias("opens"))
    s = s.withColumn("above", carried("heading", canonical_bill(F.col("line")), keys)).where("vote > 0")
    opening = lambda c: F.max(F.when(F.col("opens"), c))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    voiced = F.col("method")
    g = s.groupBy(*keys, "vote").agg(
        opening(F.col("line")).alias("motion"), opening(F.col("code")).alias("code"), opening(F.col("above")).alias("above"), first("result").alias("outcome"), first("yeas").alias("yeas"), first("nays").alias("nays"),
        F.coalesce(F.max(F.when(voiced == "roll_call", voiced)), F.max(voiced), F.lit("unknown")).alias("method"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "members"))), lambda x: x["members"])).alias("members"),
    )
    m = F.col("motion")
    moved = (F.col("code").bitwiseAND(IS_MOTION | IS_REQUEST) > 0) & (F.col("code").bitwiseAND(IS_NAMES) == 0)
    form = F.when(~moved, "tally_only").when(m.rlike(SUMMARY), "action_summary").otherwise("narrative")
    kind = F.when(F.regexp_replace(m, r"(?i)\bas amended\b", "").rlike(r"(?i)\bamend(?:ment|ed)?\b") | m.rlike(r"\bA-?\d{1,3}\b"), "amendment")
    kind = F.coalesce(kind, *(F.when(m.rlike(p), k) for p, k in KINDS), F.lit("motion"))
    coded = F.nullif(F.replace(F.upper(F.regexp_extract(m, r"\b(A-?\d{1,3}(?:-\d+)?)\b", 1)), F.lit("-"), F.lit("")), F.lit(""))
    amendment = F.coalesce(coded, *(F.when(m.rlike(p), k) for p, k in AMENDMENTS))
    mover = F.nullif(F.regexp_extract(m, r"\bSenator\s+(\p{Lu}[\p{L}\p{N}.'-]*(?:\s+\p{Lu}[\p{L}\p{N}.'-]*){0,3}?)\s+(?:moved|moves)\b", 1), F.lit(""))
    n = lambda c: F.size(F.filter("members", lambda x: x["choice"] == c))
    named, stated = F.size("members") > 0, F.col("yeas").isNotNull()
    return g.select(
        *keys, "vote", form.alias("form"), F.coalesce(canonical_bill(m), F.col("above")).alias("bill"), kind.alias("kind"), mover.alias("mover"), amendment.alias("amendment"), F.left(m, F.lit(800)).alias("motion"), "method", "outcome",
        F.when(stated, F.col("yeas")).when(named, n("yea")).alias("yeas"), F.when(stated, F.col("nays")).when(named, n("nay")).alias("nays"), "members", F.when(stated & named, (n("yea") == F.col("yeas")) & (n("nay") == F.col("nays"))).alias("names_match"),
    )
