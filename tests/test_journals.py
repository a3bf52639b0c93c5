"""Texts cut at anchors, journals, vote pages, appointments and stages, on texts written by hand."""

import datetime

from pyspark.sql import functions as F

from tallyforge.operators import journals as J
from tallyforge.operators.segmentation import carried, number_of, segmented


def rows(df, *by):
    return [r.asDict() for r in df.orderBy(*by).collect()]


def test_segments_join_to_the_text_and_carry_headings(spark):
    texts = [(1, "pre # one a b\n* x # two\n* y * z"), (2, "* no heading"), (3, ""), (4, None), (5, "plain")]
    docs = spark.createDataFrame(texts, "id int, doc string")
    s = segmented(docs, "doc", {"head": r"# \w+", "item": r"\*"})
    s = s.withColumn("head", carried("head", F.substring("anchor", 3, 9), ["id"])).withColumn("n", number_of(["id"], "item"))
    got = rows(s, "id", "at")
    for i, t in texts:
        own = [r for r in got if r["id"] == i]
        assert "".join(r["anchor"] + r["body"] for r in own) == (t or "") and bool(own) == (t is not None)
        assert all(r["begin"] == (t or "").index(r["anchor"] + r["body"]) for r in own)
    assert [(r["id"], r["head"], r["n"], r["body"]) for r in got if r["kind"] == "item"] == [(1, "one", 1, " x "), (1, "two", 2, " y "), (1, "two", 3, " z"), (2, None, 1, " no heading")]
    assert segmented(docs.where("false"), "doc", {"a": "a"}).count() == 0


ROLL = "The roll was called, and there were yeas {} and nays {}, as follows:\nThose who voted in the affirmative were:\n{}\n"
JOURNAL = (
    "S.F. No. 7: A bill for an act.\nThe question was taken on the passage of the bill.\n" + ROLL.format(2, 1, "Anderson    Bahr\n12 45TH DAY") + "Those who voted in the negative were:\nCwodzinski;\nSo the bill passed and its title was agreed to.\n"
    "H.F. No. 0031 was read.\nSenator Doe moved to amend. The question recurred on the Doe amendment.\n" + ROLL.format(1, 0, "Anderson\nThe motion") + " did not prevail.\n"
    + "x" * 2600 + "\nThe question was taken on the motion to adjourn.\n" + ROLL.format(3, 2, "Anderson\nBahr") + "Those who voted in the negative were:\nCwodzinski\nDibble\nSo the vote was reconsidered. SPECIAL ORDERS\n"
    + ROLL.format(1, 0, "Anderson") + "The question was taken: is the motion prevailed"
)


def test_every_roll_call_of_a_journal_is_an_event(spark):
    docs = spark.createDataFrame([(1, JOURNAL), (2, "No votes. S.F. 1"), (3, None), (4, "")], "id int, doc string")
    a, b, c, d = rows(J.senate_roll_calls(docs), "id", "roll")
    assert (a["bill"], a["vote_kind"], a["passed"], a["yea_names"], a["nay_names"], a["names_match"]) == ("SF7", "passage", True, ["Anderson", "Bahr"], ["Cwodzinski"], True)
    assert a["motion"] == "The question was taken on the passage of the bill."
    assert (b["bill"], b["vote_kind"], b["amendment"], b["passed"], b["yea_names"], b["names_match"]) == ("HF31", "amendment", "Doe", False, ["Anderson"], True)
    # Too far from its bill; a list that disagrees with its tally is told, not lost.
    assert (c["bill"], c["vote_kind"], c["passed"], c["yeas"], c["nays"], c["yea_names"], c["names_match"]) == (None, "motion", True, 3, 2, ["Anderson", "Bahr"], False)
    # Without a question of its own, and without a result before the next one.
    assert (d["roll"], d["passed"], d["yeas"], d["nay_names"]) == (4, None, 1, [])
    assert "SPECIAL ORDERS" in d["motion"]


def test_house_outcomes_need_a_heading_and_a_result(spark):
    ask = "The question was taken on the passage of the bill and the roll was called. There were {} yeas and {} nays as follows: "
    text = ask.format(1, 2) + "The bill was passed. Top of Page 9 H. F. No. 12, A bill for an act one. " + ask.format(70, 60) + "names Top of Page 10 The bill was passed and its title agreed to. " + ask.format(5, 6) + "H. F. No. 13, A resolution two. The bill was passed. " + ask.format(0, 1) + "The resolution was not adopted."
    got = rows(J.house_outcomes(spark.createDataFrame([(1, text), (2, None), (3, "H.F. No. 1, A bill for an act")], "id int, doc string")), "section")
    assert [(r["bill"], r["yeas"], r["nays"], r["passed"], r["page"]) for r in got] == [("HF12", 70, 60, True, 9), ("HF13", 0, 1, False, 10)]
    assert got[0]["result"] == "The bill was passed and its title agreed to."


def test_vote_pages_give_every_event(spark):
    lists = "<tr><td>Those who voted in the affirmative were:</td></tr><td>Øre &amp; Co</td><td>Doe, J.</td><p>Those who voted in the negative were:<p>Roe</p>"
    html = f"<script>HF 9</script><td>HF0012</td><td>Description</td><td>Final passage</td><p>2 YEA and 1 Nay</p><p>Date: 02/29/2024</p><p>Journal Page 77</p>{lists}<td>3 YEA and 1 Nay</td><p>Date: 03/01/2024</p>{lists}<td>SF3</td><td>Doe amendment</td><p>1 YEA and 0 Nay</p><p>no date</p>{lists}"
    one, two = rows(J.vote_page_events(spark.createDataFrame([(1, html), (2, "<p>1 YEA and 1 Nay</p><p>Date: 03/01/2024</p>" + lists), (3, None)], "id int, doc string")), "event")
    assert (one["bill"], one["occurred_on"], one["page"], one["motion"], one["vote_kind"], one["yea_names"], one["nay_names"], one["names_match"]) == ("HF12", datetime.date(2024, 2, 29), 77, "Final passage", "passage", ["Øre & Co", "Doe, J."], ["Roe"], True)
    assert (two["bill"], two["page"], two["motion"], two["yeas"], two["names_match"]) == ("HF12", None, "Recorded floor vote", 3, False)


def test_conferees_of_both_chambers(spark):
    lead = "The Speaker announced the appointment of the following members of the House to a Conference Committee on H. F. No. 0{}:\n"
    text = lead.format(5) + "Doe, J.; Roe and\nMcÉvoy. Others spoke.\n" + lead.format(6) + "Doe, J.\nRECESS Smith" + lead.format(5) + "Roe."
    senate = "Doe recommends that the following Senators be and they hereby are appointed as a Conference Committee on:\nS.F. No. 9: Senators Van Doe, Roe and Poe.\nS.F. 10: Senator Noe.\nSenator Doe moved that the foregoing appointments be approved. S.F. 11: Senators Late."
    got = rows(J.conferees(spark.createDataFrame([(1, text), (2, senate), (3, None), (4, "none")], "id int, doc string")), "id", "bill", "member")
    assert [(r["id"], r["chamber"], r["bill"], r["member"]) for r in got] == [(1, "house", "HF5", "Doe, J."), (1, "house", "HF5", "McÉvoy"), (1, "house", "HF5", "Roe"), (1, "house", "HF6", "Doe, J."), (2, "senate", "SF10", "Noe"), (2, "senate", "SF9", "Poe"), (2, "senate", "SF9", "Roe"), (2, "senate", "SF9", "Van Doe")]


def test_stages_of_an_action(spark):
    texts = ["Rereferred to Rules & Administration", "Rules and Administration met", "Substituted SF12 for HF012, HF13, hf 13", None, "Nothing"]
    got = rows(J.process_stages(spark.createDataFrame([(i, "HF12", t) for i, t in enumerate(texts)], "i int, bill string, description string")), "i", "stage")
    assert [(r["i"], r["stage"], r["companions"]) for r in got] == [(0, "committee_referral", []), (0, "rules_referral", []), (2, "companion_reference", ["SF12", "HF13"])]


def votes_of(spark, *texts):
    from tallyforge.operators.minutes import committee_votes

    return rows(committee_votes(spark.createDataFrame(list(enumerate(texts)), "id int, doc string")), "id", "vote")


def test_the_fold_tells_votes_apart():
    from tallyforge.operators.minutes import HAS_COUNTS, HAS_RESULT, HAS_TALLY, IS_HEADING, IS_MOTION, IS_NAMES, IS_REQUEST, vote_numbers

    tally = HAS_TALLY | HAS_COUNTS
    assert vote_numbers([]) == [] and vote_numbers([0, HAS_RESULT, IS_HEADING, 0]) == [0, 0, 0, 0]
    # A motion takes the tally after it; the next tally opens a vote of its own; a heading closes.
    assert vote_numbers([IS_MOTION, 0, tally, tally, IS_NAMES, IS_HEADING, IS_NAMES, IS_NAMES]) == [-1, 1, 1, -2, 2, 0, -3, 3]
    # A roll call asked for belongs to the open vote until that is decided.
    assert vote_numbers([IS_MOTION, IS_REQUEST, HAS_RESULT, IS_REQUEST, tally]) == [-1, 1, 1, -2, 2]
    # Lists without counts leave room for a tally.
    assert vote_numbers([HAS_TALLY, tally, IS_MOTION | tally | HAS_RESULT, IS_MOTION]) == [-1, 1, -2, -3]


def test_minutes_keep_partial_votes(spark):
    got = votes_of(
        spark,
        "HF 1: x\nSenator Doe - Aye\nSenator Roe - Excused.\n8 Yeas and 0 Nays",
        "Senator D'Oe-Øre moves the author's amendment be adopted. The motion did not prevail.\nSenator Doe moved to re-refer S.F. No. 0044 to Finance\non a 6-5 roll call\nRoll call vote: 3 to 4. Motion prevails",
        None, "", "Nothing happened.\nThe motion prevailed.", "Ayes: Doe; Nays: none\r\nYeas: Roe, Poe. Nays: Coe",
    )
    keep = [(r["id"], r["vote"], r["form"], r["bill"], r["kind"], r["method"], r["outcome"], r["yeas"], r["nays"], r["names_match"]) for r in got]
    assert keep == [
        (0, 1, "tally_only", "HF1", "motion", "roll_call", None, 8, 0, False),
        (1, 1, "narrative", None, "amendment", "unknown", "failed", None, None, None),
        (1, 2, "narrative", "SF44", "procedural", "roll_call", None, 6, 5, None),
        (1, 3, "tally_only", None, "motion", "roll_call", "passed", 3, 4, None),
        (5, 1, "tally_only", None, "motion", "roll_call", None, 3, 2, None),
    ]
    assert [(m["name"], m["choice"]) for m in got[0]["members"]] == [("Doe", "yea"), ("Roe", "other")]
    assert (got[1]["mover"], got[1]["amendment"]) == ("D'Oe-Øre", "author") and [m["name"] for m in got[4]["members"]] == ["Doe", "none", "Roe", "Poe", "Coe"]
