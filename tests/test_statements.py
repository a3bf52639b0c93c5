"""Statements, positions and speeches on sentences written by hand."""

import pytest

from tallyforge.operators import statements as S

FAR = " The clerk read on and on." * 10


def stances(spark, text, name="Jane Doe"):
    docs = spark.createDataFrame([(1, name, text)], "id int, name string, text string")
    return sorted((r["bill"], r["stance"]) for r in S.bill_statements(docs).collect())


@pytest.mark.parametrize(
    "text,want",
    [
        ("Sen. Doe will vote no on HF12.", [("HF12", "opposes")]),
        ("Sen. Doe backed HF12.", [("HF12", "supports")]),
        ("Sen. Doe supports H.F. No. 12 today.", [("HF12", "supports")]),
        (f"I support HF12.{FAR} I oppose Senate File 1 3.", [("HF12", "supports"), ("SF13", "opposes")]),
        ("I support HF12 but oppose SF3.", []),
        ("We will not vote for s. f. 7!", [("SF7", "opposes")]),
        ("Representative Mary Ann Doe, jr. endorsed HF1", [("HF1", "supports")]),
        ("Doe supports HF1. They say so.", []),
        ("I spoke. Supporters back HF1 now", []),
        ("I " + "very " * 30 + "much support HF1", []),
        ("I support HF1 and HF2." + FAR + "I support HF 1.", [("HF1", "supports"), ("HF2", "supports")]),
        ("I support AHF1, HF1234567 and HF.", []),
        (None, []), ("", []), ("HF1", []),
    ],
)
def test_stances_on_bills(spark, text, want):
    assert stances(spark, text) == want


def test_surnames_with_parts_and_marks(spark):
    assert stances(spark, "Sen. Simunek Poe supports HF1", "Ann Šimůnek-Poe") == [("HF1", "supports")] == stances(spark, "Rep. Ann van simunekpoe supports HF1", "Ann Šimůnek-Poe")
    assert stances(spark, "Sen. supports HF1", " ") == stances(spark, "Sen. X supports HF1", None) == []


def test_windows_hold_what_stands_around_however_dense_the_mentions(spark):
    text = "start " + " ".join(f"HF{i}" for i in range(100)) + " end\n\n" + "y" * 400 + " HF7"
    got = S.mentions(spark.createDataFrame([(1, text)], "id int, text string"), "text", 50).orderBy("at").collect()
    assert len(got) == 101
    for r in got:
        at = r["bill_at"]
        assert r["excerpt"][at : at + len(r["raw"])] == r["raw"] == r["bill"]
    assert got[0]["excerpt"].startswith("start HF0 HF1") and got[50]["excerpt"].startswith(text[text.index("HF50") - 50 : text.index("HF50")].lstrip()) and got[100]["excerpt"] == "y" * 49 + " HF7"


def test_issue_positions(spark):
    text = "My school plan: I favor teachers.\nRep. O'Doe rejects any tax.  O’Nope backs housing for all!\rWe work to fix transit and schools. Our priority is housing, it is."
    got = S.issue_positions(spark.createDataFrame([(1, "Al O'Doe", text), (2, "X", None)], "id int, name string, text string")).collect()
    assert [(r["family"], r["commitment"], r["stance"]) for r in sorted(got, key=lambda r: r["family"])] == [("education", "explicit_support", "supports"), ("housing", "priority_statement", "unclear"), ("taxes_revenue", "explicit_opposition", "opposes")]


def test_speeches(spark):
    members = spark.createDataFrame([(1, "Ann Van Dam", "house"), (2, "Bo Dam", "senate"), (3, "Cy (Poe)", "senate"), (4, " ", "house"), (5, None, "house")], "member int, name string, chamber string")
    text = f"Rep. Dam urged passage of HF 1.{FAR} Senator Bo Q. Dam argued against and in favor of SF2; HF3 too.{FAR} Ann  Van Dam saw HF4.{FAR} Sen. Ed (Poe) told us to vote no on HF5"
    got = S.speeches(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), members).collect()
    assert sorted((r["bill"], r["member"], r["stance"]) for r in got) == [("HF1", 1, "supports"), ("HF3", 2, "unclear"), ("SF2", 2, "unclear")]
