"""Fill-in-the-middle forms against a plain version that holds all units."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.llm.fill_middle import LINES, OP12_SQL, checked_marks, cut_places, fill_middle, restored

MARKS = ("<P>", "<S>", "<M>")
LONG = "ligne é\n\n" * 200_000 + "end"
TEXTS = [None, "", "one", "one\n", "\n", "\n\n\n", "a\nb\nc\nd", "ü\n漢字\n😀\nlast", "a <P> b\nc", "x<S>\n", "<M>", "<", "<\nP>\n<S", "tail <\n<\n<", "\r\n\r\nx y\n", LONG]
ROWS = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "no\nid\nat\nall"), (5, "same\nid"), (5, "same\nid"), (-7, "minus\nseven\n")]


def slow(doc_id, text, units=LINES, rate=100, spm=50):
    text = text or ""
    own = [m.group() for m in re.finditer(units, text)]
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    r = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted((r[0] % (len(own) + 1), r[1] % (len(own) + 1)))
    p, m, s = ("".join(own[a:b]) for a, b in ((0, lo), (lo, hi), (hi, None)))
    if not text or any(x in text for x in MARKS) or r[2] % 100 >= rate:
        return len(own), "plain", None, None, text
    if r[3] % 100 < spm:
        return len(own), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(own), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("output", F.lit("clash")).withColumn("a.b", F.lit(1))


@pytest.mark.parametrize("options", [{}, {"rate": 40}, {"spm_rate": 0}, {"spm_rate": 100}])
def test_forms_equal_the_plain_version_and_can_be_undone(docs, options):
    got = fill_middle(docs, **options).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    want = sorted(map(repr, (slow(i, t, rate=options.get("rate", 100), spm=options.get("spm_rate", 50)) + (i, t or "") for i, t in ROWS)))
    assert sorted(repr((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["doc_id"], r["back"])) for r in got) == want
    assert len({r["form"] for r in got}) >= 2 and all(r["form"] != "spm" for r in got if options.get("spm_rate") == 0)


def test_sql_has_the_same(spark, docs, same):
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    got = fill_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
    same(got, con.execute(OP12_SQL).df())


def test_other_units_and_empty_tables(spark, docs):
    words = r"\S+\s*"
    got = fill_middle(docs.where("text = 'a <P> b\nc' OR text LIKE 'no%'"), units=words).collect()
    assert {(r["n"], r["form"]) for r in got if r["doc_id"] is not None} == {(4, "plain")} and next(r["n"] for r in got if r["doc_id"] is None) == 4
    assert fill_middle(docs.where("false")).count() == 0
    assert cut_places("  a b", re.compile(r"\w"), 1, 2) == (2, 3, 5) and cut_places("abc", re.compile("x"), 5, 6) == (0, 0, 0)


def test_the_iterator_holds_no_units():
    """Peak memory over a text of a million units stays far under what a list of them takes."""
    import tracemalloc

    text, pattern = "ab\n" * 1_000_000, re.compile(LINES)
    tracemalloc.start()
    n, low, high = cut_places(text, pattern, 400_000, 700_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, low, high) == (1_000_000, 1_200_000, 2_100_000) and peak < 100_000


def test_marks_that_could_be_mistaken_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("<P>", "x<P>y", "<M>"), ("aba", "c", "d"), ("ab", "bc", "d")):
        with pytest.raises(ValueError):
            checked_marks(bad)
    assert checked_marks(MARKS) == MARKS
