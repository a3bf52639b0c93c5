"""Operators against hand-computed values and naive loops."""

import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions.numeric import required_yes, width_band
from tallyforge.functions.similarity import jaccard, size_similarity
from tallyforge.operators import evidence as E
from tallyforge.operators.asof import active_on, asof_join, decayed_prior, strict_prior
from tallyforge.operators.distribution import chamber, count_pmf, quantile, simulated
from tallyforge.operators.learners import ridge_logistic, with_prediction
from tallyforge.operators.metrics import ranked_probability_score, ranking, scorecard
from tallyforge.operators.rates import baseline_member_rate, member_probability, prior_counts


def one(df):
    return df.first()


def value(spark, column):
    return one(spark.range(1).select(column.alias("x")))["x"]


def test_pmf_and_quantile_by_hand(spark):
    assert value(spark, count_pmf(F.array(F.lit(0.5), F.lit(0.5)))) == [0.25, 0.5, 0.25]
    np.testing.assert_allclose(value(spark, count_pmf(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.2)))), [0.2, 0.45, 0.3, 0.05])
    assert value(spark, quantile(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.25)), 0.5)) == 1
    assert value(spark, ranked_probability_score(F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)), F.lit(1))) == 0
    assert value(spark, ranked_probability_score(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.lit(2))) == 1


def test_ranking_perfect_and_tied(spark):
    rows = [("perfect", 0.9, 1), ("perfect", 0.8, 1), ("perfect", 0.2, 0), ("tied", 0.5, 1), ("tied", 0.5, 0), ("single", 0.5, 0)]
    found = {r["k"]: (r["average_precision"], r["roc_auc"]) for r in ranking(spark.createDataFrame(rows, "k string, p double, outcome int"), ["k"]).collect()}
    assert found == {"perfect": (1, 1), "tied": (0.5, 0.5), "single": (None, None)}


def test_scorecard_by_hand(spark):
    r = one(scorecard(spark.createDataFrame([(0.9, 1), (0.2, 0), (1.0, 1)], "p double, outcome int").withColumn("k", F.lit(1)), ["k"]))
    assert r["brier"] == pytest.approx((0.01 + 0.04) / 3) and r["accuracy"] == 1 and r["ece"] == pytest.approx((0.1 + 0.2) / 3)
    assert r["log_loss"] == pytest.approx(-(math.log(0.9) + math.log(0.8) + math.log(1 - 1e-12)) / 3)


def test_baseline_rates_by_hand(spark):
    votes = spark.createDataFrame([(1, "a", "d", 1, 1), (2, "b", "d", 1, 1), (3, "c", "d", 1, 0), (4, "a", "d", 2, 1), (5, "z", "q", 2, 0)], "id int, member_id string, party string, day int, outcome int")
    rows = {r["id"]: r for r in prior_counts(votes).withColumn("p", baseline_member_rate()).withColumn("q", member_probability()).collect()}
    assert [rows[i]["p"] for i in (1, 2, 3)] == [0.5] * 3  # rows of a day don't inform each other
    assert rows[4]["p"] == pytest.approx((1 + 4 * 2 / 3) / 5)
    assert rows[5]["p"] == pytest.approx(2 / 3)  # no party history: the global rate
    assert rows[1]["q"] is None and rows[5]["q"] is None  # too little support
    party = (2 + 12 * 2 / 3) / 15
    assert rows[4]["q"] == pytest.approx((1 + 3 * party) / 4)


def naive(rows, key, half=None):
    out = {}
    for i, k, d, y in rows:
        past = [(2.0 ** (-(d - e) / half) if half else 1, z) for _, j, e, z in rows if j == k and e < d]
        out[i] = (sum(w * z for w, z in past), sum(w for w, _ in past))
    return out


@pytest.mark.parametrize("half", [None, 30.0])
def test_prior_sums_equal_a_naive_loop(spark, half):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(40), rng.randrange(2)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k string, day int, y int")
    measures = {"yes": F.col("y"), "n": F.lit(1)}
    found = strict_prior(df, ["k"], measures) if half is None else decayed_prior(df, ["k"], measures, half)
    want = naive(rows, "k", half)
    got = {r["id"]: (r["yes"], r["n"]) for r in found.collect()}
    assert len(got) == 200
    for i, x in want.items():
        assert got[i] == pytest.approx(x, abs=1e-9)


def test_later_rows_change_nothing_before(spark):
    rows = [(i, "m", i // 3, i % 2) for i in range(30)]
    df = lambda r: strict_prior(spark.createDataFrame(r, "id int, k string, day int, y int"), ["k"], {"yes": F.col("y")})
    changed = [(i, k, d, 1 - y if d >= 5 else y) for i, k, d, y in rows]
    before = {r["id"]: r["yes"] for r in df(rows).where("day <= 5").collect()}
    assert before == {r["id"]: r["yes"] for r in df(changed).where("day <= 5").collect()}


@pytest.mark.parametrize("strict", [True, False])
def test_asof_join(spark, strict):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, "b", 9), (4, "a", 1)], "id int, k string, d int")
    right = spark.createDataFrame([("a", 3, "x"), ("a", 4, "y"), ("a", 5, "z")], "k string, pd int, v string")
    got = {r["id"]: r["v"] for r in asof_join(left, right, ["k"], "d", "pd", ["v"], strict).collect()}
    assert got == ({1: "y", 2: None, 3: None, 4: None} if strict else {1: "z", 2: "x", 3: None, 4: None})


def test_text_features_by_hand(spark):
    title = "A bill relating to housing; grants for local housing assistance"
    assert value(spark, F.array_distinct(T.title_tokens(F.lit(title)))) == ["housing", "grants", "local", "assistance"]
    assert value(spark, T.bigrams(T.title_tokens(F.lit("housing grants local schools")))) == ["housing_grants", "grants_local", "local_schools"]
    assert value(spark, T.bigrams(T.title_tokens(F.lit("housing")))) == []
    assert value(spark, T.tags(T.normalized(F.lit("The current schools")), T.POLICY_TERMS)) == ["education", "housing"]  # rent stands in current
    assert value(spark, T.normalized(F.lit("  A-b, C!d  "))) == "a-b c d"
    assert value(spark, T.first_class(F.lit("Parent"), T.ISSUE_PATTERNS)) == "housing" and value(spark, T.first_class(F.lit("Parent"), T.ISSUE_WORDS)) == "other"
    assert value(spark, T.preamble(F.lit("head\nBe it enacted by the legislature x"))) == "head"
    assert [value(spark, width_band(F.lit(n).cast("int"))) for n in (1, 500, 501, None)] == ["1-500", "1-500", "501-1000", "unknown"]
    assert value(spark, required_yes(F.lit("majority-of-cast"), F.lit(133))) == 67
    assert value(spark, T.person_key(F.lit("José  María Núñez"))) == "jose|nunez"


def test_similarity_by_hand(spark):
    empty = F.array().cast("array<string>")
    assert value(spark, jaccard(empty, empty)) == 1 and value(spark, jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert value(spark, size_similarity(F.lit(0), F.lit(0))) == 1 and value(spark, size_similarity(F.lit(0), F.lit(3))) == 0 and value(spark, size_similarity(F.lit(2), F.lit(8))) == 0.25


def test_validity_interval_is_open_where_null(spark):
    df = spark.createDataFrame([(None, None), (5, None), (None, 4), (3, 8)], "a int, b int").select(active_on(F.lit(5), F.col("a"), F.col("b")).alias("x"))
    assert [r["x"] for r in df.collect()] == [True, True, False, True]


def test_chamber_smooths_large_groups(spark):
    rows = [("s", 0.6)] * 3 + [("l", 0.6)] * 30
    got = {r["g"]: r for r in chamber(spark.createDataFrame(rows, "g string, p double"), ["g"]).collect()}
    assert got["s"]["passage_p"] == pytest.approx(0.648) == got["s"]["independent_p"]
    assert got["l"]["passage_p"] < got["l"]["independent_p"] and got["l"]["required_yes"] == 16


def test_simulation_agrees_with_itself_and_the_mean(spark):
    df = spark.createDataFrame([(1, 0.7, "x")] * 40 + [(2, 0.1, "y")] * 40, "g long, p double, party string")
    a = sorted(map(tuple, simulated(df, "g", runs=4000).collect()))
    assert a == sorted(map(tuple, simulated(df.repartition(3), "g", runs=4000).collect()))
    assert 24 < a[0][2] < 30 and a[0][5] > 0.8 and a[1][5] < 0.05


def test_ridge_reaches_the_minimum(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    o = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(o + x @ [0.8, -0.5])))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(d)) for (a, b), c, d in zip(x, o, y)], "a double, b double, o double, y double")
    beta = ridge_logistic(df, ["a", "b"], "y", F.col("o"), penalty=2.0)
    p = 1 / (1 + np.exp(-(o + x @ beta)))
    np.testing.assert_allclose(x.T @ (p - y) + 2.0 * beta, 0, atol=1e-5)
    assert with_prediction(df, ["a", "b"], beta, F.col("o")).where("p between 0 and 1").count() == 400


def test_ingestion_is_idempotent(spark):
    old = spark.createDataFrame([(1, {"a": 1}), (2, {"b": 1})], "k int, m map<string,int>")
    new = spark.createDataFrame([(2, {"b": 2, "c": 3}), (3, {})], "k int, m map<string,int>")
    once = E.upsert(old, new, ["k"], merged="m")
    twice = E.upsert(once, new, ["k"], merged="m")
    rows = lambda d: sorted((r["k"], tuple(sorted(r["m"].items()))) for r in d.collect())
    assert rows(once) == rows(twice) == [(1, (("a", 1),)), (2, (("b", 2), ("c", 3))), (3, ())]
    absent = E.insert_if_absent(old.select("k"), new.select("k").union(new.select("k")), ["k"])
    assert [r["k"] for r in absent.collect()] == [3]
    with pytest.raises(ValueError):
        E.bounded_read(old, 1)
    ledger = spark.createDataFrame([("d", 1, "a", None), ("d", 2, "b", "a"), ("d", 3, "c", "x")], "k string, day int, seal string, prior string")
    assert [r["day"] for r in E.chain_breaks(ledger, ["k"], "day", "seal", "prior").collect()] == [3]
    a, b = value(spark, E.ingestion_key(F.lit(None), F.lit("x"))), value(spark, E.ingestion_key(F.lit(""), F.lit("x")))
    assert a != b and len(a) == 64


def test_impact_by_hand(spark):
    d = value(spark, E.logit_delta(F.lit("fact"), F.lit("opposes"), F.lit("official"), F.lit("high"), F.lit("stale"), F.lit(None).cast("double")))
    assert d == pytest.approx(-0.65 * 0.8 * 0.45 * 0.5)
    assert value(spark, E.shifted(F.lit(0.5), F.lit(100.0))) == 0.995


def test_nothing_outside_imports_the_llm_folder():
    root = Path(__file__).resolve().parent.parent / "tallyforge"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


def test_preambles_are_cut_at_the_first_marker_as_in_sql(spark, duck, same, tmp_path):
    import hashlib

    import duckdb
    import pandas as pd

    from tallyforge import catalog

    from .conftest import SF

    rows = pd.read_parquet(f"{SF}/documents.parquet").head(6).copy()
    rows["text"] = ["An act. Be it enacted by the Legislature: x", "Title\n  whereas, a; be it enacted by the legislature", "WHEREAS b", "no whereas here", "a" * 9000, "x be it enacted by the legislature\nWHEREAS"]
    rows.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    found = catalog.QUERIES["fn16_preamble_cut"](spark, str(tmp_path))
    same(found, con.execute(catalog.ORACLE_SQL["fn16_preamble_cut"]).df())
    want = ["An act.", "Title", "", "no whereas here", "a" * 8000, "x"]
    assert {r["digest"] for r in found.collect()} == {hashlib.md5(w.encode()).hexdigest() for w in want}


def test_the_registered_simulation_draws_all_runs(monkeypatch):
    from tallyforge.plans import models

    monkeypatch.setattr(models, "forecasts", lambda spark, sf_dir: None)
    monkeypatch.setattr(models, "simulated", lambda rows, by, **own: own)
    assert models.dst05(None, "") == {}


def test_the_flagship_reads_votes_once_more_than_its_daily_sums(spark):
    from tallyforge import catalog

    from .conftest import SF

    plan = catalog.QUERIES[catalog.FLAGSHIP](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") <= 2 and "NestedLoop" not in plan and "CartesianProduct" not in plan
    plan = catalog.QUERIES["join18_analogues"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_the_nearest_rows_are_cut_exactly(spark):

    from tallyforge.plans.scoring import nearest

    rng = random.Random(2)
    rows = [(i, rng.choice([0.0, 0.1, 0.10001, 0.25, 1.0, round(rng.random(), 2)])) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, d double")
    for n in (0, 1, 17, 60, 150, 299, 300):
        assert {r["i"] for r in nearest(df, "d", "i", n).collect()} == {i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))[:n]}
    assert nearest(df.where("false"), "d", "i", 0).count() == 0


@pytest.mark.parametrize("n", [0, 1, 10, 17, 100])
def test_a_batch_goes_round_at_the_end(spark, n):
    from tallyforge.plans.details import batch_from

    got = {r["i"]: r["place"] for r in batch_from(spark.range(n).select(F.col("id").alias("i")), "i", 17, 25).collect()}
    want = {i: (i - 17) % n for i in range(n)}
    assert got == {i: p for i, p in want.items() if p < 25}


def test_a_history_of_too_many_half_lives_is_refused(spark):
    from tallyforge.operators.asof import decayed_prior

    df = spark.createDataFrame([(1, 0, 1), (1, 2000, 1)], "k long, day int, y int")
    with pytest.raises(Exception, match="half-lives"):
        decayed_prior(df, ["k"], {"s": F.col("y")}, 1.0).collect()


def test_members_divided_out_equal_the_others_counted(spark):
    from tallyforge.operators.distribution import without_one

    rng = random.Random(4)
    for n in (1, 2, 7, 60):
        chances = [rng.choice([0.0, 1.0, 0.5, rng.random()]) if n < 60 else rng.random() for _ in range(n)]
        at = n // 2
        df = spark.createDataFrame([(i, chances, chances[i]) for i in range(n)], "i int, chances array<double>, p double")
        got = {r["i"]: r["x"] for r in df.select("i", without_one(count_pmf(F.col("chances")), F.col("p"), F.lit(at)).alias("x")).collect()}
        for i in range(n):
            pmf = [1.0]
            for q in chances[:i] + chances[i + 1 :]:
                pmf = [(pmf[k] if k < len(pmf) else 0) * (1 - q) + (pmf[k - 1] * q if k else 0) for k in range(len(pmf) + 1)]
            assert got[i] == pytest.approx(pmf[at] if at < len(pmf) else 0, abs=1e-9)


def test_xorshift_simulation_by_a_plain_loop(spark):
    from tallyforge.operators.distribution import xorshift_simulated

    rows = [(1, "b", 0.7), (1, "a", 0.2), (1, "c", 0.9), (2, "a", 0.5)]
    got = {r["e"]: r for r in xorshift_simulated(spark.createDataFrame(rows, "e long, m string, p double"), "e", "m", runs=500).collect()}
    for e in (1, 2):
        p = [q for _, q in sorted((m, q) for k, m, q in rows if k == e)]
        state, totals = 1, []
        for _ in range(500):
            yes = 0
            for q in p:
                state ^= (state << 13) & 0xFFFFFFFF
                state ^= state >> 17
                state ^= (state << 5) & 0xFFFFFFFF
                yes += state / 2**32 < q
            totals.append(yes)
        totals.sort()
        assert got[e]["passage_p"] == pytest.approx(sum(t >= len(p) // 2 + 1 for t in totals) / 500) and got[e]["expected_yes"] == pytest.approx(sum(p))
        assert (got[e]["yes_low"], got[e]["yes_high"]) == (totals[25], totals[475])


def test_csv_keeps_quotes_breaks_and_refuses_broken_rows(spark, tmp_path):
    from tallyforge.sources.tables import read_csv

    (tmp_path / "a.csv").write_bytes(b'k,note\r\n1,"say ""hi"", twice"\r\n2,"two\r\nlines"\r\n3,\r\n')
    got = {r["k"]: r["note"] for r in read_csv(spark, str(tmp_path / "a.csv"), "k int, note string").collect()}
    assert got == {1: 'say "hi", twice', 2: "two\nlines", 3: None}
    (tmp_path / "b.csv").write_text("k;note\n1;a\nx;b\n")
    assert read_csv(spark, str(tmp_path / "b.csv"), "k string, note string", ";").count() == 2
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path / "b.csv"), "k int, note string", ";").collect()


def test_authors_are_resolved_by_the_first_rung_with_a_match(spark):
    from tallyforge.plans.parsers import resolved_authors

    roster = spark.createDataFrame([(1, "Ann Lee"), (2, "Ann Marie Lee"), (3, "Bo Šimůnek"), (4, "Cy Poe"), (5, "Di Poe"), (6, "Ed Van Dam")], "member long, name string")
    raw = spark.createDataFrame([(1, "Ann Lee"), (2, "Simunek"), (3, "Poe"), (4, "D. Poe"), (5, "Nobody"), (6, "Marie Lee"), (7, "X. Poe"), (8, ""), (9, "Lee, Ann")], "id long, name string")
    got = {r["id"]: (r["status"], r["member"], r["method"]) for r in resolved_authors(raw, roster).collect()}
    assert got[1] == ("resolved", 1, "exact") and got[2] == ("resolved", 3, "unique_surname") and got[3][0] == "ambiguous" and got[4] == ("resolved", 5, "surname_initials")
    assert got[5][0] == got[7][0] == got[8][0] == "unresolved" and got[6] == ("resolved", 2, "token_subset")


def test_budget_and_locale_and_folding(spark):
    from tallyforge.operators.evidence import admitted_within

    rows = [(1, 0, 1), (1, 5, 2), (1, 6, 3), (1, 10, 4), (1, 11, 5), (2, 6, 6)]
    got = {r["i"]: r["admitted"] for r in admitted_within(spark.createDataFrame(rows, "k long, t long, i long"), "k", "t", "i", most=2, span=10).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True}
    assert value(spark, T.person_key(F.lit("Łukasz Šimůnek-Ő"))) is not None and value(spark, T.plain_ascii(F.lit("Šimůnek Őry Ştefan é"))) == "simunek ory stefan e"


def test_percentiles_within_ranges_are_those_of_the_whole(spark):

    from tallyforge.operators.percentile import frozen_percentile

    rng = random.Random(8)
    nan = float("nan")
    for reference, ranges in (([rng.randrange(40) * 1.5 for _ in range(200)] + [None, nan], 16), ([3.0], 4), ([1.0, 1.0, 9.0], 512), ([], 8), ([5.0] * 50 + [6.0], 7), ([rng.random() for _ in range(60)], 1)):
        known = sorted(v for v in reference if v is not None and v == v)
        n = len(known)

        def place(x):
            if x is None or x != x or not n:
                return None
            lower, same = sum(v < x for v in known), sum(v == x for v in known)  # noqa: B023
            if n == 1:  # noqa: B023
                return 0.5
            if same:
                return (lower + (same - 1) / 2) / (n - 1)  # noqa: B023
            if lower in (0, n):  # noqa: B023
                return float(lower > 0)
            return (lower - 1 + (x - known[lower - 1]) / (known[lower] - known[lower - 1])) / (n - 1)  # noqa: B023

        xs = [None, nan, -5.0, 1e9, 0.0, *(rng.uniform(-2, 62) for _ in range(80)), *(rng.randrange(40) * 1.5 for _ in range(40)), 5.5, 5.0, 5.0]
        rows = spark.createDataFrame(list(enumerate(xs)), "i int, x double")
        got = {r["i"]: r["percentile"] for r in frozen_percentile(rows, "x", spark.createDataFrame([(v,) for v in reference], "v double"), "v", ranges).collect()}
        assert len(got) == len(xs)
        for i, x in enumerate(xs):
            assert got[i] == (None if place(x) is None else pytest.approx(place(x))), (x, ranges, n)


def test_ranks_in_ranges_are_those_of_the_whole(spark, monkeypatch):

    from tallyforge.operators import metrics

    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(300)] + [("c", 0.5, 1), ("d", 0.5, 0), ("a", 1.0, 1), ("a", 0.0, 0)]
    df = spark.createDataFrame(rows, "s string, p double, outcome int")
    for n in (4096, 3, 1):
        monkeypatch.setattr(metrics, "RANGES", n)
        for r in metrics.ranking(df, ["s"]).collect():
            own = [(p, y) for s, p, y in rows if s == r["s"]]
            pos, neg = [p for p, y in own if y], [p for p, y in own if not y]
            auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
            ap = sum(sum(x >= p for x in pos) / sum(x >= p for x, _ in own) for p in pos) / len(pos) if pos else None
            assert r["roc_auc"] == (None if auc is None else pytest.approx(auc)) and r["average_precision"] == (None if ap is None else pytest.approx(ap))


PARTS = [(1, "T", "B", 4), (2, "T", "B", 4), (3, "T", "B", 8), (4, "T", "B", 8), (5, "T", "B", 3), (6, "T", "B", 0), (7, "T", "B", 0), (8, "T", "C", 4), (9, "U", "B", 4), (10, None, "B", 4), (11, None, "B", 4), (12, "T", "C", 50)]


def test_every_two_parts_find_their_similarity_by_their_classes(spark, same, tmp_path):
    import duckdb
    import pandas as pd

    from tallyforge import catalog

    pd.DataFrame(PARTS, columns=["p_partkey", "p_type", "p_brand", "p_size"]).to_parquet(tmp_path / "part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    found = catalog.QUERIES["fn11_size_similarity"](spark, str(tmp_path))
    same(found, con.execute(catalog.ORACLE_SQL["fn11_size_similarity"]).df())
    rows = found.collect()
    own = {r["a"]: (r["b"], r["similarity"], r["links"]) for r in rows if r["form"] == "member"}
    between = {(r["a"], r["b"]): r["similarity"] for r in rows if r["form"] == "pair"}
    got = {}
    for a, (x, s, n) in own.items():
        for b, (y, _, _) in own.items():
            if a < b and n and (x == y or (min(x, y), max(x, y)) in between):
                got[a, b] = s if x == y else between[min(x, y), max(x, y)]
    want = {(a, b): round(1.0 if s == t == 0 else min(s, t) / max(s, t), 6) for a, k, l, s in PARTS for b, m, n, t in PARTS if a < b and k and (k, l) == (m, n)}
    assert got == want and set(own) == {p[0] for p in PARTS}
    assert {a: n for a, (_, _, n) in own.items()} == {p[0]: sum(p[0] in pair for pair in want) for p in PARTS}
    assert sum(r["links"] for r in rows if r["form"] == "pair") == sum(own[a][0] != own[b][0] for a, b in want)


def test_contradictions_are_all_pairs_of_opposite_sides(spark, same, tmp_path):
    import duckdb
    import pandas as pd

    from tallyforge import catalog

    at = pd.Timestamp("2024-01-05 10:00")
    rows = [(1, 7, "view", 80.0, at), (2, 7, "view", 50.0, at), (3, 7, "view", 10.0, at), (4, 7, "view", 49.9, at), (5, 7, "view", None, at), (6, 7, "buy", 10.0, at), (7, 8, "view", 10.0, at), (8, 7, "view", 90.0, at + pd.Timedelta(days=1)), (9, None, "view", 90.0, at), (10, None, "view", 9.0, at)]
    events = pd.DataFrame(rows, columns=["event_id", "user_id", "event_type", "value", "ts"]).astype({"user_id": "Int64"})
    events.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    found = catalog.QUERIES["join25_contradictions"](spark, str(tmp_path))
    same(found, con.execute(catalog.ORACLE_SQL["join25_contradictions"]).df())
    assert sorted((r["first_id"], r["second_id"]) for r in found.collect()) == [(1, 3), (1, 4), (2, 3), (2, 4)]
