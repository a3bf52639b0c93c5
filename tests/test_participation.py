"""Participation, issue rates and matched controls against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import controls as C
from tallyforge.operators.participation import on_issue, with_participation


def roster_rows(seed):
    rng = random.Random(seed)
    return [(i, f"m{rng.randrange(4)}", f"p{rng.randrange(2)}", rng.randrange(6), rng.random() < 0.8, rng.choice([0, 1])) for i in range(120)]


def test_chances_of_taking_part_and_of_a_yes(spark):
    rows = roster_rows(1)
    rows = [(i, m, "p" + m[-1:] if m < "m2" else "p0", d, t, o if t or i % 2 else None) for i, m, _, d, t, o in rows]
    got = with_participation(spark.createDataFrame(rows, "id int, member_id string, party string, day int, took_part boolean, outcome int")).collect()
    assert len(got) == len(rows)
    for r in got:
        of = lambda f: [x for x in rows if x[3] < r["day"] and f(x)]  # noqa: B023, E731
        yes, present = lambda xs: sum(x[5] for x in xs if x[4]), lambda xs: sum(x[4] for x in xs)
        own, party, every = of(lambda x: x[1] == r["member_id"]), of(lambda x: x[2] == r["party"]), of(lambda x: True)  # noqa: B023
        prior = next((yes(xs) / present(xs) for xs in (party, every) if present(xs)), 0.5)
        assert r["conditional"] == pytest.approx((yes(own) + 4 * prior) / (present(own) + 4))
        there = (present(party) + 25 * 0.98) / (len(party) + 25)
        assert r["present"] == pytest.approx((present(own) + 15 * there) / (len(own) + 15)) and r["p"] == pytest.approx(r["conditional"] * r["present"])


def test_absence_leaves_the_conditional_chance_and_lowers_the_other(spark):
    rows = [(i, m, "p", i, m == "there", 1 if m == "there" else None) for i in range(30) for m in ("there", "away")]
    got = {r["member_id"]: r for r in with_participation(spark.createDataFrame(rows, "id int, member_id string, party string, day int, took_part boolean, outcome int")).where("day = 29").collect()}
    assert got["away"]["present"] < 0.5 < got["there"]["present"] and got["away"]["p"] < got["there"]["p"] and got["away"]["conditional"] > 0.9
    assert with_participation(spark.createDataFrame([], "id int, member_id string, party string, day int, took_part boolean, outcome int")).count() == 0


def test_issue_histories_draw_forecasts(spark):
    rng = random.Random(2)
    rows = [(i, f"m{i % 3}", rng.choice(["a", "b", None]), rng.randrange(8), rng.choice([0, 1]), rng.random()) for i in range(90)]
    for r in on_issue(spark.createDataFrame(rows, "id int, member_id string, issue string, day int, outcome int, p double"), "issue").collect():
        own = [x[4] for x in rows if r["issue"] and x[1:3] == (r["member_id"], r["issue"]) and x[3] < r["day"]]
        w = min(len(own), 8)
        assert r["issue_p"] == pytest.approx((3 * r["p"] + w * (sum(own) / len(own))) / (3 + w) if own else r["p"])


@pytest.mark.parametrize("bucket,per_case", [(1 << 16, 1), (5, 1), (3, 2)])
def test_controls_are_of_the_stratum_and_none_twice(spark, monkeypatch, bucket, per_case):
    monkeypatch.setattr(C, "BUCKET_ROWS", bucket)
    rng = random.Random(3)
    cases = [(i, rng.choice(["x", "y", None]), 1) for i in range(60)]
    controls = [(1000 + i, rng.choice(["x", "x", "x", "y", "z", None]), 1) for i in range(80)]
    df = lambda rows: spark.createDataFrame(rows, "id int, s string, t int").repartition(3)
    got = C.matched(df(cases), df(controls), ["s", "t"], "id", per_case).collect()
    of, by = {**{i: s for i, s, _ in cases}, **{i: s for i, s, _ in controls}}, defaultdict(list)
    for r in got:
        assert of[r["case"]] == of[r["control"]] == r["s"]
        by[r["case"]].append(r["control"])
    used = [c for own in by.values() for c in own]
    assert len(used) == len(set(used)) and max(map(len, by.values())) <= per_case
    for s in {"x", "y", None}:
        a, b = sum(x[1] == s for x in cases), sum(x[1] == s for x in controls)
        assert sum(r["s"] == s for r in got) == min(a * per_case, b)
    again = C.matched(df(cases[::-1]), df(controls[::-1]), ["s", "t"], "id", per_case).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got)) and C.matched(df([]), df(controls), ["s", "t"], "id").count() == 0


def test_paired_estimates(spark):
    pairs = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("a", 0, 1), ("a", 1, 0), ("b", 1, 0)], "g string, x int, y int")
    a, b = C.paired_estimate(pairs, F.col("x"), F.col("y"), ["g"]).orderBy("g").collect()
    assert (a["pairs"], a["case_rate"], a["control_rate"], a["difference"], a["case_only"], a["control_only"]) == (4, 0.75, 0.5, 0.25, 2, 1)
    assert a["error"] == pytest.approx((((0.75**2) * 2 + 0.25**2 + 1.25**2) / 3 / 4) ** 0.5) and b["error"] is None
