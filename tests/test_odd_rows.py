"""Queries against their SQL on rows that small tables lack: odd letters, shared addresses, large ids, crowded events."""

import duckdb
import numpy as np
import pandas as pd

from tallyforge import catalog


def agrees(spark, same, tmp_path, name, **tables):
    """The query over these tables gives its SQL's rows; the number of rows."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.to_parquet(tmp_path / f"{table}.parquet", coerce_timestamps="us")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    same(catalog.QUERIES[name](spark, str(tmp_path)), want)
    return len(want)


def test_the_body_begins_at_its_marker_even_inside_a_word(spark, same, tmp_path):
    texts = ["Some first words, whereaster more words", "Plain words. Never be it enactedly done here", "A WHEREAS\nlater BE IT ENACTED", "K\u212aLM wİde w\u0130\u0130\u0130\u0130re \u0130 whereas \u212aindly", "", "plain words alone"]
    docs = pd.DataFrame({"doc_id": range(18), "text": [t for t in texts for _ in range(3)]})
    assert agrees(spark, same, tmp_path, "fn17_substantive_tokens", documents=docs) == 18


def test_a_letter_with_a_mark_ends_a_word(spark, same, tmp_path):
    texts = ["ñot so. Well ñnoé!", "nothing? Not.", "a_no no_ 7never", "Ünever, nó", None, ""]
    said = pd.DataFrame({"conv_id": range(6), "turn": 1, "role": "user", "text": texts})
    assert agrees(spark, same, tmp_path, "fn35_attributed_statements", conversations=said) == 6


def test_pages_that_share_an_address_have_their_own_captures(spark, same, tmp_path):
    pages = pd.DataFrame({"page_id": range(8), "url": ["http://a.b/c?x=1&y=2"] * 3 + ["https://d.e/", "https://d.e/", "plain", None, None]})
    assert agrees(spark, same, tmp_path, "src19_feeds", pages=pages) == 8


def many(first: int) -> pd.DataFrame:
    return pd.DataFrame({"event_id": range(first, first + 120)})


def test_statements_on_bills_of_seven_digits_and_more(spark, same, tmp_path):
    for first in (999_960, 10**18):
        assert agrees(spark, same, tmp_path, "fn38_explicit_statements", events=many(first)) == 72


def test_speeches_on_bills_of_seven_digits_and_more(spark, same, tmp_path):
    nations = pd.DataFrame({"n_nationkey": range(25), "n_name": [f"NATION_{i}" for i in range(25)]}).astype({"n_nationkey": "int32"})
    for first in (999_960, 10**18):
        assert agrees(spark, same, tmp_path, "fn35_speeches", events=many(first), nation=nations) == 72


def test_a_senate_list_stays_short_however_many_orders_a_journal_has(spark, same, tmp_path):
    orders = pd.DataFrame({"o_orderkey": [*range(200_000), 250_000, 250_001], "o_custkey": [1] * 200_001 + [2]})
    tables = {"customer": pd.DataFrame({"c_custkey": [1, 2], "c_nationkey": [0, 1]}), "nation": pd.DataFrame({"n_nationkey": [0, 1], "n_name": ["NATION_0", "NATION_1"]})}
    assert agrees(spark, same, tmp_path, "src18_appointments", orders=orders, **tables) == 600_006


def test_simulated_groups_draw_the_same_numbers_as_a_plain_loop_would():
    from tallyforge.operators import distribution as D

    b, runs = D.ShockBounds(2000, 7), 2000
    rng = np.random.default_rng(1)
    for n in (1, 5, 20, 300):
        p, of = rng.uniform(0.01, 0.99, n), rng.integers(0, 3, n)
        whole = b.normal(0, 0) * D.SHOCKS[0] + b.normal(1, 0) * D.SHOCKS[2]
        own = np.stack([b.normal(2, c) * D.SHOCKS[1] for c in range(3)], 1)[:, of]
        u = np.stack([np.random.default_rng([7, 3, i]).random(runs) for i in range(n)], 1)
        yes = (u < 1 / (1 + np.exp(-(np.log(p / (1 - p)) + whole[:, None] + own)))).sum(axis=1)
        assert np.array_equal(b.counts(np.log(p / (1 - p)), of), np.bincount(yes, minlength=n + 1))
        assert abs((b.counts(np.log(p / (1 - p)), of) @ np.arange(n + 1)) / runs / n - p.mean()) < 0.1
    assert len(b.kept) <= b.KEPT


def test_groups_with_equal_members_have_equal_simulations(spark):
    from tallyforge.operators.distribution import simulated

    rows = [(g, p, c) for g in (1, 2) for p, c in ((0.7, "x"), (0.2, "y"), (0.5, "x"))]
    a, b = sorted(map(tuple, simulated(spark.createDataFrame(rows, "g long, p double, party string"), "g").collect()))
    assert a[1:] == b[1:] and a[1] == 3


def test_analogues_of_copies_companions_and_others_in_blocks_of_any_size(spark, same, tmp_path):
    from pyspark.sql import functions as F

    from tallyforge.functions import text as T
    from tallyforge.functions.numeric import half_life
    from tallyforge.functions.similarity import floor_of, relationship, weighted_similarity
    from tallyforge.operators.analogues import analogue_pairs, compact
    from tallyforge.plans.texts import bills

    rng = np.random.default_rng(3)
    words = [*"school teachers tax credit hospital county license grants shall must water farm court voters union".split(), *(f"word{i}" for i in range(40))]
    texts = [" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(90)]
    docs = pd.DataFrame({"doc_id": range(240), "text": [texts[rng.integers(0, 90)] for _ in range(240)], "lang": rng.choice(["en", "de"], 240), "source": rng.choice(["a", "b", "c"], 240), "n_chars": 1})
    assert agrees(spark, same, tmp_path, "join18_analogues", documents=docs) > 100
    docs.loc[[7, 11, 20], ["text"]] = None
    docs.to_parquet(tmp_path / "documents.parquet")
    b = bills(spark, str(tmp_path))
    t, f = b.where("f.bill % 20 = 0").select(F.col("f").alias("t")), b
    pairs = t.join(f, (F.col("f.day") < F.col("t.day")) & (F.col("f.bill") != F.col("t.bill"))).select(F.col("t.bill").alias("a"), F.col("f.bill").alias("b"), relationship("t", "f").alias("relation"), weighted_similarity("t", "f").alias("similarity"))
    want = {(r["a"], r["b"]): (r["relation"], r["similarity"]) for r in pairs.where("relation IS NOT NULL OR similarity >= 0.18").collect()}
    small = b.select(compact("f", {"policy": T.POLICY_TERMS, "actions": T.ACTION_TERMS, "entities": T.ENTITY_TERMS}).alias("f"))
    targets = small.where("f.bill % 20 = 0")
    all_ = {(r["target"], r["candidate"]): (r["relation"], r["similarity"]) for r in analogue_pairs(targets, small, 1000, 0.18, 730.0, block_rows=37, group_rows=5).collect()}
    assert all_ == want
    ten = analogue_pairs(targets, small, 10, 0.18, 730.0).withColumn("score", F.greatest("similarity", floor_of(F.col("relation"))) * (0.75 + 0.25 * half_life(F.col("target_day") - F.col("day"), 730.0)))
    assert {(r["target"], r["candidate"]) for r in ten.collect()} < set(want) and ten.groupBy("target").count().where("count < 10").count() < 6


def test_versions_are_taken_apart_once(spark):
    from tallyforge.functions.parsing import tag

    from .conftest import SF

    plan = catalog.QUERIES["src09_text_versions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp" in line]
    texts = ["<A> x\n&amp; <b>y</b> </A><a>z</a>", "<n:a c='d'>1</n:a>", "<a></a>", "<a> &nbsp; </a><a>2</a>", "<a><![CDATA[3 & 4]]></a>", "<ab>5</ab>", "", None]
    got = [r["t"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, b string").select("i", tag("b", "a").alias("t")).orderBy("i").collect()]
    assert got == ["x & y", "1", None, None, "3 & 4", None, None, None]


def test_histories_within_fewer_columns_come_with_the_others(spark):
    from tallyforge.operators.rates import prior_counts

    rng = np.random.default_rng(4)
    rows = [(i, f"c{rng.integers(2)}", int(rng.integers(2)), f"m{rng.integers(4)}", None if i % 29 == 0 else int(rng.integers(9)), int(rng.integers(2))) for i in range(200)]
    votes = spark.createDataFrame(rows, "id int, chamber string, party int, member_id string, day int, outcome int")
    got = {r["id"]: r.asDict() for r in prior_counts(votes, ("chamber",), more={"all_": ()}).collect()}
    assert len(got) == 200
    for i, c, p, m, d, _ in rows:
        for lead, own in (("", [r for r in rows if r[1] == c]), ("all_", rows)):
            for short, kin in (("m", [r for r in own if r[3] == m]), ("p", [r for r in own if r[2] == p]), ("g", own)):
                before = [r[5] for r in kin if d is not None and (r[4] is None or r[4] < d)]
                assert (got[i][f"{lead}{short}_yes"], got[i][f"{lead}{short}_n"]) == (sum(before), len(before))


def crowded(sizes: list[int]) -> dict[str, pd.DataFrame]:
    """Tables of one event of each size, a vote a line."""
    rng = np.random.default_rng(6)
    line = pd.DataFrame({"l_orderkey": np.repeat(np.arange(len(sizes)), sizes)})
    n = len(line)
    line = line.assign(l_partkey=np.arange(n), l_suppkey=rng.integers(0, 9, n), l_linenumber=1, l_discount=rng.integers(0, 11, n) / 100, l_returnflag=rng.choice(list("RAN"), n), l_linestatus=rng.choice(list("OF"), n), l_tax=0.01)
    orders = pd.DataFrame({"o_orderkey": np.arange(len(sizes)), "o_orderdate": pd.Timestamp("1995-01-01") + pd.to_timedelta(np.arange(len(sizes)) // 2, "D"), "o_orderpriority": "1-URGENT"})
    return {"lineitem": line, "orders": orders, "supplier": pd.DataFrame({"s_suppkey": range(9), "s_nationkey": [0, 1, 2] * 3}), "nation": pd.DataFrame({"n_nationkey": range(3), "n_name": list("abc"), "n_regionkey": [0, 1, 1]})}


def test_events_of_twenty_members_and_more(spark, same, tmp_path):
    assert agrees(spark, same, tmp_path, "dst04_chamber", **crowded([3, 19, 20, 21, 1, 45, 20, 8])) == 8


def test_parts_meet_by_the_classes_of_their_titles(spark, same, tmp_path, monkeypatch):
    from tallyforge.plans import texts

    names = ["large ring", "ring large", "Ring bolt", "old plate", "", "12 of", None, "plate ring bolt", "large large ring"]
    part = pd.DataFrame({"p_partkey": range(90), "p_name": names * 10, "p_brand": (["a"] * 9 + ["b"] * 9 + [None] * 9) * 3 + ["a"] * 9})
    monkeypatch.setattr(texts, "PAIR_ROWS", 13)
    assert agrees(spark, same, tmp_path, "fn10_jaccard", part=part) > 100
