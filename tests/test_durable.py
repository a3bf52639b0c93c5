"""Streams that meet their history, tables that only grow, canonical spellings."""

import datetime
import hashlib
import json
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.canonical import canonical_json, precise, vector_digest
from tallyforge.operators.ledger import Ledger, Refused, Tampered
from tallyforge.streaming.histories import closed_sums, driven, running_counts, superseding, versions

ITEMS = [(i, i % 4, "ab"[i % 2] if i % 5 else None, datetime.date(2024, 1, 1 + i * 7 % 11)) for i in range(60)]
SCHEMA = "item int, member int, topic string, fetched date"


def expected():
    out = {}
    for i, m, t, d in ITEMS:
        newer = min((x[3] for x in ITEMS if x[1:3] == (m, t) and x[3] > d), default=None)
        out[i] = min((x[0] for x in ITEMS if x[1:3] == (m, t) and x[3] == newer), default=None)
    return out


def write(spark, path, n, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/step={n}")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_supersession_is_the_same_in_any_order_of_arrival(spark, tmp_path, seed):
    rows = ITEMS[:]
    random.Random(seed).shuffle(rows)
    source, table = f"{tmp_path}/in", f"{tmp_path}/table"
    for n in range(3):
        write(spark, source, n, rows[n * 20 : n * 20 + 20], SCHEMA)
        # Started anew for every batch: it goes on where it ended.
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/step=*")
        driven(stream, superseding(table, ["member", "topic"], "fetched"), str(tmp_path))
    found = versions(spark, table, stream.schema, ["member", "topic"], "fetched", "item").collect()
    assert {r["item"]: r["superseded_by"] for r in found} == expected() and len(found) == len(ITEMS)


def test_a_batch_tried_again_changes_nothing(spark, tmp_path):
    put = superseding(str(tmp_path), ["member", "topic"], "fetched")
    df = lambda a, b: spark.createDataFrame(ITEMS[a:b], SCHEMA)
    for n, (a, b) in [(0, (0, 30)), (1, (30, 60)), (1, (30, 60))]:
        put(df(a, b), n)
    found = versions(spark, str(tmp_path), df(0, 1).schema, ["member", "topic"], "fetched", "item")
    assert {r["item"]: r["superseded_by"] for r in found.collect()} == expected()


def test_counts_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    """Events of a day come in several batches, the stream is started anew in between, and a row that comes too late counts no more."""
    day = lambda d: datetime.datetime(2024, 1, 1 + d)
    rows = [(i, i % 3, i % 7, day(i // 10), i % 2) for i in range(60)]
    batches = [rows[:25], rows[25:33], rows[33:], [(99, 0, 0, day(0), 1), (-1, None, None, day(20), 0)], [(-2, None, None, day(25), 0)]]
    schema = "id int, party int, member int, at timestamp, outcome int"
    for n, own in enumerate(batches):
        write(spark, f"{tmp_path}/in", n, own, schema)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/step=*")
        driven(closed_sums(stream, {"all": F.lit("x"), "party": F.col("party"), "member": F.col("member")}, "at", "outcome"), running_counts(f"{tmp_path}/t"), str(tmp_path))
    found = {(r["level"], r["key"], r["at"]): (r["yes"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/t/counts/batch=*").collect()}
    for _, p, m, at, _ in rows:
        for level, key, same in (("all", "x", lambda r: True), ("party", str(p), lambda r: r[1] == p), ("member", str(m), lambda r: r[2] == m)):  # noqa: B023
            before = [r[4] for r in rows if same(r) and r[3] < at]
            assert found[level, key, at] == (sum(before), len(before))


def test_a_ledger_adds_and_refuses(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), "k int, v string, x double", ["k"])
    df = lambda *rows: spark.createDataFrame(rows, "k int, v string, x double")
    assert ledger.rows().count() == 0 and ledger.append(df()) == 0
    assert ledger.append(df((1, "a", 1.0), (2, None, None), (1, "a", 1.0)), 0) == 1
    assert ledger.append(df((2, None, None))) == 1 and ledger.append(df((None, "null key", 0.0), (2, None, None))) == 2
    for bad, version in ((df((1, "b", 1.0)), None), (df((2, "", None)), None), (df((5, "a", 1.0), (5, "a", 2.0)), None), (df((6, "x", 1.0)), 1), (df((None, "other", 0.0)), None)):
        with pytest.raises(Refused):
            ledger.append(bad, version)
    assert sorted(map(repr, ledger.rows().collect())) == sorted(["Row(k=1, v='a', x=1.0)", "Row(k=2, v=None, x=None)", "Row(k=None, v='null key', x=0.0)"])
    # Two writers from one version: the log has room for one.
    assert ledger._create("log/00000000000000000002.json", json.dumps(ledger.entries()[0])) and not ledger._create("log/00000000000000000002.json", "{}")


def test_a_ledger_finds_edits(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), "k int, v string", ["k"])
    ledger.append(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    ledger.verify()
    folder = f"{tmp_path}/l/data/{ledger.entries()[0]['folder']}"
    spark.createDataFrame([(1, "a"), (2, "B")], "k int, v string").write.mode("overwrite").parquet(folder)
    for act in (ledger.verify, lambda: ledger.append(spark.createDataFrame([(3, "c")], "k int, v string"))):
        with pytest.raises(Tampered):
            act()


def digits17(x):
    if x == 0:
        return "0.0000000000000000"
    v, e = abs(Fraction(x)), 0
    while v >= 10 ** (e + 1):
        e += 1
    while v < Fraction(10) ** e:
        e -= 1
    n = int(v / Fraction(10) ** (e - 16) + Fraction(1, 2))
    if n == 10**17:
        n, e = 10**16, e + 1
    s, sign = str(n), "-" * (x < 0)
    if e < -6:
        return f"{sign}{s[0]}.{s[1:]}e{e}"
    return sign + (s[: e + 1] + "." * (e < 16) + s[e + 1 :] if e >= 0 else "0." + "0" * (-e - 1) + s)


def test_doubles_have_all_their_digits(spark):
    rng = random.Random(1)
    values = [rng.random() for _ in range(300)] + [10 ** rng.uniform(-8.9, 14.9) for _ in range(300)] + [0.0, -0.0, 1.0, 0.1, 0.5, 1e-6, 9.999999999999999e-7, 0.9999999999999999, 1 / 3, -2 / 3, 123456789.125, 1e15, 2.0**-20, 5e-9, 1e-9]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", precise(F.col("v")).alias("s")).collect()
    assert [(r["v"], r["s"]) for r in got] == [(v, digits17(v)) for v in values]
    odd = spark.createDataFrame([(1e-10,), (2e15,), (None,), (float("nan"),), (float("inf"),)], "v double").select(precise(F.col("v")).alias("s")).collect()
    assert all(r["s"] is None for r in odd)


def test_vector_digests_tell_the_last_bit_apart(spark):
    rows = [(1, 2, 0.1), (1, 10, 0.3), (2, 10, 0.3), (2, 2, 0.1), (3, 2, 0.1), (3, 10, 0.1 + 0.2), (4, 1, None)]
    got = {r["g"]: r["d"] for r in spark.createDataFrame(rows, "g int, id int, p double").groupBy("g").agg(vector_digest(F.col("id"), F.col("p")).alias("d")).collect()}
    assert got[1] == got[2] != got[3] and got[4] is None
    assert got[1] == hashlib.sha256(f"10:{digits17(0.3)}\n2:{digits17(0.1)}".encode()).hexdigest()


def test_json_of_equal_values_is_spelled_one_way(spark):
    texts = ['{"b":1,"a":{"d":[1,{"z":"1.0, x","y":2}],"c":null}}', '{ "a": {"c":null, "d":[1.0,{"y":2.00,"z":"1.0, x"}]}, "b":1e0}', "[3,2]", "no", None, '{"a":1,"a":2}', '"\\u00e9\\"1.0]"']
    got = [r["c"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(canonical_json(F.col("t")).alias("c")).collect()]
    assert got == ['{"a":{"c":null,"d":[1,{"y":2,"z":"1.0, x"}]},"b":1}'] * 2 + ["[3,2]", None, None, None, '"é\\"1.0]"']


def test_a_dossier_holds_the_first_rows_of_each_section(spark):
    from tallyforge.operators.dossier import dossiers, section

    votes = spark.createDataFrame([(1, d, f"v{d}", None) for d in range(9)] + [(2, 5, 'q"', 1), (None, 1, "x", 1), (1, 8, "v8", None)], "member_id int, day int, what string, n int")
    notes = spark.createDataFrame([(3, 1)], "member_id int, k int")
    members = spark.createDataFrame([(1,), (2,), (3,), (4,)], "member_id int")
    parts = {"votes": section(votes, "votes", [-F.col("day")], ["what", "n"], 3), "notes": section(notes, "notes", [F.col("k")], ["k"], 1)}
    got = {r["member_id"]: json.loads(r["document"]) for r in dossiers(members, parts).collect()}
    assert got[1] == {"votes": [{"what": w, "n": None} for w in ("v8", "v8", "v7")], "notes": []} and got[2] == {"votes": [{"what": 'q"', "n": 1}], "notes": []}
    assert got[3] == {"votes": [], "notes": [{"k": 1}]} and got[4] == {"votes": [], "notes": []}
    assert dossiers(members.where("false"), parts).count() == 0
