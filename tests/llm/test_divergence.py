"""Source divergence against a plain version in whole numbers, over all terms."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(rows, least=3, most=200):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        groups[lang].add(source)
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            parts = {"pair": [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s], "term": [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(items[: most if part == "term" else None], 1)]
    return sorted(out)


def rows_of(seed, n, sources, vocabulary):
    rng = random.Random(seed)
    words = [f"{'Wé'[i % 2]}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        text = rng.choice([" ", "-", "1", "\n", "_"]).join(rng.choice(words[: 1 + int(rng.expovariate(3 / vocabulary)) % vocabulary]) for _ in range(rng.randint(0, 30)))
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice([None, *(f"s{k}é" for k in range(sources))])))
    return rows


ODD = [(900, None, "en", "s0é"), (901, "", "xx", "a"), (902, None, "xx", "b"), (903, "ONCE only İ ſ ẞ", "yy", "one"), (904, "z" * 300_000 + " z " + "Wa " * 50_000, "en", "big"), (905, "same rows", "en", "s1é"), (905, "same rows", "en", "s1é"), (None, "same ROWS", "en", "s1é"), (906, "", "", ""), (907, "漢字 漢字x", "fr", "s0é")]


@pytest.mark.parametrize("seed,sources,block", [(1, 4, 48), (2, 9, 2), (3, 12, 5), (4, 1, 48)])
def test_audit_equals_the_plain_version(spark, monkeypatch, seed, sources, block):
    monkeypatch.setattr(D, "BLOCK_SOURCES", block)
    rows = rows_of(seed, 150, sources, 120) + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("term", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = D.audit_sources(docs)
    assert sorted(map(tuple, got.collect())) == slow(rows)


def test_ranks_stop_and_sql_agrees(spark, same):
    rows = rows_of(5, 200, 6, 300) + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = D.audit_sources(docs, most_ranks=7)
    assert sorted(map(tuple, got.collect())) == slow(rows, most=7)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    same(D.audit_sources(docs), con.execute(D.OP13_SQL).df())


def test_tasks_that_pass_their_counts_on_early_change_nothing(spark, monkeypatch):
    rows = rows_of(6, 120, 5, 200) + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name, value in (("HELD_TERMS", 20), ("HELD_PAIRS", 50), ("TERM_ROWS", 16)):
        monkeypatch.setattr(D, name, value)
    assert sorted(map(tuple, D.audit_sources(docs).collect())) == slow(rows)


def test_empty_table_and_one_group(spark):
    docs = spark.createDataFrame(rows_of(7, 5, 2, 10), "doc_id long, text string, lang string, source string")
    assert D.audit_sources(docs.where("false")).count() == 0
    lone = [(i, "one two", "en", "s") for i in range(3)]
    got = D.audit_sources(spark.createDataFrame(lone, "doc_id long, text string, lang string, source string")).collect()
    assert sorted(map(tuple, got)) == slow(lone) == []


def test_large_counts_stay_exact(spark):
    n, total, terms = 9 * 10**17, 9 * 10**17 + 12345, 678
    r = spark.range(1).select(D.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p"), D.divergence(F.lit(10**9 + 1).cast("long"), F.lit(1).cast("long")).alias("f")).first()
    assert r["p"] == 1 + 10**9 * (n + 1) // (total + terms) and r["f"] == 10**18
