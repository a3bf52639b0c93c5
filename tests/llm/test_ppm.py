"""Byte tries, LM scoring and language ID against symbol-by-symbol versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm.common import id_remainder
from tallyforge.llm.language_id import identify, learn
from tallyforge.llm.lm_scoring import score_texts
from tallyforge.llm.ppm import PART, GramCounter, Lookup, gram_values, grams

ORDER = 3


def slow_counts(texts, order=ORDER):
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    for t in texts:
        s = b"\xff" * order + t + b"\xff"
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[k][s[i - k : i]][s[i]] += 1
    return seen


def slow_chance(seen, context, symbol, order=ORDER):
    p, gone = 1.0, set()
    for k in range(order, -1, -1):
        count = seen[k].get(context[len(context) - k :], {})
        left = {s: c for s, c in count.items() if s not in gone}
        total = sum(left.values()) + len(left)
        if symbol in left:
            return p * left[symbol] / total
        if left:
            p *= len(left) / total
        gone |= set(count)
    return p / (256 - len(gone))


def test_chances_of_all_symbols_sum_to_one(spark):
    texts = {"a": [b"abracadabra", b"banana", b"cab"], "b": [b"xyz"]}
    rows = []
    for name, own in texts.items():
        counter = GramCounter()
        for codes, _, _ in grams(own, ORDER):
            counter.add(codes)
        codes, n = counter.merged()
        rows += [(name, int(c), int(x)) for c, x in zip(codes, n)]
    learned = spark.createDataFrame(rows, "lang string, code long, n long")
    wanted = spark.range(256).select(F.explode(F.array(*(F.lit(int.from_bytes(c, "big") << 8) for c in (b"abr", b"zab", b"zzz", b"\xff\xff\xff")))).alias("context"), "id")
    wanted = wanted.select((F.col("context") + F.col("id")).alias("code"), F.explode(F.array(*map(F.lit, texts))).alias("lang")).join(learned, ["lang", "code"], "left")
    got = gram_values(wanted, learned, ORDER, "lang").groupBy("lang", F.shiftright("code", 8)).agg(F.sum(F.pow(F.lit(10.0), "value")).alias("p"), F.count("*").alias("n")).collect()
    assert len(got) == 8 and all(r["p"] == pytest.approx(1) and r["n"] == 256 for r in got)


@pytest.mark.parametrize("order", [0, 2, 4])
def test_a_long_text_in_pieces_has_the_same_grams(order, monkeypatch):
    texts = [b"x" * 10, b"", bytes(range(65, 91)) * 3, b"y"]
    whole = [c for codes, _, _ in grams(texts, order) for c in codes.tolist()]
    monkeypatch.setattr("tallyforge.llm.ppm.PART", 7)
    cut, owners = [], []
    for codes, starts, own in grams(texts, order):
        cut += codes.tolist()
        owners += own.tolist()
    assert cut == whole and set(owners) == {0, 1, 2, 3} and len(whole) == sum(len(t) + 1 for t in texts)
    assert PART == 1 << 20


def test_lookup_finds_what_it_knows():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 5000)).astype(np.uint64)
    look = Lookup(keys)
    assert (look.find(keys) == np.arange(len(keys))).all()
    assert (look.find(keys + np.uint64(1 << 41)) == -1).all()
    assert (Lookup(np.zeros(0, np.uint64)).find(keys) == -1).all()


def tokens(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low)) + [""]


ROWS = [(i, t, "x") for i, t in enumerate(["the cat sat", "the dog", None, "", "  \t", "The THE the", "ein hund été", "rare" * 40, "a\x85b c", "the cat sat"] * 3)] + [(None, "no id", "y"), (3, "", "z"), (3, "", "z")]


def test_scoring_base_and_edges(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string")
    got = score_texts(docs, id_remainder("doc_id", 7) != 2).collect()
    assert len(got) == len(ROWS)
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    c = Counter(w for i, t, _ in ROWS if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t, _ in ROWS)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    by_text = defaultdict(set)
    texts = {i: t for i, t, _ in ROWS}
    for r in got:
        if r["doc_id"] in texts:
            by_text[texts[r["doc_id"]]].add(round(r["score"], 9))
    assert all(len(s) == 1 for s in by_text.values())


def test_scoring_without_rare_tokens_shortcut(spark, monkeypatch):
    """With no token frequent enough to be broadcast, the join alone gives the same sums."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, other string")
    a = sorted(map(repr, score_texts(docs, F.lit(True)).select("doc_id", "n_known", F.round("base_score", 6)).collect()))
    monkeypatch.setattr("tallyforge.llm.lm_scoring.HOT_BITS", 0)
    assert a == sorted(map(repr, score_texts(docs, F.lit(True)).select("doc_id", "n_known", F.round("base_score", 6)).collect()))


def test_scoring_an_empty_table_and_without_training(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert score_texts(docs, F.lit(True)).count() == 0
    r = score_texts(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), F.lit(False)).first()
    assert r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == pytest.approx(-3 * math.log10(256))


WORDS = {"en": "the and of to that with this from", "fr": "le la des une dans pour avec été", "de": "der die und nicht für über ein ist"}


def test_language_id_on_held_out_text(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS[k].split()) for _ in range(12)), k) for i, k in enumerate(list(WORDS) * 40)]
    rows += [(900, None, "en"), (901, "", "fr"), (902, "123 $$ 4", "de"), (903, "the und", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("LANG_PRED", F.lit("old")).withColumn("rid", F.lit(1)).withColumn("keep", F.lit(2)).withColumn("pred", F.lit(3))
    learned = learn(docs.where(id_remainder("doc_id", 4) != 2))
    assert learned.names == ["de", "en", "fr"]
    got = {r["doc_id"]: r for r in identify(docs, learned).collect()}
    right = [got[i]["lang_pred"] == k for i, _, k in rows[:120]]
    assert sum(right) == 120
    assert all(got[i]["lang_pred"] == "und" and got[i]["lang_score"] == 0 for i in (900, 901, 902)) and got[903]["lang_pred"] in WORDS
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    assert learn(docs.where("false")).names == [] and identify(docs, learn(docs.where("false"))).where("lang_pred <> 'und'").count() == 0
    assert identify(docs.where("false"), learned).count() == 0


def test_scores_are_whole_however_few_grams_go_to_every_task(spark):
    """The chance of every text under the whole counts, by the definition: rarer grams meet theirs in a join, those never learned escape."""
    docs = spark.createDataFrame([*ROWS, (50, "zzz the cow\x01", "x")], "doc_id long, text string, other string")
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    seen = slow_counts([t.encode() for i, t in rows if not held(i)], 4)

    def slow(t):
        s = b"\xff" * 4 + t.encode() + b"\xff"
        return round(sum(math.log10(slow_chance(seen, s[i - 4 : i], s[i], 4)) for i in range(4, len(s))), 8)

    want = Counter((i, slow(t)) for i, t in rows)
    for bits in (21, 3):
        got = score_texts(docs, id_remainder("doc_id", 7) != 2, bits=bits).collect()
        assert Counter((r["doc_id"], round(r["score"], 8) + 0.0) for r in got) == want


def test_a_task_passes_on_what_it_holds(spark, monkeypatch):
    """Random bytes have hardly a gram twice: a task that may hold few passes them on in between, and the counts stay whole."""
    from tallyforge.llm import lm_scoring

    rng = random.Random(3)
    docs = spark.createDataFrame([(i, bytearray(rng.randbytes(300_000))) for i in range(4)] + [(9, bytearray(b"abc " * 20_000))], "doc_id long, text binary").coalesce(1)
    whole = {(r["token"], r["code"]): (r["n"], r["met"]) for r in lm_scoring.corpus_counts(docs, F.col("doc_id") != 1).collect()}
    monkeypatch.setattr(lm_scoring, "HELD_GRAMS", 1 << 16)
    monkeypatch.setattr(lm_scoring, "HELD_TOKENS", 100)
    assert {(r["token"], r["code"]): (r["n"], r["met"]) for r in lm_scoring.corpus_counts(docs, F.col("doc_id") != 1).collect()} == whole

    counter, most = GramCounter(), 1 << 16
    for _ in range(20):
        counter.add(np.array([rng.getrandbits(40) for _ in range(30_000)], np.uint64))
        if counter.full(most):
            counter.take()
        assert counter.held <= most + 30_000
    for _ in range(200):  # equal grams don't fill it
        counter.add(np.arange(20_000, dtype=np.uint64))
        assert counter.held <= 20_000 + most and (counter.held <= most or not counter.full(most))


def slow_languages(rows, learned_rows):
    """Prediction and score of every text by the definition, all languages learned whole."""
    low = lambda t: t.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    names = sorted({k for _, _, k in learned_rows if k is not None})
    seen = {k: slow_counts([low(t or "") for _, t, x in learned_rows if x == k]) for k in names}
    share = Counter(k for _, _, k in learned_rows if k is not None)
    out = {}
    for i, t, _ in rows:
        if not re.search(r"[^\W\d_]", t or ""):
            out[i] = ("und", 0.0)
            continue
        s = b"\xff" * ORDER + low(t) + b"\xff"
        total = [math.log10(share[k] / share.total()) + sum(math.log10(slow_chance(seen[k], s[j - ORDER : j], s[j])) for j in range(ORDER, len(s))) for k in names]
        best = max(range(len(names)), key=lambda k: (total[k], -k))
        out[i] = (names[best], 1 / sum(10 ** max(x - total[best], -300) for x in total))
    return out


@pytest.mark.parametrize("bits,width", [(None, 64), (2, 64), (3, 2)])
def test_languages_equal_the_definition(spark, bits, width, monkeypatch):
    """Many languages, some of one row; with most grams in a join, and sums in several rows."""
    monkeypatch.setattr("tallyforge.llm.language_id.WIDTH", width)
    rng = random.Random(6)
    words = WORDS | {"pl": "żółć gęślą jaźń", "es": "ñandú años niño", "xx": "aa bb", "x1": "aa bb"}
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(rng.randrange(6))), k) for i, k in enumerate(["en", "fr", "de"] * 8 + ["pl", "es", "xx", "x1"])]
    rows += [(100, None, "en"), (101, "", "fr"), (102, "12 $", "de"), (103, "Zażółć The \x01 ÿ", None), (104, "AA bb", None), (105, "niño " * 300, None), (106, "the le der", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = docs.where("doc_id % 4 <> 1 OR doc_id BETWEEN 24 AND 30")
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in identify(docs, learn(learned), bits=bits).collect()}
    want = slow_languages(rows, [r for r in rows if r[0] % 4 != 1 or 24 <= r[0] <= 30])
    assert {i: p for i, (p, _) in got.items()} == {i: p for i, (p, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], rel=1e-9) for i in want) and want[104][0] == "x1"


def test_the_stage_keeps_documents_where_no_language_is_named(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some text", None), (2, "12", None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()] == [1]
