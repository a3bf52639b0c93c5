"""Packing and mixing against plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm.mixing import OP7_SQL, mix_sources, mixed_documents, targets
from tallyforge.llm.packing import WordIds, pack, pack_documents, plan_bins, token_pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return WordIds(PATH).tokenizer


ODD = ["Hello <|endoftext|> World <|ENDOFTEXT|>, don't can't'll!!", "é, हि, ÀÉ×, x÷. 12.5% (a) [b] {c} \"q\" İI ΣΑΣ. naïve… 'S 'RE' it's.", "a\x1cb c\x85d e ß! ", "<|x|>THE END.", "", "...", "x" * 300 + "!!!"]


def test_words_apart_give_the_ids_of_whole_texts(tokenizer, monkeypatch):
    own = WordIds(PATH)
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in ODD]
    assert own.encode([t.encode() for t in ODD]) == want
    monkeypatch.setattr("tallyforge.llm.packing.REMEMBERED", 3)
    assert [own.encode([t.encode()])[0] for t in ODD] == want


def test_words_at_once_are_the_words_one_by_one(tokenizer):
    from tallyforge.llm.packing import MARK

    own, rng = WordIds(PATH), random.Random(4)
    odd = [w for t in ODD for w in t.split()] + ["\u200b", "\x01", "\ufffd", "İ", "ﬁ", "e\u0301", "\u0301", "🙂", "<|endoftext|>", "x<|startoftext|>y", "'s", "１２"]
    words = odd + ["".join(rng.choice("abcdefghijzé漢0'.-\u0301ß") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    alone = [np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert own.each(words) == alone
    assert own.each([*words[:5], f"a{MARK}b", MARK, f"{MARK}{MARK}"])[:5] == alone[:5] and own.each([MARK]) == [own.mark.tobytes()] and own.each(["one"]) == [np.array(tokenizer.encode("one", add_special_tokens=False).ids, "<u4").tobytes()]


def test_plain_words_are_merged_without_whole_calls(tokenizer, monkeypatch):
    own, rng = WordIds(PATH), random.Random(5)
    letters = ["aeinrst'slr", "abcXYZ019.,!?'-#&<|>/", "éàüßñçÉÀÜÑÿþÐ'eas", "'revdmlts"]
    words = ["it's", "'S", "don't'll", "#'s", "a'\u00e9'd", "ÀÉß", "x.y/z-9", "<|", "|>", "\u00c3\u00e9", "y" * 300, *("".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(1, 14))) for _ in range(4000))]
    texts = [" ".join(words[i : i + 7]) for i in range(0, len(words), 7)]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    monkeypatch.setattr(own, "each", lambda words: pytest.fail("a whole call"))
    assert own.encode([t.encode() for t in texts]) == want


def test_broken_utf8_and_special_names_are_not_plain(tokenizer):
    own = WordIds(PATH)
    for word in (b"a\xc3", b"\xc3a\xa9", b"\xa9", b"\xc3\x97", b"\xc3\xb7", b"a\x01", b"a\x7f", b"x<|endoftext|>", "e\u0301".encode(), "漢".encode()):
        assert not own.known.is_plain(word)
        assert own.encode([word])[0] == np.array(tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()


def test_few_words_are_remembered_whatever_is_encoded_at_a_time():
    own, texts = WordIds(PATH, 100), [" ".join(f"{chr(97 + i % 26)}q{chr(97 + k)}{chr(97 + i // 26)}z" for k in range(20)) for i in range(60)]
    most = 0
    for n in (1, 60):
        got = own.encode([t.encode() for t in texts[:n]])
        most = max(most, len(own.known))
    assert got == [WordIds(PATH).encode([t.encode()])[0] for t in texts] and most <= 120
    before = len(own.known)
    own.encode([b"w" * 5000, ("漢" * 5000).encode()])
    assert len(own.known) == before


def bins_of(plan, counts, capacity):
    """Contents of each bin as (offset, length), by following the plan's rows."""
    bins = defaultdict(list)
    for length, n in counts.items():
        rows = [r for r in plan if r[0] == length]
        for rank in range(n):
            r = [x for x in rows if x[1] <= rank][-1]
            bins[r[2] + (rank - r[1]) // r[4]].append((r[5] + (rank - r[1]) % r[4] * length, length))
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_gapless_and_no_worse_than_first_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    sizes = [min(capacity, max(1, int(rng.expovariate(3 / capacity)))) if seed % 2 else rng.randint(1, capacity) for _ in range(400)]
    counts = Counter(sizes)
    plan, n = plan_bins(counts, capacity)
    bins = bins_of(plan, counts, capacity)
    assert len(bins) == n and sorted(x for own in bins.values() for _, x in own) == sorted(sizes)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity and sum(length > capacity // 3 for _, length in own) <= 2
    room = []
    for s in sorted(sizes, reverse=True):
        i = next((i for i, r in enumerate(room) if r >= s), None)
        if i is None:
            room.append(capacity - s)
        else:
            room[i] -= s
    assert math.ceil(sum(sizes) / capacity) <= n <= len(room) + 1


ROWS = [(1, "the cat sat"), (2, None), (3, ""), (4, "word " * 2500), (5, "a b c"), (5, "a b c"), (None, "no id"), (6, "x " * 4095)]


def test_documents_and_edges(spark, tokenizer):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = pack_documents(docs, PATH).collect()
    want = Counter()
    for i, t in ROWS:
        b = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        want.update((i, k // 8192, k // 4, len(b[k : k + 8192]) // 4, zlib.crc32(b[k : k + 8192])) for k in range(0, len(b), 8192))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 2048
    assert pack_documents(docs.where("false"), PATH).count() == 0


def test_ranks_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr("tallyforge.llm.packing.RANK_ROWS", 7)
    monkeypatch.setattr("tallyforge.llm.packing.WIDE_BUCKETS", 4)
    rows = [(i, 0, 0, 1 + i % 3, 0) for i in range(200)]
    got = pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), 5).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(got) == 200 and all(sorted(o for o, _ in b) == [sum(n for p, n in b if p < o) for o, _ in sorted(b)] for b in bins.values())
    assert len(bins) == math.ceil(sum(1 + i % 3 for i in range(200)) / 5)
    assert token_pieces(spark.createDataFrame([(1, "a")], "doc_id long, text string"), PATH, capacity=1).count() == 2


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), sum(sizes.values())
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
        if not free:
            return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_sharing_again_and_again(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 3, 10, 1000, 50_000]) for i in range(7)} | {None: 5, "é": 7}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in targets(rows).collect()}
    want = slow_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


DOCS = [(i, "w " * (i * 7 % 23), f"s{i % 3}") for i in range(120)] + [(500, "big " * 400, "s1"), (501, None, None), (502, "a b", None), (503, "", "empty"), (None, "x y z", "s0")]


def test_mixture_equals_its_sql_and_reaches_targets(spark, same, monkeypatch):
    import duckdb

    monkeypatch.setattr("tallyforge.llm.mixing.RANGE_ROWS", 5)
    monkeypatch.setattr("tallyforge.llm.mixing.WIDE_RANGES", 3)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mix_sources(docs)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    same(got.select("doc_id", "size", "source_size", "target", "taken"), con.execute(OP7_SQL).df())
    sums = defaultdict(int)
    for r in got.collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
        sums[r["source"]] += r["taken"]
        assert r["source_size"] == 0 or r["target"] <= 3 * r["source_size"]
    assert all(sums[r["source"]] == int(r["target"]) for r in got.collect())
    monkeypatch.setattr("tallyforge.llm.mixing.BROADCAST_SOURCES", -1)
    assert sorted(map(repr, mix_sources(docs).collect())) == sorted(map(repr, got.collect()))


def test_mixed_documents_hold_the_taken_words(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("key", F.lit(1))
    docs = docs.withColumn("a.b", F.lit("dot")).withColumn("row", F.lit(2)).withColumn("_row", F.lit(3)).withColumn("words", F.lit(4))
    taken = {r["doc_id"]: r["taken"] for r in mix_sources(docs).collect()}
    words = defaultdict(int)
    for r in mixed_documents(docs).collect():
        assert r.__fields__ == docs.columns and (r["size"], r["a.b"], r["row"], r["_row"], r["words"]) == ("clash", "dot", 2, 3, 4)
        words[r["doc_id"]] += len((r["text"] or "").split())
    assert {i: n for i, n in taken.items() if n} == dict(words)
    assert mixed_documents(docs.where("false")).count() == 0 and mix_sources(docs.where("false")).count() == 0


def test_equal_ids_share_the_cut(spark):
    rows = [(1, "a " * 10, "s0")] * 3 + [(2, "b " * 500, "s1")]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 4 and all(r["taken"] <= 3 * r["size"] for r in got)
