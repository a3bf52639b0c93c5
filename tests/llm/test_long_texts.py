"""Texts of some megabytes and repeated rows, end to end, beside short ones."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm.language_id import identify, learn
from tallyforge.llm.lm_scoring import score_texts
from tallyforge.llm.mixing import mix_sources, mixed_documents
from tallyforge.llm.packing import WordIds, pack_documents
from tallyforge.llm.simhash import near_duplicates

public_tokenizers = pytest.importorskip("public_tokenizers")
rng = random.Random(13)
LONG = " ".join(rng.choice(["the", "house", "of", "words", "and", "été", "x" * 90]) + str(rng.randrange(300)) for _ in range(250_000))
ROWS = [(1, LONG, "en", "s0"), (2, "the house of words and the rest", "en", "s0"), (3, "le la des une dans pour", "fr", "s1"), (1, LONG, "en", "s0"), (3, "le la des une dans pour", "fr", "s1"), (4, "word" * 700_000, "fr", "s1")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3).cache()


def test_scores(docs):
    got = score_texts(docs, F.lit(True)).collect()
    tokens = [[*t.split(), ""] for _, t, _, _ in ROWS]
    c = Counter(w for own in tokens for w in own)
    n, v = c.total(), len(c)
    base = lambda own: round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), 4)
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == sorted((i, len(own), len(own), base(own)) for (i, *_), own in zip(ROWS, tokens))
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(round(r["score"], 3))
        assert -r["n_bytes"] * 3 < r["score"] < 0
    assert all(len(s) == 1 for s in by.values())


def test_languages(docs):
    got = identify(docs, learn(docs)).collect()
    assert len(got) == len(ROWS) and all(r["lang_pred"] == r["lang"] and 0 < r["lang_score"] <= 1 for r in got)


def test_fingerprints(docs):
    words = LONG.split()
    low = bytes(k + 32 if 65 <= k <= 90 else k for k in range(256))
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode().translate(low), 42) for i in range(len(words) - 3)], np.uint64)
    want = sum((2 * int((hashes >> np.uint64(k) & np.uint64(1)).sum()) > len(hashes)) << k for k in range(64))
    got = near_duplicates(docs).collect()
    assert len(got) == len(ROWS) and {r["fp"] % (1 << 64) for r in got if r["doc_id"] == 1} == {want} and all(r["component_id"] == r["doc_id"] for r in got)


def test_mixture(docs):
    sizes = {r["doc_id"]: r["size"] for r in mix_sources(docs).collect()}
    assert sizes == {i: len(t.split()) for i, t, _, _ in ROWS}
    assert mixed_documents(docs).where("doc_id = 1").count() >= 1


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = WordIds(path).tokenizer
    want = Counter()
    for i, t, _, _ in ROWS:
        b = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes()
        want.update((i, k // 8192, len(b[k : k + 8192]) // 4, zlib.crc32(b[k : k + 8192])) for k in range(0, len(b), 8192))
    got = pack_documents(docs, path).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == want
