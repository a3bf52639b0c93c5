"""Compression bands and license scans."""

import random
import re
import string
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from tallyforge.llm import license_scan as L
from tallyforge.llm.quality import duplicate_lines, quality_rules, repeated_words


def slow_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    return len({j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)})


def test_repeats_by_definition(monkeypatch):
    rng = random.Random(4)
    for n in (0, 3, 5, 6, 40, 300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(n)]
        assert repeated_words(words) == slow_repeats(words)
    long = [b"%d" % rng.randrange(40_000) for _ in range(60_000)]
    long += long[:20]
    assert repeated_words(long) == slow_repeats(long)
    assert duplicate_lines(b"a\n\n \na\nb\na") == 2


def test_quality_rows_and_edges(spark):
    rng = random.Random(7)
    prose = " ".join("".join(rng.choice(string.ascii_lowercase[:12]) for _ in range(rng.randrange(2, 9))) for _ in range(900))
    noise = " ".join("".join(rng.choice(string.ascii_letters + string.digits + "+/é") for _ in range(60)) for _ in range(400))
    unique = "\n".join(f"{i} row {i} kind {i} " + "=" * 300 for i in range(100))
    rows = [(1, prose), (2, noise), (3, "again and again " * 200), (4, None), (5, ""), (6, "few words"), (7, unique), (8, prose), (8, prose), (None, prose), (9, "x" * 3_000_000)]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string").withColumn("ratio", F.lit(1)).select("doc_id", "text", "ratio")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["kept"] and by[None]["kept"] and by[1]["ratio"] == pytest.approx(len(zstandard.ZstdCompressor(level=3).compress(prose.encode())) / len(prose))
    assert by[3]["base_failed"] and not by[3]["kept"] and by[6]["base_failed"]
    assert by[4]["n_words"] == 0 and by[4]["base_failed"] and by[4]["ratio"] is None and by[5]["n_words"] == 0
    assert by[7]["reason"] == "repetitive" and not by[7]["base_failed"]
    assert by[1]["word_chars"] == len(re.sub(r"[\x20\x09-\x0D]", "", prose)) and by[2]["word_chars"] == len(noise.replace(" ", ""))
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def slow_verdict(text):
    """kept, by the rules as they read, with numbers written out."""
    data = (text or "").encode()
    words = data.split()
    if len(words) < 10 or 100 * slow_repeats(words) > 20 * len(words):
        return False
    packer = zstandard.ZstdCompressor(level=3)

    def outside(part, top):
        ratio, n = len(packer.compress(part)) / len(part), len(part)
        steps = [(0, 0.0, 99.0), (20, 0.3, 2.0), (100, 0.25, 1.2), (250, 0.25, 0.95), (500, 0.25, 0.85), *top]
        low, high = max(s for s in steps if s[0] <= n)[1:]
        return ratio < low, ratio > high

    if any(outside(data, [(2000, 0.22, 0.74), (10000, 0.18, 0.72)])):
        return False
    parts = [data[i : i + 4096] for i in range(0, len(data), 4096)] if len(data) > 4096 else []
    found = [outside(p, [(2000, 0.2, 0.74)]) for p in parts]
    return all(4 * sum(f[k] for f in found) <= len(parts) for k in (0, 1))


def test_verdicts_by_brute_force(spark):
    """Prose with tails of noise or repeats of all lengths, around the chunks' edges."""
    rng = random.Random(11)
    prose = " ".join("".join(rng.choice(string.ascii_lowercase[:12]) for _ in range(rng.randrange(2, 9))) for _ in range(4000))
    noise = "".join(rng.choice(string.ascii_letters + string.digits + "+/") + " " * (i % 61 == 60) for i in range(30_000))
    rows, at = [], 0
    for n in (50, 90, 99, 100, 499, 500, 1999, 2000, 4095, 4096, 4097, 8191, 8192, 9000, 12_000, 20_000):
        for tail in ("", noise[:2000], noise[:4095], noise[: n // 2], noise[:n] * 3, "x" * 3000 + " end", "word " * 12, "=" * n):
            rows.append((at, prose[:n] + tail))
            at += 1
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i]["kept"] for i, _ in rows} == {i: slow_verdict(t) for i, t in rows}
    assert {got[i]["n_chunks"] for i, t in rows if len(t) == 8191} == {2} and len({r["reason"] for r in got.values()}) == 4


def phrases(words):
    out = []
    for phrase, label in L.PHRASES.items():
        p = [x.encode() for x in phrase.split()]
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return sorted(out)


def test_license_phrases_by_definition():
    text = b"The MIT license, mit-license; Apache License GNU General Public License. CC BY-NC cc by cc by"
    words = L.words_of(text)
    assert sorted(L.base_places(words)) == phrases(words) and len(words) == 18


def test_license_labels_and_edges(spark):
    mit = next(t for n, t in L.TEMPLATES if n == "mit" and len(t) > 100)
    gpl = next(t for n, t in L.TEMPLATES if n == "gpl" and len(t) > 100)
    changed = mit.replace("deal in", "handle").replace("merge, ", "")
    rows = [(1, "x " * 50 + mit + " y" * 50), (2, changed), (3, gpl), (4, "nothing of the kind here at all"), (5, None), (6, ""), (7, "Licensed under CC BY-NC 4.0."), (8, "to use a copy of the software for any purpose"), (8, "cc by"), (None, mit), (9, " ".join(mit.split()[:50]))]
    got = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(0)).withColumn("labels", F.lit(0))).collect()
    labels = sorted(((r["doc_id"], r["labels"]) for r in got), key=repr)
    assert labels == sorted([(1, "mit"), (2, "mit"), (3, "gpl"), (4, ""), (5, ""), (6, ""), (7, "cc-by,cc-by-nc"), (8, ""), (8, "cc-by"), (None, "mit"), (9, "mit")], key=repr)
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "") for r in got)
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def slow_labels(text, templates):
    """All windows of each template's length against the template, in-order words by dynamic programming; the best stretch of a place wins."""
    words = L.words_of(text.encode())

    def same(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], max(row[j + 1], row[j], last + 1 if x == y else 0)
        return row[-1]

    found = []
    for label, t in templates:
        body = L.words_of(t.encode())
        for at in range(max(1, len(words) - len(body) + 1)):
            share = same(words[at : at + len(body)], body) / len(body)
            if share >= (1.0 if len(body) <= 16 else 0.8):
                found.append((share, len(body), label, at, at + len(body) - 1))
    return sorted({r[2] for r in found if not any(x[:2] > r[:2] and x[3] <= r[4] and r[3] <= x[4] for x in found)})


def test_license_labels_by_brute_force(spark):
    rng = random.Random(12)
    own = [("a", "one two three four five"), ("b", " ".join(f"w{i}" for i in range(30))), ("c", "one two three four six"), ("d", " ".join(f"v{i}" for i in range(50)))]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            body = rng.choice(own)[1].split()
            for _ in range(rng.randrange(3)):
                body[rng.randrange(len(body))] = rng.choice(["zz", "w3", "two"])
            parts += ["filler", "words"] * rng.randrange(4) + body
        rows.append((i, " ".join([*parts, "tail"])))
    got = {r["doc_id"]: r["labels"] for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=own).collect()}
    want = {i: ",".join(slow_labels(t, own)) for i, t in rows}
    assert sum(v != "" for v in want.values()) > 20 and got == want


def test_license_scan_of_very_long_texts(spark):
    """Linear in the text: 20 MB with hits all over, and a notice that repeats itself."""
    import time

    mit = next(t for n, t in L.TEMPLATES if n == "mit" and len(t) > 100)
    rows = [(1, "released under the mit license again and " * 480_000), (2, (mit + " ") * 2000), (3, "the license the license " * 100_000)]
    began = time.time()
    got = {r["doc_id"]: r for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_base"] == 480_000 and got[1]["first_word"] == 3 and got[1]["last_word"] == 3 + 7 * 479_999 and got[1]["labels"] == got[2]["labels"] == "mit"
    assert got[3]["labels"] == "" and got[3]["n_words"] == 400_000 and time.time() - began < 300
