"""Directly addressable codes against plain lists, and files of tokens against the tokenizer."""

import random
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import token_store as T

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def sample(seed, n):
    rng = random.Random(seed)
    return [rng.choice([0, 1, rng.getrandbits(rng.choice([3, 8, 9, 16, 17, 32]) if seed % 2 else rng.choice([2, 12, 16]))]) for _ in range(n)]


@pytest.mark.parametrize("seed,n", [(1, 0), (2, 1), (1, 2), (3, 511), (4, 512), (5, 513), (6, 5000), (7, 3000), (8, 70_000)])
def test_every_id_and_every_range_reads_back(seed, n):
    ids = sample(seed, n)
    raw = T.encoded(np.array(ids, "<u4"), [(None, 0, False)])
    s = T.Segment(np.frombuffer(b"xyz" + raw + b"more", np.uint8), 3)
    assert s.n == n and s.size == len(raw) and raw.endswith(b"\n")
    rng = random.Random(seed)
    some = range(n) if n < 6000 else rng.sample(range(n), 3000)
    assert [s[i] for i in some] == [ids[i] for i in some]
    for _ in range(50):
        a, b = sorted((rng.randint(0, n), rng.randint(0, n)))
        assert s.ids(a, b).tolist() == ids[a:b]
    for i in (-1, n):
        with pytest.raises(IndexError):
            s[i]


def test_a_single_id_takes_one_chunk_and_one_rank_a_level():
    """No level is unpacked: reading one id touches a few bytes of each level."""
    ids = np.array(sample(8, 50_000), "<u4")
    s = T.Segment(np.frombuffer(T.encoded(ids, []), np.uint8))
    touched = 0

    class Watched(np.ndarray):
        def __getitem__(self, key):
            nonlocal touched
            found = super().__getitem__(key)
            touched += getattr(found, "nbytes", 1)
            return found

    s.levels = [(w, c.view(Watched), b if b is None else b.view(Watched), r) for w, c, b, r in s.levels]
    assert s[49_999] == ids[49_999] and touched <= len(s.levels) * (T.RANK_BITS // 8 + 8)


@pytest.mark.parametrize("seed", range(8))
def test_widths_are_the_best(seed):
    rng = random.Random(seed)
    top = rng.randint(1, 9)
    counts = np.array([0, *(rng.choice([0, 1, 5, 100, 1000]) for _ in range(top))])
    if not counts.any():
        counts[1] = 1
    top = int(np.flatnonzero(counts)[-1])

    def cost(widths):
        total, at = 0, 0
        for k, w in enumerate(widths):
            total += counts[at + 1 :].sum() * (w + (1 + 32 / T.RANK_BITS if k < len(widths) - 1 else 0))
            at += w
        return total

    every = [[w for w in ws if w] for k in range(1, top + 1) for ws in product(range(1, top + 1), repeat=k) if sum(ws) == top] if top <= 6 else None
    own = T.best_widths(counts)
    assert sum(own) == top
    if every:
        assert cost(own) == min(map(cost, every))
    assert T.lengths_of(np.array([0, 1, 2, 3, 4, 255, 256, 2**32 - 1], "<u4"))[[1, 2, 3, 8, 9, 32]].tolist() == [2, 2, 1, 1, 1, 1]
    assert T.lengths_of(np.array([0, 1, 2, 3, 4, 255, 256], "<u4"))[:10].tolist() == [0, 2, 2, 1, 0, 0, 0, 0, 1, 1]


def test_broken_files_raise():
    raw = T.encoded(np.arange(100, dtype="<u4"), [(1, 0, False)])
    for bad in (raw[:-1], b"XXXX" + raw[4:], raw + b"tail"):
        with pytest.raises((ValueError, IndexError)):
            list(T.segments_in(np.frombuffer(bad, np.uint8)))


LONG = "Word salad 123 naïve. " * 3000
ROWS = [(3, "The cat sat."), (1, None), (2, ""), (10, LONG), (5, "same"), (5, "same"), (5, "other"), (None, "no id here"), (None, None), (-4, "minus\nfour <|endoftext|>"), (7, "漢字 é\x00")]


@pytest.fixture(scope="module")
def want():
    tokenizer = T.WordIds(PATH).tokenizer
    return sorted(((i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in ROWS), key=lambda x: (x[0] is not None, x[0] or 0))


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("segment_ids,file_bytes", [(T.SEGMENT_IDS, T.FILE_BYTES), (7, 40), (1000, 300)])
def test_documents_and_single_tokens_come_back(spark, tmp_path, want, segment_ids, file_bytes):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("start", F.lit("clash")).withColumn("a.b", F.lit(1)).repartition(3)
    path = str(tmp_path / "tokens")
    T.write_tokens(docs, path, PATH, segment_ids=segment_ids, file_bytes=file_bytes)
    got = sorted(T.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((repr(i), len(ids), digest(ids)) for i, ids in want)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    rng = random.Random(1)
    asked = [0, at - 1, at, -1, *(rng.randrange(at) for _ in range(200))]
    found = {r["position"]: r["id"] for r in T.tokens_at(spark, path, spark.createDataFrame([(p,) for p in asked], "position long"), segment_ids).collect()}
    whole = [x for r in got for x in next(ids for i, ids in want if i == r["doc_id"] and len(ids) == r["n_tokens"] and digest(ids) == r["ids_crc32"])]
    assert found == {p: whole[p] for p in asked if 0 <= p < at}


def test_an_empty_table_writes_nothing_to_read(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.store_documents(docs, str(tmp_path / "none"), PATH).count() == 0


def test_the_query_has_every_document_in_order(spark):
    from ..conftest import SF

    got = sorted(T.op11_token_store(spark, SF).collect(), key=lambda r: r["start"])
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokenizer, at = T.WordIds(PATH).tokenizer, 0
    assert [r["doc_id"] for r in got] == sorted(docs)
    for r in got:
        ids = [*tokenizer.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), digest(ids))
        at += len(ids)
