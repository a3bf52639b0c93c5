"""Best-fit packing of token sequences by large-item matching.

Lengths are whole numbers up to the capacity, so the histogram of lengths, whose size doesn't depend on the corpus, decides the whole
packing: how many bins hold which lengths.  Pieces above one third of the capacity go at most two to a bin, by greedy matching; smaller
ones go, longest first, where they leave the least room.  Each piece then finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, bucket_count, column_bytes, gathered, map_texts, materialize, segments, slices, table

CAPACITY, END_ID = 2048, 0
#: Distinct words whose ids a Python worker remembers; then it forgets all but the quarter it met first, which has the common ones.  Longer words (bytes) are not remembered.
REMEMBERED, LONG = 1_200_000, 64
#: A letter that hardly any text has.
MARK = "\u01c2"
#: Words that are encoded at a time: what the tokenizer returns takes about a kilobyte each.
ENCODED = 4096
#: Pieces in a bucket of ranks, and buckets in a wide one.
RANK_ROWS, WIDE_BUCKETS = 1 << 14, 1 << 10


#: What a tokenizer does with a text before it merges bytes, if plain words can be cut here: it composes and lower-cases, and merges within RUNS only.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Printable ASCII and Latin-1 letters in UTF-8: words of these only are plain.  Their lower case (the second byte of such a letter stands nowhere else), and their runs.
PLAIN = re.compile(rb"(?:[!-~]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++").fullmatch
PLAIN_LOWER = bytes(c + 32 if 65 <= c <= 90 or 0x80 <= c <= 0x9E else c for c in range(256))
RUNS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^a-z0-9\x80-\xff]+").findall
UNPRINTED = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
#: The character that stands for each byte in such a tokenizer's vocabulary: those that can't be printed come after the others.
BYTE_CHARS = "".join(chr(256 + UNPRINTED.index(b)) if b in UNPRINTED else chr(b) for b in range(256))


class Known(dict):
    """Ids of words, as bytes; those of a plain word are worked out when they are asked for, any other that isn't there is a KeyError."""

    def __init__(self, tokenizer):
        own, model = json.loads(tokenizer.to_str()), tokenizer.model
        cuts = (own["normalizer"], own["pre_tokenizer"], own["model"]["type"], own["post_processor"]) == (NORMALIZER, PRE_TOKENIZER, "BPE", None)
        special = [t["content"].encode() for t in own["added_tokens"]]
        self.cuts = cuts and not any(t["normalized"] for t in own["added_tokens"]) and not any(map(bytes.isalpha, special))
        self.special = re.compile(b"|".join(map(re.escape, special)) or b"(?!)").search
        model._resize_cache(0)  # what it has met is remembered here
        self.merged = model.tokenize

    def is_plain(self, word: bytes) -> bool:
        return self.cuts and bool(PLAIN(word)) and not self.special(word)

    def runs(self, word: bytes) -> list[bytes]:
        if not self.is_plain(word):
            raise KeyError(word)
        return RUNS(word.translate(PLAIN_LOWER))

    def __missing__(self, word: bytes) -> bytes:
        runs = [word.lower()] if self.cuts and word.isalpha() else self.runs(word)
        if len(runs) == 1:
            ids = [t.id for t in self.merged(codecs.charmap_decode(runs[0], "strict", BYTE_CHARS)[0])]
            found = struct.pack(f"<{len(ids)}I", *ids)
        else:
            found = b"".join([self[r] for r in runs])
        if len(word) <= LONG:
            self[word] = found
        return found


class WordIds:
    """Ids of texts by a tokenizer that lower-cases and never joins across white space: each word is encoded once and its ids' bytes are kept.

    The runs of a plain word (see Known) go to the tokenizer's merging alone, which takes a third of the time of a whole call; this is for tokenizers that do just that with them.
    Of other words, trailing ASCII punctuation is encoded apart, which such a tokenizer does too after an ASCII or Latin-1 letter or a digit.
    """

    def __init__(self, path: str, remembered: int | None = None):
        self.remembered = remembered
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known(self.tokenizer)
        self.mark = np.array(self.tokenizer.encode(MARK, add_special_tokens=False).ids, "<u4")

    def each(self, words: list[str]) -> list[bytes]:
        """The ids of each word: of all as one text, with a mark between them that no word holds, as a call for each costs more than its work; word by word where the mark doesn't tell them apart."""
        text = f" {MARK} ".join(words)
        if text.count(MARK) == len(words) - 1:
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            n = len(self.mark)
            hit = np.ones(max(len(ids) - n + 1, 0), bool)
            for i, x in enumerate(self.mark):
                hit &= ids[i : i + len(hit)] == x
            places = np.flatnonzero(hit)
            if len(places) == len(words) - 1:
                data = ids.tobytes()
                begins, ends = np.append(0, places + n) * 4, np.append(places, len(ids)) * 4
                return [data[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, words: set[bytes]) -> None:
        cores = {w: core(w) for w in words}
        new = list({x for w, c in cores.items() for x in (c, w[len(c) :]) if x and x not in self.known})
        for at in range(0, len(new), ENCODED):
            some = new[at : at + ENCODED]
            self.known.update(zip(some, self.each([w.decode("utf-8", "replace") for w in some]), strict=True))
        self.known.update((w, self.known[c] + self.known[w[len(c) :]]) for w, c in cores.items() if c and len(c) < len(w))

    def joined(self, words: list[bytes]) -> bytes:
        if len(self.known) > (most := self.remembered or REMEMBERED):
            kept = list(islice(self.known.items(), most // 4))
            self.known.clear()
            self.known.update(kept)
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:  # some are not plain
            odd = {w for w in set(words).difference(self.known) if not self.known.is_plain(w)}
            self.learn(odd)
            found = b"".join(map(self.known.__getitem__, words))
            for w in odd:
                if len(w) > LONG:
                    self.known.pop(w, None)
                    self.known.pop(core(w), None)
            return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids."""
        # A special token's name is special in its own case only, and a text that may hold one keeps its case.
        return [b"".join([self.joined((s if b"<|" in t else s.translate(LOWER)).split()) for s in segments(t)]) for t in texts]


def core(word: bytes) -> bytes:
    """word without trailing ASCII punctuation (no apostrophes or brackets of special tokens), if what is left ends in an ASCII or Latin-1 letter or a digit."""
    c = word.rstrip(b'.,;:!?"#$%&*()[]{}/')
    if len(c) == len(word) or not c:
        return word
    plain = c[-1:].isalnum() or (len(c) > 1 and c[-2] == 0xC3 and c[-1] not in (0x97, 0xB7))
    return c if plain else word


_loaded: dict[tuple, WordIds] = {}


def token_pieces(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, remembered: int | None = None) -> DataFrame:
    """Per piece: doc_id, piece (from 0), start, length and ids_crc32.

    A document is its text's ids and end_id; null and empty texts are end_id alone.  Only documents over the capacity are cut.
    The tokenizer file must split at white space and drop it.  Its path must exist on every executor.
    """
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (tokenizer, remembered)
        ids = _loaded.get(own) or _loaded.setdefault(own, WordIds(*own))
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(gathered(batches, "_text"), "_text", 16 << 20):
            rows, texts = [], [t or b"" for t in column_bytes(batch, "_text")]
            for doc, data in zip(batch.column(0).to_pylist(), ids.encode(texts), strict=True):
                data += end
                rows += [(doc, i, i * capacity, len(p) // 4, zlib.crc32(p)) for i, p in enumerate(data[a : a + step] for a in range(0, len(data), step))]
            if not rows:
                continue
            found = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(found, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text"))
    return map_texts(chosen, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """From pieces by length, rows (length, first rank, first bin, bins, pieces a bin, offset), and the number of bins.

    The pieces of a row's length from first rank on fill its bins one by one.  Rows: a few tens of thousands at most, whatever the counts.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    total, bins, rows = left.copy(), 0, []
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: first bin, bins

    def put(length: int, n: int, first: int, count: int, per: int, offset: int) -> None:
        rows.append((length, total[length] - left[length], first, count, per, offset))
        left[length] -= n

    third = capacity // 3
    for length in range(capacity, third, -1):
        while left[length]:
            fit = min(length, capacity - length)
            partners = np.flatnonzero(left[third + 1 : fit + 1]) if fit > third else ()
            partner = third + 1 + int(partners[-1]) if len(partners) else 0
            if partner == length and left[length] == 1:
                partner = third + 1 + int(partners[-2]) if len(partners) > 1 else 0
            if partner == length:
                n = int(left[length]) // 2
                put(length, 2 * n, bins, n, 2, 0)
            else:
                n = int(min(left[length], left[partner])) if partner else int(left[length])
                put(length, n, bins, n, 1, 0)
                if partner:
                    put(partner, n, bins, n, 1, length)
            open_bins[capacity - length - partner].append((bins, n))
            bins += n
    for length in range(third, 0, -1):
        for room in range(length, capacity + 1):
            if not left[length]:
                break
            groups, open_bins[room] = open_bins[room], []
            for first, count in groups:
                per = room // length
                n = min(count, int(left[length]) // per)
                if n:
                    put(length, n * per, first, n, per, capacity - room)
                    open_bins[room - per * length].append((first, n))
                    first, count = first + n, count - n
                if count and 0 < left[length] < per:
                    rest = int(left[length])
                    put(length, rest, first, 1, rest, capacity - room)
                    open_bins[room - rest * length].append((first, 1))
                    first, count = first + 1, count - 1
                if count:
                    open_bins[room].append((first, count))
        per = capacity // length
        for n, each in ((int(left[length]) // per, per), (1, int(left[length]) % per)):
            if n and each:
                put(length, n * each, bins, n, each, 0)
                open_bins[capacity - each * length].append((bins, n))
                bins += n
    found = np.array(rows, np.int64).reshape(-1, 6)
    return found[np.lexsort((found[:, 1], found[:, 0]))], bins


def with_rank(pieces: DataFrame, rows: int) -> DataFrame:
    """pieces with rank: from 0 within each length.  A length's pieces are dealt to buckets by hash; to a piece's rank in its bucket the counts of earlier buckets are added,
    which are summed within wide buckets and over these."""
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(bucket_count(rows, RANK_ROWS))))
    counts = materialize(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("wide", F.floor(F.col("bucket") / WIDE_BUCKETS)))
    earlier = lambda *by: F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1])) - F.col("n")
    wide = counts.groupBy("length", "wide").agg(F.sum("n").alias("n")).withColumn("wide_before", earlier("length", "wide")).drop("n")
    before = counts.withColumn("own_before", earlier("length", "wide", "bucket")).join(wide, ["length", "wide"])
    before = before.select("length", "bucket", (F.col("own_before") + F.col("wide_before")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return dealt.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "bucket")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    No sequence exceeds the capacity; its pieces lie gapless from 0.  Equal pieces and null ids are packed like others; an empty table gives an empty one.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan, _ = plan_bins(counts, capacity)
    shared = pieces.sparkSession.sparkContext.broadcast(plan)
    ranked = with_rank(pieces, sum(counts.values()))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = shared.value
        keys = rows[:, 0] << 44 | rows[:, 1]
        for f in frames:
            row = rows[np.searchsorted(keys, f["length"].to_numpy() << 44 | f["rank"].to_numpy(), side="right") - 1]
            at = f["rank"].to_numpy() - row[:, 1]
            yield f.drop(columns="rank").assign(sequence_id=row[:, 2] + at // row[:, 4], offset=row[:, 5] + at % row[:, 4] * f["length"].to_numpy())

    columns = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.mapInPandas(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, remembered: int | None = None) -> DataFrame:
    """Pieces of all documents with their places; null texts, ties, repeats and empty tables as in token_pieces and pack; remembered: words whose ids a Python worker keeps (REMEMBERED if not given)."""
    return pack(materialize(token_pieces(docs, tokenizer, text, doc_id, capacity, remembered=remembered)), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces; see token_pieces for nulls and long texts, pack for ties, repeats and empty tables."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
