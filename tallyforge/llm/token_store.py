"""Token ids in files of directly addressable codes.

An id is cut into chunks, lowest bits first.  All first chunks stand in level 1, all second chunks in level 2, and so on; beside each level but the last stands a bitmap
that tells for each chunk whether its id goes on in the next level, with a directory of the bitmap's ranks.  So id i of a segment is found by one chunk and one rank a
level, and nothing else is decoded.

A file is a row of segments of up to SEGMENT_IDS ids, each with chunk widths of its own (the best for its ids) and a table of its documents.  Documents are in ascending order of
their ids, nulls first, over all files.  Numbers are little-endian; an array that follows another begins right after it:

    4 bytes DAC1, then u32: bytes of the segment, ids, documents, levels
    u8 widths, one a level
    documents: i64 ids, u8 flags (1: id is null, 2: goes on from the segment before), u32 starts in the segment
    each level: u32 chunks, the chunks' bits (lowest first); but for the last, the bitmap and u32 ranks before every RANK_BITS bits
    one byte, a line feed
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_count, column_bytes, map_texts, materialize, scratch, slices, table
from .packing import WordIds

MAGIC, END_ID, RANK_BITS = b"DAC1", 2, 512
#: Ids in a segment, bytes of texts whose ids make up a file (about half as large), ids that are decoded at a time.
SEGMENT_IDS, FILE_BYTES, DECODED = 1 << 20, 32 << 20, 1 << 17
BROADCAST_ROWS = 100_000
#: Words that a Python worker remembers, and bytes of texts that it takes at a time.
REMEMBERED, SLICE_BYTES = 1_200_000, 2 << 20
NULL_ID, GOES_ON = 1, 2


def lengths_of(ids: np.ndarray) -> np.ndarray:
    """How many ids have 0 (none), 1, 2, ... 32 bits; 0 has one."""
    edges = np.concatenate([[0], 2 ** np.arange(1, 33, dtype=np.uint64)])
    if len(ids) and ids.max() < 1 << 20:
        upto = np.concatenate([[0], np.cumsum(np.bincount(ids))])
        return np.concatenate([[0], np.diff(upto[np.minimum(edges, len(upto) - 1).astype(np.int64)])])
    return np.concatenate([[0], np.histogram(ids.astype(np.uint64), edges)[0]])


def best_widths(counts: np.ndarray) -> list[int]:
    """Chunk widths that take the fewest bits for ids of which counts[b] have b bits, bitmaps and their ranks included."""
    top = max(1, int(np.flatnonzero(counts)[-1]) if counts.any() else 1)
    over = [int(counts[b + 1 :].sum()) for b in range(top)]  # ids that have more than b bits
    cost, step = [0.0] * (top + 1), [0] * top
    for b in range(top - 1, -1, -1):
        cost[b], step[b] = min((over[b] * (e - b + (1 + 32 / RANK_BITS if e < top else 0)) + cost[e], e) for e in range(b + 1, top + 1))
    widths, b = [], 0
    while b < top:
        widths.append(step[b] - b)
        b = step[b]
    return widths


def packed_bits(values: np.ndarray, width: int) -> bytes:
    """The lowest width bits of u32 values, one after the other."""
    if width in (8, 16, 32):
        return values.astype(f"<u{width // 8}").tobytes()
    parts = [np.packbits(np.unpackbits(values[i : i + DECODED].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little"), bitorder="little").tobytes() for i in range(0, len(values), DECODED)]
    return b"".join(parts)  # DECODED is a multiple of 8, so parts end on whole bytes


def unpacked_bits(data: np.ndarray, first: int, last: int, width: int) -> np.ndarray:
    """Values first to last (not included) of packed_bits."""
    if width in (8, 16, 32):
        size = width // 8
        return data[first * size : last * size].view(f"<u{size}").astype(np.uint32)
    begin = first * width
    bits = np.unpackbits(data[begin // 8 : (last * width + 7) // 8], bitorder="little")[begin % 8 :][: (last - first) * width].reshape(-1, width)
    whole = np.zeros((last - first, 32), np.uint8)
    whole[:, :width] = bits
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()


def encoded(ids: np.ndarray, docs: list[tuple[int | None, int, bool]]) -> bytes:
    """A segment of ids (u32).  docs: document id, its start among ids, whether it goes on from the segment before."""
    widths = best_widths(lengths_of(ids))
    flags = [NULL_ID * (d is None) | GOES_ON * on for d, _, on in docs]
    parts = [bytes(widths), np.array([d or 0 for d, _, _ in docs], "<i8").tobytes(), bytes(flags), np.array([s for _, s, _ in docs], "<u4").tobytes()]
    left = ids
    for level, width in enumerate(widths):
        parts += [np.array([len(left)], "<u4").tobytes(), packed_bits(left, width)]
        if level < len(widths) - 1:
            rest = left >> np.uint32(width)
            more = rest > 0
            bitmap = np.packbits(more, bitorder="little")
            blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
            parts += [bitmap.tobytes(), np.concatenate([[0], np.cumsum(blocks)]).astype("<u4").tobytes()]
            left = rest[more]
    size = 20 + sum(map(len, parts)) + 1
    return b"".join((MAGIC, np.array([size, len(ids), len(docs), len(widths)], "<u4").tobytes(), *parts, b"\n"))


class Segment:
    """A segment in a buffer of bytes, of which nothing is decoded but what is asked for."""

    def __init__(self, data: np.ndarray, at: int = 0):
        if bytes(data[at : at + 4]) != MAGIC:
            raise ValueError("no segment where one should begin")
        self.size, self.n, n_docs, n_levels = (int(x) for x in data[at + 4 : at + 20].view("<u4"))
        if at + self.size > len(data) or data[at + self.size - 1] != 10:
            raise ValueError("a segment is cut off")
        self.levels, at = [], at + 20

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            size = n * np.dtype(kind).itemsize
            found, at = data[at : at + size], at + size
            return found.view(kind)

        widths = [int(w) for w in take(n_levels, "u1")]
        self.doc_ids, self.flags, self.starts = take(n_docs, "<i8"), take(n_docs, "u1"), take(n_docs, "<u4")
        for level, width in enumerate(widths):
            n = int(take(1, "<u4")[0])
            chunks = take((n * width + 7) // 8, "u1")
            last = level == n_levels - 1
            self.levels.append((width, chunks, None if last else take((n + 7) // 8, "u1"), None if last else take(-(-n // RANK_BITS) + 1, "<u4")))

    def rank(self, level: int, i: int) -> int:
        """How many of the first i ids of a level go on."""
        _, _, bitmap, ranks = self.levels[level]
        block = i // RANK_BITS
        part = int.from_bytes(bitmap[block * RANK_BITS // 8 : (i + 7) // 8].tobytes(), "little") & ((1 << i % RANK_BITS) - 1)
        return int(ranks[block]) + part.bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for level, (width, chunks, bitmap, _) in enumerate(self.levels):
            first = i * width
            raw = int.from_bytes(chunks[first // 8 : (first + width + 7) // 8].tobytes(), "little")
            value |= (raw >> first % 8 & ((1 << width) - 1)) << shift
            if bitmap is None or not bitmap[i // 8] >> i % 8 & 1:
                break
            i, shift = self.rank(level, i), shift + width
        return value

    def ids(self, first: int, last: int, level: int = 0) -> np.ndarray:
        """Ids first to last (not included)."""
        width, chunks, bitmap, _ = self.levels[level]
        found = unpacked_bits(chunks, first, last, width)
        if bitmap is not None:
            more = np.flatnonzero(np.unpackbits(bitmap[first // 8 : (last + 7) // 8], bitorder="little")[first % 8 :][: last - first])
            if len(more):
                rank = self.rank(level, first)
                found[more] |= self.ids(rank, rank + len(more), level + 1) << np.uint32(width)
        return found

    def documents(self) -> Iterator[tuple[int | None, bool, int, int]]:
        """Id, whether it goes on from the segment before, start and end."""
        ends = [*self.starts.tolist()[1:], self.n]
        for doc, flag, start, end in zip(self.doc_ids.tolist(), self.flags.tolist(), self.starts.tolist(), ends, strict=True):
            yield None if flag & NULL_ID else doc, bool(flag & GOES_ON), start, end


def segments_in(content: np.ndarray) -> Iterator[Segment]:
    at = 0
    while at < len(content):
        yield (s := Segment(content, at))
        at += s.size


class Gatherer:
    """Puts documents' ids together into segments."""

    def __init__(self, most: int):
        self.most, self.parts, self.docs, self.held = most, [], [], 0

    def add(self, doc: int | None, data: bytes) -> Iterator[bytes]:
        """Segments that are full.  data: ids as little-endian u32."""
        at, on = 0, False
        while at < len(data):
            piece = data[at : at + 4 * (self.most - self.held)]
            self.docs.append((doc, self.held, on))
            self.parts.append(piece)
            self.held += len(piece) // 4
            at, on = at + len(piece), True
            if self.held == self.most:
                yield self.take()

    def take(self) -> bytes:
        found = encoded(np.frombuffer(b"".join(self.parts), "<u4"), self.docs)
        self.parts, self.docs, self.held = [], [], 0
        return found


_loaded: dict[str, WordIds] = {}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of every row's text and end_id under path, in ascending order of doc_id (nulls first; equal ids by their texts' hashes).

    A null text is an empty one, whose only id is end_id.  Other columns play no part.  Texts are dealt out by ranges of ids before they become tokens, and a task's segments go
    to one file by Spark's text writer, so a lost task leaves nothing behind; the line feed that ends a segment is the writer's.  The tokenizer must be as WordIds asks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _loaded.get(tokenizer) or _loaded.setdefault(tokenizer, WordIds(tokenizer, REMEMBERED))
        end, own = np.array([end_id], "<u4").tobytes(), Gatherer(segment_ids)

        def out(segment: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment[:-1]], pa.binary())], ["value"])

        for batch in slices(batches, "_text", SLICE_BYTES):
            for doc, text in zip(batch.column(0).to_pylist(), column_bytes(batch, "_text"), strict=True):
                yield from map(out, own.add(doc, ids.encode([text or b""])[0] + end))
        if own.held:
            yield out(own.take())

    chosen = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("_text"))
    size = chosen.agg(F.coalesce(F.sum(F.octet_length("_text") + F.lit(64)), F.lit(0))).first()[0]
    dealt = chosen.withColumn("_tie", F.xxhash64("_text")).repartitionByRange(bucket_count(size, file_bytes), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "_text")
    made = map_texts(dealt.select("doc_id", "_text"), run, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("compression", "none").text(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """part and nth, by which files are in order, and content of every file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = lambda pattern: F.coalesce(F.regexp_extract("path", pattern, 1).try_cast("long"), F.lit(0).cast("long"))
    return files.select(number(r"part-(\d+)[^/]*$").alias("part"), number(r"-c(\d+)[^/]*$").alias("nth"), "content")


def with_base(rows: DataFrame, n: str) -> DataFrame:
    """rows (part, nth, n) with base: the sum of n in earlier files.  The sums are over a row a file, in one task."""
    sums = rows.groupBy("part", "nth").agg(F.sum(n).alias("_sum"))
    sums = materialize(sums.select("part", "nth", (F.sum("_sum").over(Window.orderBy("part", "nth")) - F.col("_sum")).alias("base")))
    return rows.join(F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums, ["part", "nth"])


def as_array(content: pa.Scalar) -> np.ndarray:
    return np.frombuffer(content.as_buffer(), np.uint8)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, in the files' own order."""
    fields = pa.schema([("part", pa.int64()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def documents(content: np.ndarray) -> Iterator[list]:
        at, open_doc = 0, None
        for s in segments_in(content):
            data = memoryview(b"".join(s.ids(i, min(i + DECODED, s.n)).astype("<u4").tobytes() for i in range(0, s.n, DECODED)))
            for doc, on, start, end in s.documents():
                if on:
                    open_doc[2:] = [open_doc[2] + end - start, zlib.crc32(data[4 * start : 4 * end], open_doc[3])]
                    continue
                if open_doc:
                    yield open_doc
                open_doc = [doc, at + start, end - start, zlib.crc32(data[4 * start : 4 * end])]
            at += s.n
        if open_doc:
            yield open_doc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, nth, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                if rows := list(documents(as_array(content))):
                    columns = [[part.as_py()] * len(rows), [nth.as_py()] * len(rows), *zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], schema=fields)

    found = materialize(map_texts(stored(spark, path), run, "part long, nth long, doc_id long, before long, n_tokens long, ids_crc32 long"))
    return with_base(found, "n_tokens").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """part, nth, before (ids of the file before it), n and data of every segment."""
    fields = pa.schema([("part", pa.int64()), ("nth", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, nth, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                data, at, before = as_array(content), 0, 0
                for s in segments_in(data):
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part.as_py(), nth.as_py(), before, s.n, data[at : at + s.size].tobytes()), fields.types, strict=True)], schema=fields)
                    at, before = at + s.size, before + s.n

    return map_texts(stored(spark, path), run, "part long, nth long, before long, n long, data binary")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """position and id for every distinct position (a column of positions, counted over all documents from 0) that the files hold.

    segment_ids: as written.  A position meets its segment by an equality join on blocks of that size, of which a segment overlaps two at most; then each id is read where it
    stands, with no other one decoded.  A segment's positions are one row: no more than it has ids.
    """
    segments = with_base(read_segments(spark, path).drop("data"), "n").withColumn("start", F.col("base") + F.col("before"))
    block = lambda c: F.floor(c / F.lit(segment_ids)).cast("long")
    spans = segments.select("part", "nth", "before", "start", "n", F.explode(F.sequence(block(F.col("start")), block(F.col("start") + F.col("n") - 1))).alias("block"))
    wanted = positions.select(F.col("position").cast("long").alias("position")).distinct().withColumn("block", block(F.col("position")))
    met = wanted.join(spans, "block").where("position >= start AND position < start + n")
    listed = met.groupBy("part", "nth", "before", "start").agg(F.collect_list("position").alias("positions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, found, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                own, s = found.values.to_numpy(), Segment(as_array(data))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([s[int(i)] for i in own - start.as_py()], pa.int64())], ["position", "id"])

    rows = listed.join(read_segments(spark, path).drop("n"), ["part", "nth", "before"]).select("start", "positions", "data")
    return map_texts(rows, run, "position long, id long")


def store_documents(docs: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """Write the tokens of docs under path and read every document back.  An empty table gives an empty result."""
    write_tokens(docs, path, tokenizer)
    return read_documents(docs.sparkSession, path)


def op11_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and digest from the files read back; see write_tokens for nulls, ties, repeats and long texts."""
    import public_tokenizers

    return store_documents(table(spark, sf_dir, "documents"), scratch(spark), public_tokenizers.path("word_bpe_49k.json"))
