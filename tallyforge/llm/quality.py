"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks.

A text that compresses too well repeats itself; one that hardly compresses is random or encoded.  Both limits depend on the
length, since short texts carry the frame's overhead and long ones give the compressor more history.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, column_bytes, map_texts, slices, table

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 5


@dataclass(frozen=True)
class Band:
    """Limits for texts of at least min_bytes bytes: kept if low <= ratio <= high."""

    min_bytes: int
    low: float
    high: float


#: By length; a text takes the last band that it reaches.  Fixed values, set from zstandard's usual ratios on prose and on base64, which takes 0.76 of its length.  A text under 100 bytes is stored as it is, so only its low limit tells something.
BANDS = (Band(0, 0.0, 99.0), Band(20, 0.3, 2.0), Band(100, 0.25, 1.2), Band(250, 0.25, 0.95), Band(500, 0.25, 0.85), Band(2000, 0.22, 0.74), Band(10000, 0.18, 0.72))
#: For each chunk, by its own length (the last one of a text may be shorter), and how large a share of the chunks may lie outside.
CHUNK_BYTES, CHUNK_SHARE = 4096, 0.25
CHUNK_BANDS = (*BANDS[:5], Band(2000, 0.2, 0.74))

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_low_chunks long, n_high_chunks long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of so many words found twice or more in the text, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if n > 50_000:  # numbers instead of tuples: a few arrays, however long the text
        ids: dict[bytes, int] = {}
        base = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        key = base[:n]
        for k in range(1, window):
            key = np.unique(key * np.int64(len(ids)) + base[k : k + n], return_inverse=True)[1].astype(np.int64)
        hit = np.flatnonzero(np.bincount(key)[key] > 1)
    else:
        windows = list(zip(*(words[k:] for k in range(window)), strict=False))
        if len(set(windows)) == n:
            return 0
        count = Counter(windows)
        hit = np.array([i for i, w in enumerate(windows) if count[w] > 1])
    if not len(hit):
        return 0
    return int(window + np.minimum(np.diff(hit), window).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def band_of(n_bytes: int, bands: tuple[Band, ...]) -> Band:
    return [b for b in bands if n_bytes >= b.min_bytes][-1]


def chunk_ratios(text: bytes, packer: zstandard.ZstdCompressor, size: int = CHUNK_BYTES) -> list[tuple[float, Band]]:
    """Ratio and band of every chunk of a text of over size bytes, the last one, however short, included."""
    chunks = [text[i : i + size] for i in range(0, len(text), size)] if len(text) > size else []
    return [(len(packer.compress(c)) / len(c), band_of(len(c), CHUNK_BANDS)) for c in chunks]


def measure(text: bytes | None, packer: zstandard.ZstdCompressor) -> tuple:
    text = text or b""
    words = text.split()
    chunks = chunk_ratios(text, packer)
    return (
        len(words),
        len(text.translate(None, SPACE + CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        duplicate_lines(text),
        repeated_words(words),
        len(packer.compress(text)) / len(text) if text else None,
        len(chunks),
        sum(x < b.low for x, b in chunks),
        sum(x > b.high for x, b in chunks),
    )


def text_measures(docs: DataFrame, text: str = "text", level: int = 3, passthrough: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns passthrough and, for every row, the counts and ratios of COLUMNS.

    A null text counts as empty: all counts 0, ratio null.  Repeated rows are measured each.  Columns of docs other than those
    named are not read.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passthrough)
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    types = [pa.float64() if x.endswith("double") else pa.int64() for x in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level)
        for part in slices(batches, "_text"):
            found = list(zip(*(measure(t, packer) for t in column_bytes(part, "_text")), strict=True))
            kept = [part.column(part.schema.get_field_index(c)) for c in passthrough]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, t) for v, t in zip(found, types, strict=True))], [*passthrough, *names])

    return map_texts(docs.select(*passthrough, F.col(text).cast("binary").alias("_text")), run, f"{schema}, {COLUMNS}")


def with_verdict(measures: DataFrame, bands: tuple[Band, ...] = BANDS) -> DataFrame:
    """Adds base_failed, reason and kept.  reason: base, repetitive, incompressible or null."""
    n_bytes = F.col("n_bytes")
    low, high = F.lit(bands[0].low), F.lit(bands[0].high)
    for b in bands[1:]:
        low, high = F.when(n_bytes >= b.min_bytes, b.low).otherwise(low), F.when(n_bytes >= b.min_bytes, b.high).otherwise(high)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    share = CHUNK_SHARE * F.col("n_chunks")
    reason = (
        F.when(F.col("base_failed"), "base")
        .when((F.col("ratio") < low) | (F.col("n_low_chunks") > share), "repetitive")
        .when((F.col("ratio") > high) | (F.col("n_high_chunks") > share), "incompressible")
    )
    return measures.withColumn("base_failed", failed).withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


def quality_rules(docs: DataFrame, text: str = "text", passthrough: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measures and verdict of every row; see text_measures for nulls and with_verdict for the rules.

    An empty table gives an empty result; a text of one repeated word fails base; an empty text has no ratio and fails base.
    """
    sized = docs.select(*passthrough, text, F.coalesce(F.octet_length(text), F.lit(0)).alias("n_bytes"))
    return with_verdict(text_measures(sized, text, passthrough=(*passthrough, "n_bytes")))


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; null texts have no words, repeated rows each their row, very long texts all their chunks."""
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "n_low_chunks", "n_high_chunks", "reason"
    )
