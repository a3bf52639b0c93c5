"""License scans by diagonal voting.

Every rolling k-gram of a text's words is joined to the places of equal k-grams in license templates.  Hits of one template whose distance between place in the text and place
in the template is equal lie on a diagonal; diagonals that nearly touch are merged into a span, and a span counts if enough of the template's words stand there in order.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column_bytes, map_texts, materialize, slices, table
from .license_texts import PHRASES, TEMPLATES

K = 3
#: Diagonals are merged if they differ by so many words at most and their hits lie so many words apart at most.
DRIFT, GAP = 4, 12
#: A span holds at least this share of the template's words; of a template of over LONG words, LONG words at least, as densely.
SHARE, SHORT, LONG = 0.8, 16, 40
#: Spans that are broadcast at most.
BROADCAST_SPANS = 200_000
#: Words of a text in one cell of the places where spans are compared.
CELL = 256
#: Text that a task takes into Python at a time.
SLICE_BYTES = 1 << 20
#: Words are runs of digits, a-z and bytes beyond ASCII, after lower-casing A-Z.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class _Hashes(dict):
    """Hashes of words; those of the first 2**16 different ones, the frequent ones among them, are kept."""

    def __missing__(self, word: bytes) -> int:
        x = xxhash.xxh64_intdigest(word)
        if len(self) < 1 << 16:
            self[word] = x
        return x


def gram_hashes(words: list[bytes], hashes: dict[bytes, int], k: int = K) -> np.ndarray:
    if len(words) < k:
        return np.zeros(0, np.int64)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    total = own[: len(own) - k + 1].copy()
    for j in range(1, k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + own[j : len(own) - k + 1 + j]
    return total.view(np.int64)


def template_places(spark: SparkSession, templates: list[tuple[str, str]], k: int = K) -> DataFrame:
    """hash, template and place of every k-gram of every template: a table as small as the templates."""
    rows = [(int(h), t, i) for t, (_, text) in enumerate(templates) for i, h in enumerate(gram_hashes(words_of(text.encode()), _Hashes(), k))]
    return spark.createDataFrame(rows, "hash long, template int, place int")


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """First words and labels of the places where a phrase's words stand one after the other."""
    text, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in PHRASES.items():
        p = b" " + phrase.encode() + b" "
        last, n, at = 0, 0, text.find(p)
        while at >= 0:
            n += text.count(b" ", last, at)  # words before this hit, counted from the last one on
            found.append((n, label))
            last, at = at, text.find(p, at + 1)
    return found


def base_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, digest (of the text), n_words, n_base, first_word, last_word and base of every row."""
    names = ["doc_id", "digest", "n_words", "n_base", "first_word", "last_word", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", SLICE_BYTES):
            rows = []
            for t in column_bytes(part, "_text"):
                words = words_of(t)
                found = base_places(words)
                places = [p for p, _ in found]
                rows.append((len(words), len(found), min(places, default=None), max(places, default=None), sorted({x for _, x in found})))
            n, n_base, first, last, base = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, pa.int64()) for x in (n, n_base, first, last)), pa.array(base, pa.list_(pa.string()))], names)

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest"), F.col(text).cast("binary").alias("_text"))
    return map_texts(chosen, run, "doc_id long, digest string, n_words long, n_base long, first_word long, last_word long, base array<string>")


def candidate_spans(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, k: int = K) -> DataFrame:
    """digest (of a text), template, start and stop (places of k-grams in the text): merged diagonals with hits enough to be worth a look.  Copies count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for part in slices(batches, "_text", SLICE_BYTES):
            grams = [gram_hashes(words_of(t), hashes, k) for t in column_bytes(part, "_text")]
            ends = np.cumsum([0, *map(len, grams)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams)))], ["digest", "hashes"])

    grams = map_texts(docs.select(F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest"), F.col(text).cast("binary").alias("_text")), run, "digest string, hashes array<long>")
    places = template_places(docs.sparkSession, templates, k)
    hits = grams.select("digest", F.posexplode("hashes").alias("at", "hash")).join(F.broadcast(places), "hash").select("digest", "template", "at", "place").distinct()
    votes = hits.groupBy("digest", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("at").alias("start"), F.max("at").alias("stop"))
    order = Window.partitionBy("digest", "template").orderBy("start", "diagonal")
    apart = (F.col("start") - F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)) > GAP) | (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > DRIFT)
    spans = votes.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order)).groupBy("digest", "template", "span").agg(F.sum("votes").alias("votes"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    sizes = places.groupBy("template").agg(F.count("*").alias("grams"))
    return spans.join(F.broadcast(sizes), "template").where(F.col("votes") >= F.least(F.col("grams"), F.lit(LONG)) * 0.4).select("digest", "template", "start", "stop")


def windows(start: int, stop: int, length: int, k: int = K) -> Iterator[tuple[int, int]]:
    """A span (places of first and last k-gram) as stretches of words of three times a template's length at most, each half over the one before."""
    start, stop, size = max(0, start - 2), stop + k + 2, 3 * length + 2 * k
    while stop - start > size:
        yield start, start + size
        start += size // 2
    yield start, stop


def share_of(window: list[bytes], template: list[bytes]) -> tuple[float, int, int]:
    """Share of the template's words that stand in order in the window (0 if they are too few), and from where to where.

    A template of SHORT words at most must be there in full, since one word tells such notices apart; one of over LONG words may be quoted in part.
    """
    blocks = [b for b in difflib.SequenceMatcher(None, window, template, autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return 0.0, 0, 0
    same = sum(b.size for b in blocks)
    reach = len(template) if len(template) <= LONG else max(LONG, blocks[-1].b + blocks[-1].size - blocks[0].b)
    share = min(1.0, same / reach)
    return share if share >= (1.0 if len(template) <= SHORT else SHARE) else 0.0, blocks[0].a, blocks[-1].a + blocks[-1].size - 1


def best_labels(words: list[bytes], spans: list[tuple[int, int, int]], templates: list[list[bytes]], labels: list[str]) -> tuple[list[str], float]:
    """Labels of the verified spans (template, start, stop) and their best share.  A stretch that overlaps a better one doesn't count.

    Better: a larger share, then a longer template.  Stretches are compared by cells of the text, so that a text of many spans takes time in proportion to them.
    """
    seen: dict[tuple, tuple[float, int, int]] = {}  # equal windows of a text that repeats itself are looked at once
    rated = []
    for t, start, stop in spans:
        for a, z in windows(start, stop, len(templates[t])):
            window = words[a:z]
            key = (t, xxhash.xxh3_128_digest(b" ".join(window)))
            if key not in seen:
                seen[key] = share_of(window, templates[t])
            share, first, last = seen[key]
            if share:
                rated.append((share, len(templates[t]), t, a + first, a + last))
    cells: dict[int, list[tuple]] = {}
    taken = set()
    best = 0.0
    for r in sorted(rated, reverse=True):
        best = max(best, r[0])
        own = range(r[3] // CELL, r[4] // CELL + 1)
        if any(x[:2] > r[:2] and x[3] <= r[4] and r[3] <= x[4] for c in own for x in cells.get(c, ())):
            continue
        taken.add(labels[r[2]])
        for c in own:
            cells.setdefault(c, []).append(r)
    return sorted(taken), best


def template_labels(docs: DataFrame, spans: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """digest, labels (array) and score of the texts of docs in which a span of spans is verified."""
    wanted = materialize(spans.groupBy("digest").agg(F.collect_set(F.struct("template", "start", "stop")).alias("spans")))
    names, bodies = [n for n, _ in templates], [words_of(t.encode()) for _, t in templates]
    n_spans = wanted.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", SLICE_BYTES):
            out = []
            for digest, spans_, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), column_bytes(part, "_text"), strict=True):
                labels, share = best_labels(words_of(t), [(s["template"], s["start"], s["stop"]) for s in spans_], bodies, names)
                if labels:
                    out.append((digest, labels, share))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), (pa.string(), pa.list_(pa.string()), pa.float64()), strict=True)], ["digest", "found", "share"])

    own = docs.select(F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest"), F.col(text).cast("binary").alias("_text"))
    met = own.join(F.broadcast(wanted) if n_spans <= BROADCAST_SPANS else wanted, "digest").select("digest", "spans", "_text")
    return map_texts(met, run, "digest string, found array<string>, share double").groupBy("digest").agg(F.max("found").alias("found"), F.max("share").alias("share"))


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.  templates: label and text; they go to every task.

    score: the best verified share, 1 if only phrases were found, 0 if nothing was.  Null texts count as empty; repeated rows each get their row.
    """
    labelled = template_labels(docs, candidate_spans(docs, text, templates), text, templates)
    found = base_scan(docs, text, doc_id).join(labelled, "digest", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.coalesce("share", F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document; see scan_licenses for nulls and repeats.  Long texts take time in proportion to their words; an empty table gives an empty result."""
    return scan_licenses(table(spark, sf_dir, "documents"))
