"""SimHash near-duplicates by deletion variants.

Fingerprints of 64 bits link at up to `distance` differing bits.  Cut into distance // 2 + 1 segments, some segment holds one differing bit
at most.  So each fingerprint is indexed under every segment with one bit of it wiped out, 64 keys in all; fingerprints within the distance agree on
at least one of them.  Grouping by key finds them and the full distance is verified.  Large buckets are compared in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, bucket_count, column_bytes, field, map_texts, materialize, packed, row_id, slices, table, unpacked
from .graph import connected_components

SHINGLE_WORDS, SEED, DISTANCE = 4, 42, 4
#: Members of a bucket that one task compares at a time.
BUCKET_ROWS = 4096
#: Members that are compared all at once.
MATRIX_ROWS = 512
#: Variants that one task makes.
VARIANT_ROWS = 1 << 20


def simhash(text: bytes | None, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """A bit is 1 if set in over half the shingle hashes; 0 for a text without words."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + shingle - 1]
        hashes = np.array([digest(b" ".join(x), seed) for x in zip(*(part[k:] for k in range(shingle)), strict=False)], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rid: Column | None = None) -> DataFrame:
    """rid (row_id if not given), doc_id and fp (the fingerprint's bits as a long) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            fp = np.array([simhash(t) for t in column_bytes(part, "_text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp)], ["rid", "doc_id", "fp"])

    chosen = docs.select((row_id() if rid is None else rid).alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text"))
    return map_texts(chosen, run, "rid long, doc_id long, fp long")


def segment_count(distance: int = DISTANCE) -> int:
    """The fewest segments of which one must hold one differing bit at most."""
    return distance // 2 + 1


def variant_masks(s: int) -> list[int]:
    """For each of s segments and each bit of it: the bits that the key keeps."""
    starts = [64 * i // s for i in range(s + 1)]
    segments = [sum(1 << b for b in range(starts[i], starts[i + 1])) for i in range(s)]
    return [whole ^ (1 << b) for whole in segments for b in range(64) if whole >> b & 1]


def variants(fps: DataFrame, s: int) -> DataFrame:
    """fp, variant number v and key (the kept bits) for every one-wildcard variant of every fingerprint."""
    masks = np.array(variant_masks(s), np.uint64).view(np.int64).tolist()
    keys = F.array(*(F.struct(F.lit(v).cast("short").alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(masks)))
    return fps.select("fp", F.inline(keys))


def bucket_links(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Fewer links than members, connecting what all pairs within the distance connect.

    Few pairs are all returned.  Else breadth-first: every member taken is compared with all that no component has yet, so only pairs within one
    component are left out.
    """
    if len(fps) <= MATRIX_ROWS:
        i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps) <= distance, 1))
        if len(i) < len(fps):
            return list(zip(fps[i].tolist(), fps[j].tolist(), strict=True))
    rest, links = fps, []
    while len(rest):
        taken, rest = [rest[0]], rest[1:]
        while taken and len(rest):
            lead = taken.pop()
            near = np.bitwise_count(rest ^ lead) <= distance
            if near.any():
                new = rest[near]
                links += [(int(lead), x) for x in new.tolist()]
                taken += list(new)
                rest = rest[~near]
    return links


def in_blocks(keys: DataFrame, block: int = BUCKET_ROWS, broadcast_rows: int = 100_000) -> DataFrame:
    """keys (v, key, fp) with i and j: 0 and 0, but in buckets of over block members the numbers of two blocks to compare.

    So no task takes more than two blocks, however large a bucket is.  Large buckets are found by counting first.
    """
    large = materialize(keys.groupBy("v", "key").agg(F.count("*").alias("members")).where(F.col("members") > block))
    n = large.count()
    if not n:
        return keys.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"))
    blocks = F.ceil(F.coalesce("members", F.lit(1)) / block).cast("int")
    dealt = keys.join(F.broadcast(large) if n <= broadcast_rows else large, ["v", "key"], "left").select("v", "key", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return paired.select("v", "key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def near_links(fps: DataFrame, distance: int = DISTANCE, block: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints fps (column fp, no repeats) with the same connected parts as all pairs within the distance."""
    s = segment_count(distance)
    spread = fps.select("fp").repartition(bucket_count(fps.count() * len(variant_masks(s)), VARIANT_ROWS), "fp")
    groups = in_blocks(variants(spread, s), block).groupBy("v", "key", "i", "j").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            size, start = np.diff(ends), ends[:-1]
            two = start[size == 2]
            a, b = flat[two], flat[two + 1]
            ok = np.bitwise_count(a ^ b) <= distance
            links = [np.stack([a[ok], b[ok]], 1)]
            links += [np.array(bucket_links(flat[start[k] : start[k] + size[k]], distance), np.uint64).reshape(-1, 2) for k in np.flatnonzero(size > 2)]
            out = np.concatenate(links).view(np.int64)
            out.sort(axis=1)
            out = np.unique(out, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    return groups.select("fps").mapInArrow(run, "a long, b long").distinct()


def components(found: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp and first (doc_id and rid of the component's first row: by doc_id, null last, then rid) for every fingerprint of found (rid, doc_id, fp)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "rid"))
    nodes = materialize(found.groupBy("fp").agg(first.alias("first")))
    parts = connected_components(materialize(near_links(nodes, distance)))
    joined = nodes.join(parts.select(F.col("node").alias("fp"), "part"), "fp", "left").select("fp", "first", F.coalesce("part", "fp").alias("part"))
    joined = materialize(joined)
    return joined.select("fp", "part").join(joined.groupBy("part").agg(F.min("first").alias("first")), "part").select("fp", "first")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row.

    Equal fingerprints are one node.  Null or blank texts have fingerprint 0 and link like others.  A row with a null doc_id takes part; a
    component of such rows alone has a null component_id.  Repeated rows come out as often as they go in.  An empty table gives an empty one.
    """
    found = materialize(fingerprints(docs, text, doc_id))
    return found.join(components(found, distance), "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def one_per_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """The first row of each component, by doc_id (null last) and then place in the input, with docs' columns.

    The numbered rows are written once; fingerprints and the kept rows come from that table, so numbers agree however the input is split.
    """
    rows = materialize(packed(docs).withColumn("rid", row_id()))
    found = materialize(fingerprints(rows.select("rid", field(doc_id).alias("doc_id"), field(text).alias("text")), rid=F.col("rid")))
    kept = components(found, distance).select(F.col("first.rid").alias("rid")).distinct()
    return unpacked(rows.join(kept, "rid", "left_semi"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see near_duplicates for nulls, repeats and empty tables.  Texts of any length are shingled whole."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
