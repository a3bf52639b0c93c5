"""Prediction by partial matching over bytes, with frozen counts.

A context is up to `order` bytes before a symbol; symbols are bytes and the end of the text, written 0xFF, which UTF-8 never holds.  Before the
text stand 0xFF bytes.  A symbol and its longest context make one number, its gram: context bytes first, symbol last, so that the low bytes are
the gram of every shorter context.

A symbol takes its chance from the longest context that has been seen: count / (total + distinct) if seen there; else the escape chance
distinct / (total + distinct), and then the same with the next shorter context, where the symbols just ruled out count no more (symbol exclusion).
After the empty context, all symbols never seen share what is left evenly.

gram_values has the chance of every gram that is asked for under the whole counts, as a table, for one model or one for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

END = 0xFF
EMPTY = np.uint64(2**64 - 1)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
PART = 1 << 20


def grams(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of about PART bytes: the grams of all symbols, and where each text's begin in them, with the text's number.

    Texts over PART bytes come in several pieces, each with the bytes before it.
    """
    kind = np.uint32 if order <= 3 else np.uint64
    blocks, sizes, owners, held = [], [], [], 0
    pad, end = bytes([END]) * order, bytes([END])

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(blocks), np.uint8)
        code = raw[: len(raw) - order].astype(kind)
        for j in range(1, order + 1):
            code <<= kind(8)
            code |= raw[j : len(raw) - order + j]
        n = np.array(sizes)
        keep = np.ones(len(code), bool)
        if len(n) > 1 and order:
            stops = np.cumsum(n + order)[:-1] - order
            keep[(stops[:, None] + np.arange(order)).ravel()] = False
        return code[keep], np.concatenate([[0], np.cumsum(n)[:-1]]), np.array(owners)

    for i, text in enumerate(texts):
        before, at = pad, 0
        while at <= len(text):
            piece = text[at : at + PART]
            at += PART
            if at > len(text):
                piece += end
            blocks.append(before + piece)
            sizes.append(len(piece))
            owners.append(i)
            before, held = (before + piece)[len(before) + len(piece) - order :] if order else b"", held + len(piece)
            if held >= PART:
                yield out()
                blocks, sizes, owners, held = [], [], [], 0
    if blocks:
        yield out()


class GramCounter:
    """Counts of grams, kept as sorted arrays."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.bound = 0, PART

    def add(self, codes: np.ndarray) -> None:
        self.parts.append(np.unique(codes, return_counts=True))
        self.held += len(self.parts[-1][0])
        if self.held > self.bound:
            self.put_together()

    def put_together(self) -> None:
        """Equal grams become one; the next time only after as many again, so that each is sorted a few times at most."""
        self.parts = [self.merged()]
        self.held = len(self.parts[0][0])
        self.bound = max(PART, 2 * self.held)

    def full(self, most: int) -> bool:
        """Whether, with over `most` grams held, over half of them are left when equal ones are put together."""
        if self.held > most:
            self.put_together()
        return self.held > most // 2

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        codes, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        by = np.argsort(codes, kind="stable")
        codes, counts = codes[by], counts[by]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[first], np.add.reduceat(counts, first) if len(first) else counts

    def take(self) -> tuple[pa.Array, pa.Array]:
        codes, counts = self.merged()
        self.parts, self.held, self.bound = [], 0, PART
        return pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))


class Lookup:
    """Places of known numbers, by open addressing over arrays."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.full(1 << self.bits, EMPTY)
        self.place = np.full(1 << self.bits, -1, np.int32)
        slot, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == EMPTY]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.place[slot[first]] = keys[first], first
            left = np.setdiff1d(left, first, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is unknown."""
        keys = keys.astype(np.uint64)
        slot = self.slot(keys)
        got = self.keys[slot]
        found = self.place[slot]
        found[got != keys] = -1
        left = np.flatnonzero((got != keys) & (got != EMPTY))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[left]]
            hit = got == keys[left]
            found[left[hit]] = self.place[slot[left[hit]]]
            left = left[~hit & (got != EMPTY)]
        return found


def gram_values(wanted: DataFrame, learned: DataFrame, order: int, by: str | None = None) -> DataFrame:
    """code and value, the log10 of its symbol's chance, for every row of wanted (code, n: how often it was learned, 0 or null if never), under learned (code, n).

    by: a column of both, each value of which is a model of its own.  Every gram counts, however rare.  A context has 256 symbols at most, so no key of a join between levels
    holds more rows than that for a model.
    """
    keys = [by] if by else []
    low = lambda c, n_bytes: F.col(c).bitwiseAND(F.lit((1 << 8 * n_bytes) - 1).cast("long"))
    levels = {order: learned.select(*keys, "code", "n")}
    for k in range(order - 1, -1, -1):
        levels[k] = materialize(levels[k + 1].groupBy(*keys, low("code", k + 1).alias("code")).agg(F.sum("n").alias("n")))
    contexts = []
    for k in range(order + 1):
        below = levels[k].withColumn("down", F.lit(0).cast("long"))
        if k:
            lower = levels[k - 1].select(*keys, F.col("code").alias("lower"), F.col("n").alias("down"))
            below = levels[k].withColumn("lower", low("code", k)).join(lower, [*keys, "lower"])
        context = F.shiftright("code", 8).alias("context")
        contexts.append(materialize(below.groupBy(*keys, context).agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("down").alias("down"))))
    found = wanted.where("n > 0").withColumn("context", F.shiftright("code", 8))
    seen = found.join(contexts[order], [*keys, "context"]).select(*keys, "code", F.log10(F.col("n") / (F.col("total") + F.col("distinct"))).alias("value"))
    zero = F.lit(0).cast("long")
    left = wanted.where("n IS NULL OR n = 0").select(*keys, "code", F.lit(0.0).alias("value"), zero.alias("gone_total"), zero.alias("gone_distinct"), F.lit(False).alias("done"))
    small = 1 if by else 2  # orders of 2**16 contexts at most, or 2**8 a model
    for k in range(order, -1, -1):
        few = F.broadcast if k <= small else lambda df: df
        left = left.withColumn("own", low("code", k + 1)).withColumn("context", F.shiftright("own", 8)).join(few(contexts[k]), [*keys, "context"], "left")
        own = levels[k].select(*keys, F.col("code").alias("own"), F.col("n").alias("own_n"))
        left = left.join(F.broadcast(own) if k < small else own, [*keys, "own"], "left") if k < order else left.withColumn("own_n", F.lit(None).cast("long"))
        symbols = F.col("distinct") - F.col("gone_distinct")
        whole = F.col("total") - F.col("gone_total") + symbols
        step = F.when(F.col("done") | F.col("total").isNull(), 0.0).when(F.col("own_n") > 0, F.log10(F.col("own_n") / whole)).when(symbols > 0, F.log10(symbols / whole)).otherwise(0.0)
        left = left.select(*keys, "code", (F.col("value") + step).alias("value"), F.coalesce("down", zero).alias("gone_total"), F.coalesce("distinct", zero).alias("gone_distinct"), (F.col("done") | F.coalesce(F.col("own_n") > 0, F.lit(False))).alias("done"))
    never = F.log10(F.greatest(F.lit(1), 256 - F.coalesce("distinct", zero)))
    left = left.drop("gone_total", "gone_distinct").join(F.broadcast(contexts[0].select(*keys, "distinct")), keys, "left") if by else left.withColumn("distinct", F.lit(levels[0].count()).cast("long"))
    return seen.union(left.select(*keys, "code", F.when(F.col("done"), F.col("value")).otherwise(F.col("value") - never)))
