"""Language-model scoring by prediction by partial matching, beside a token unigram base.

Grams and tokens are counted over all training texts; every gram has its chance under the whole counts.  Neither fits one machine: tokens that
make up 2**-HOT_BITS of all, and grams that make up 2**-GRAM_BITS of those met, are few by that rule and go to every task; the others meet their counts and chances
in a join.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, column_bytes, id_remainder, map_texts, materialize, segments, slices, table
from .ppm import GramCounter, Lookup, gram_values, grams

ORDER, GRAM_BITS = 4, 21
#: 2**19 tokens of LONGEST bytes at most go to every task.
HOT_BITS, LONGEST = 19, 64
#: Tokens and grams that a task gathers before it passes them on.
HELD_TOKENS, HELD_GRAMS = 500_000, 1 << 21
#: The token that ends a text: words are never empty.
END_TOKEN = b""
#: Stands for a token where a row is a gram: no word, for it has a blank.
GRAM = b" g"


def short(token: bytes) -> bytes:
    """token; over LONGEST bytes its SHA-256 instead, after a blank, so that it is no other token."""
    return token if len(token) <= LONGEST else b" " + hashlib.sha256(token).digest()


def corpus_counts(docs: DataFrame, training: Column, text: str = "text", order: int = ORDER) -> DataFrame:
    """token, code, n and met: counts of tokens (code null) over training rows, and of grams (token null) over training rows (n) and over all rows (met)."""
    fields = pa.schema([("token", pa.binary()), ("code", pa.int64()), ("n", pa.int64()), ("met", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, learned, other = Counter(), GramCounter(), GramCounter()

        def out() -> pa.RecordBatch:
            n = pa.array(tokens.values(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(tokens.keys(), pa.binary()), pa.nulls(len(tokens), pa.int64()), n, n], schema=fields)
            tokens.clear()
            return batch

        def grams_out(counted: GramCounter, learn: int) -> Iterator[pa.RecordBatch]:
            codes, met = counted.take()
            for at in range(0, len(codes), 1 << 16):
                c, m = codes[at : at + (1 << 16)], met[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(c), pa.binary()), c, pa.array(m.to_numpy() * learn), m], schema=fields)

        for part in slices(batches, "_text"):
            texts, own = [t or b"" for t in column_bytes(part, "_text")], part.column(0).to_pylist()
            for t, learn in zip(texts, own, strict=True):
                if learn:
                    for s in segments(t):
                        tokens.update(map(short, s.translate(LOWER).split()))
                        if len(tokens) > HELD_TOKENS:
                            yield out()
                    tokens[END_TOKEN] += 1
            for counted, learn in ((learned, 1), (other, 0)):
                for codes, _, _ in grams([t for t, which in zip(texts, own, strict=True) if which == learn], order):
                    counted.add(codes)
                    if counted.held > HELD_GRAMS and counted.full(HELD_GRAMS):
                        yield from grams_out(counted, learn)
        if tokens:
            yield out()
        for counted, learn in ((learned, 1), (other, 0)):
            yield from grams_out(counted, learn)

    chosen = docs.select(F.coalesce(training, F.lit(False)).alias("_learn"), F.col(text).cast("binary").alias("_text"))
    return map_texts(chosen, run, "token binary, code long, n long, met long").groupBy("token", "code").agg(F.sum("n").alias("n"), F.sum("met").alias("met"))


def score_texts(docs: DataFrame, training: Column, text: str = "text", doc_id: str = "doc_id", order: int = ORDER, bits: int = GRAM_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_bytes for every row.

    training: whether a row's text is learned from.  Null texts count as empty: one token, the end.  Repeated rows each get their row.  Without training texts
    every chance is even.  An empty table gives an empty result.
    """
    counts = materialize(corpus_counts(docs, training, text, order))
    tokens = counts.where("token IS NOT NULL").select("token", "n")
    n_all, n_distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    below = n_all + n_distinct + 1
    frequent = (F.col("n") * float(1 << HOT_BITS) >= n_all)
    hot = tokens.where(frequent).toArrow()
    hot = dict(zip(hot["token"].to_pylist(), hot["n"].to_pylist(), strict=True))
    met_grams = counts.where("code IS NOT NULL").select("code", "n", "met")
    values = materialize(gram_values(met_grams.select("code", "n"), met_grams.where("n > 0"), order).join(met_grams.select("code", "met"), "code"))
    n_met = values.agg(F.coalesce(F.sum("met"), F.lit(0))).first()[0]
    common = F.col("met") * float(1 << bits) >= n_met
    top = values.where(common).select("code", "value").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((Lookup(top["code"].to_numpy()), np.append(top["value"].to_numpy(), 0.0), {t: log10((c + 1) / below) for t, c in hot.items()}))
    fields = pa.schema([("rid", pa.int64()), ("token", pa.binary()), ("code", pa.int64()), ("tf", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, chances, known = shared.value
        for part in slices(batches, "_text"):
            texts = [t or b"" for t in column_bytes(part, "_text")]
            rid, doc, held = (part.column(i).to_pylist() for i in range(3))
            rows, rare = [], ([], [], [])
            for r, t in zip(rid, texts, strict=True):
                count: Counter = Counter()
                for s in segments(t):
                    count.update(map(short, s.translate(LOWER).split()))
                count[END_TOKEN] += 1
                base, n_known = 0.0, 0
                for w, n in count.items():
                    if (x := known.get(w)) is None:
                        rare[0].append(r)
                        rare[1].append(w)
                        rare[2].append(n)
                    else:
                        base += n * x
                        n_known += n
                rows.append((b" %d" % r, sum(count.values()), n_known, base))  # a blank: no word, so it meets no count, and each row has its own
            score, ids = np.zeros(len(texts)), np.array(rid)
            for codes, starts, owners in grams(texts, order):
                place = lookup.find(codes)
                np.add.at(score, owners, np.add.reduceat(chances[place], starts))  # the last chance, 0, stands for those not found
                lost = np.flatnonzero(place < 0)
                if len(lost):
                    of = np.searchsorted(starts, lost, "right") - 1
                    new, which = np.unique(codes[lost], return_inverse=True)
                    pairs, tf = np.unique(of * len(new) + which, return_counts=True)
                    n = len(pairs)
                    own = [pa.array(ids[owners[pairs // len(new)]]), pa.array([GRAM] * n, pa.binary()), pa.array(new[pairs % len(new)].astype(np.int64)), pa.array(tf)]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(n, f.type) for f in list(fields)[4:])], schema=fields)
            marks, n_tokens, n_known, base = zip(*rows, strict=True)
            n = len(rows)
            own = [pa.array(rid), pa.array(marks, pa.binary()), pa.array([-1] * n), pa.array([0] * n), pa.array(doc, pa.int64()), pa.array(held, pa.bool_()), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(score), pa.array([len(t) for t in texts])]
            yield pa.RecordBatch.from_arrays(own, schema=fields)
            n = len(rare[0])
            yield pa.RecordBatch.from_arrays([pa.array(rare[0], pa.int64()), pa.array(rare[1], pa.binary()), pa.array([-1] * n, pa.int64()), pa.array(rare[2], pa.int64()), *(pa.nulls(n, f.type) for f in list(fields)[4:])], schema=fields)

    chosen = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), (~F.coalesce(training, F.lit(False))).alias("held_out"), F.col(text).cast("binary").alias("_text"))
    schema = "rid long, token binary, code long, tf long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long"
    none = F.lit(-1).cast("long")
    rare_tokens = tokens.where(~frequent).select("token", none.alias("code"), "n", F.lit(None).cast("double").alias("value"))
    rare_grams = values.where(~common).select(F.lit(GRAM).alias("token"), "code", F.lit(None).cast("long").alias("n"), "value")
    met = map_texts(chosen, run, schema).join(rare_tokens.union(rare_grams), ["token", "code"], "left")
    chance = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(below)))
    whole = met.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0))).alias("n_known"),
        (F.sum("base") + F.sum(F.when(F.col("code") < 0, F.col("tf") * chance).otherwise(0.0))).alias("base_score"),
        (F.max("score") + F.coalesce(F.sum(F.col("tf") * F.col("value")), F.lit(0.0))).alias("score"),
        F.max("n_bytes").alias("n_bytes"),
    )
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes")


def op1_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, whole, learned from six sevenths of them; see score_texts for nulls, repeats and empty tables."""
    return score_texts(table(spark, sf_dir, "documents"), id_remainder("doc_id", 7) != 2)
