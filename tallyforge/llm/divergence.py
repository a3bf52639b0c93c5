"""Divergence of sources within a language, by joint histograms of term counts.

For two sources of a language, what their divergence depends on is how many terms have which pair of counts in them.  Tasks tally those pairs of counts (a pair of
sources is never a row of its own for a term), the tallies are added up, cells in which one source or both lack the term follow from the sources' own histograms, and the
divergence is worked out once for each pair of counts, times its terms.  All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column_bytes, map_texts, materialize, rows_together, segments, slices, table

LEAST_DOCUMENTS, UNIT, MOST_RANKS = 3, 1_000_000_000, 200
#: Bytes of a term: ASCII letters, lower-cased, and all bytes of other characters; the rest separate terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Distinct terms, and bytes of them, that a task gathers before it passes them on.
HELD_TERMS, HELD_BYTES = 400_000, 64 << 20
#: Sources in a block, on average; the most pairs of counts that a task holds; rows of terms that it takes at a time.
BLOCK_SOURCES, HELD_PAIRS, TERM_ROWS = 48, 1 << 21, 8192


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists for about a megabyte each."""
    for s in segments(text.translate(TERM_BYTES)):
        yield s.split()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents); for each group also a row with a null term.  Null counts as ''."""
    fields = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        held = size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (own_lang, own_source), (n, df) in groups.items():
                terms = [None, *n]
                columns = [pa.array([own_lang] * len(terms)), pa.array([own_source] * len(terms)), pa.array(terms, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(df.__getitem__, n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=fields)
            groups.clear()

        for part in slices(batches, "_text"):
            for own_lang, own_source, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), column_bytes(part, "_text"), strict=True):
                n, df = groups.setdefault((own_lang, own_source), (Counter(), Counter()))
                before, seen = len(n), set()
                for terms in terms_of(t or b""):
                    n.update(terms)
                    seen.update(terms)
                df.update(seen)
                held += len(n) - before + 1
                size += sum(map(len, seen)) if len(n) > before else 0
                if held > HELD_TERMS or size > HELD_BYTES:
                    yield from out()
                    held = size = 0
        yield from out()

    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    chosen = docs.select(name(lang).alias("lang"), name(source).alias("source"), F.col(f"`{text}`").cast("binary").alias("_text"))
    made = map_texts(chosen, run, "lang string, source string, term binary, n long, df long").withColumn("term", F.col("term").cast("string"))
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)): smoothed billionths, exact however large the counts."""
    whole = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", whole, (total + terms).cast("decimal(20,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def tallies(rows: DataFrame) -> DataFrame:
    """From rows (lang, a, b, left and right: the counts of a term in blocks a and b of sources as arrays of source and n; right is null where a is b): lang, s, t, cs, ct
    and m, the number of terms with counts cs in s and ct in t, for all pairs of sources (of one block: s before t) that share a term.

    Rows of two blocks are best kept together, as tables of terms by sources are made for each two blocks.
    """
    fields = pa.schema([("lang", pa.string()), ("s", pa.string()), ("t", pa.string()), ("cs", pa.int64()), ("ct", pa.int64()), ("m", pa.int64())])

    def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """For each entry: its row and source number; the sources in byte order; the counts."""
        entries = lists.flatten()
        own = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        names = entries.field("source").dictionary_encode()
        order = sorted(range(len(names.dictionary)), key=lambda i: names.dictionary[i].as_py().encode())
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return own, place[names.indices.to_numpy()], [names.dictionary[i].as_py() for i in order], entries.field("n").to_numpy()

    def dense(rows: int, own: np.ndarray, at: np.ndarray, n_sources: int, counts: np.ndarray) -> np.ndarray:
        found = np.zeros((rows, n_sources), np.int64)
        found[own, at] = counts
        return found

    def pairs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        """For each source of a batch of one language and two blocks: (its name, the others' names), and codes and numbers of (other, cs, ct)."""
        left = batch.column(batch.schema.get_field_index("left"))
        right = batch.column(batch.schema.get_field_index("right"))
        same = right.null_count == len(right)
        own, at, names, counts = flat(left)
        a = dense(len(left), own, at, len(names), counts)
        if same:
            b, others = a, names
        else:
            own, at, others, counts = flat(right)
            b = dense(len(right), own, at, len(others), counts)
        for i, s in enumerate(names):
            there = np.flatnonzero(a[:, i])
            first = i + 1 if same else 0
            row, t = np.nonzero(b[there, first:])
            if len(row):
                found = np.stack([t + first, a[there[row], i], b[there[row], t + first]])
                by = np.lexsort(found[::-1])
                found = found[:, by]
                new = np.flatnonzero(np.concatenate([[True], (found[:, 1:] != found[:, :-1]).any(axis=0)]))
                yield (s, others), found[:, new], np.diff(np.append(new, found.shape[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            found, m = np.concatenate([x[0] for x in parts], axis=1), np.concatenate([x[1] for x in parts])
            by = np.lexsort(found[::-1])
            found, m = found[:, by], m[by]
            new = np.flatnonzero(np.concatenate([[True], (found[:, 1:] != found[:, :-1]).any(axis=0)]))
            return found[:, new], np.add.reduceat(m, new)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, s, t), parts in held.items():
                found, m = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(m)), pa.array([s] * len(m)), pa.array([t] * len(m)), pa.array(found[0]), pa.array(found[1]), pa.array(m)], schema=fields)
            held.clear()

        for batch in rows_together(batches, TERM_ROWS):
            kind = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for k in dict.fromkeys(kind):
                chosen = batch.filter(pa.array([x == k for x in kind]))
                for (s, others), found, m in pairs(chosen):
                    ends = np.flatnonzero(np.diff(found[0], append=-1)) + 1
                    for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True):
                        held.setdefault((k[0], s, others[found[0, lo]]), []).append((found[1:, lo:hi], m[lo:hi]))
                    size += len(m)
                if size > HELD_PAIRS:
                    for key, parts in held.items():
                        held[key] = [merged(parts)]
                    size = sum(len(parts[0][1]) for parts in held.values())
                    if size > HELD_PAIRS // 2:
                        yield from out()
                        size = 0
        yield from out()

    return map_texts(rows.select("lang", "a", "b", "left", "right"), run, "lang string, s string, t string, cs long, ct long, m long")


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """counts of term_counts whose terms are in at least `least` documents of their language, with lang_n, their occurrences there."""
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).where(F.col("df") >= least).drop("df")
    return counts.drop("df").join(kept, ["lang", "term"])


def source_groups(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """A row per group: lang, source, terms (V), total (N), own_terms (those with a count), lang_total, and block, to which its source is dealt."""
    langs = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own_terms"))
    groups = counts.where("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK_SOURCES).alias("blocks"))
    return groups.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks")).drop("blocks")


def joint_counts(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, s, t, cs, ct, m for each pair of sources of a language, s before t by block and name, and each pair of counts, 0 included: the number of terms that have it."""
    blocks = kept.join(groups.select("lang", "source", "block"), ["lang", "source"])
    listed = blocks.groupBy("lang", "term", "block").agg(F.collect_list(F.struct("source", "n")).alias("left"))
    many = groups.where("block > 0").limit(1).count() > 0
    listed = materialize(listed) if many else listed
    nothing = F.lit(None).cast(listed.schema["left"].dataType)
    within = listed.where(F.size("left") > 1).select("lang", F.col("block").alias("a"), F.col("block").alias("b"), "left", nothing.alias("right"))
    rows = within
    if many:
        other = listed.select("lang", "term", F.col("block").alias("b"), F.col("left").alias("right"))
        across = listed.withColumnRenamed("block", "a").join(other, ["lang", "term"]).where("a < b").select("lang", "a", "b", "left", "right")
        rows = within.unionByName(across).sortWithinPartitions("lang", "a", "b")
    shared = materialize(tallies(rows).groupBy("lang", "s", "t", "cs", "ct").agg(F.sum("m").alias("m")))
    zero = F.lit(0).cast("long")
    cell = lambda cs, ct, m: F.struct(cs.alias("cs"), ct.alias("ct"), m.alias("m"))
    # A term that both have is none that only one or neither has.
    c = {k: F.col(k) for k in ("cs", "ct", "m")}
    cells = shared.select("lang", "s", "t", F.inline(F.array(cell(c["cs"], c["ct"], c["m"]), cell(c["cs"], zero, -c["m"]), cell(zero, c["ct"], -c["m"]), cell(zero, zero, c["m"]))))
    own = groups.select("lang", F.col("source").alias("s"), F.col("block").alias("_b"), "terms", F.col("own_terms").alias("_n"))
    other = groups.select("lang", F.col("source").alias("t"), F.col("block").alias("_c"), F.col("own_terms").alias("_m"))
    pairs = materialize(own.join(other, "lang").where("struct(_b, s) < struct(_c, t)").select("lang", "s", "t", (F.col("terms") - F.col("_n") - F.col("_m")).alias("m")))
    single = materialize(kept.groupBy("lang", "source", "n").agg(F.count("*").alias("m")))
    first = pairs.drop("m").join(single.select("lang", F.col("source").alias("s"), F.col("n").alias("cs"), zero.alias("ct"), "m"), ["lang", "s"])
    second = pairs.drop("m").join(single.select("lang", F.col("source").alias("t"), zero.alias("cs"), F.col("n").alias("ct"), "m"), ["lang", "t"])
    neither = pairs.select("lang", "s", "t", zero.alias("cs"), zero.alias("ct"), "m")
    whole = cells.unionByName(first).unionByName(second).unionByName(neither)
    return whole.groupBy("lang", "s", "t", "cs", "ct").agg(F.sum("m").alias("m"))


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language) and value: the divergence of source from item over all kept terms."""
    one = lambda name: groups.select("lang", F.col("source").alias(name), F.col("total").alias(f"{name}_total"), *(["terms"] if name == "s" else []))
    cells = joint_counts(kept, groups).join(one("s"), ["lang", "s"]).join(one("t"), ["lang", "t"])
    shares = [F.when(F.col("terms") > 0, share(F.col(f"c{x}"), F.col(f"{x}_total"), F.col("terms"))) for x in ("s", "t")]
    told = cells.select("lang", "s", "t", "m", shares[0].alias("ps"), shares[1].alias("pt"))
    total = lambda a, b: F.coalesce(F.sum(F.col("m") * divergence(F.col(a), F.col(b))), F.lit(0)).cast("long")
    both = told.groupBy("lang", "s", "t").agg(total("ps", "pt").alias("st"), total("pt", "ps").alias("ts"))
    way = lambda a, b, v: F.struct(F.col(a).alias("source"), F.col(b).alias("item"), F.col(v).alias("value"))
    return both.select("lang", F.inline(F.array(way("s", "t", "st"), way("t", "s", "ts"))))


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a kept term of the group with a larger share there than in the language) and value."""
    told = kept.join(groups.select("lang", "source", "terms", "total", "lang_total"), ["lang", "source"])
    told = told.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
    return told.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))


def audit_sources(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, most_ranks: int = MOST_RANKS) -> DataFrame:
    """lang, source, part, item, value and rank: `pair`, for each group all other sources of its language; `term`, for each group its terms of the largest value.

    Nulls count as ''.  Each row of docs is a document of its own, repeated or not.  Ties in value go by item.  Groups without terms stay: a language without kept terms has
    pairs of value 0.  Terms of any length count whole.  An empty table gives an empty result.
    """
    counts = materialize(term_counts(docs, text, lang, source))
    kept = materialize(kept_terms(counts, least))
    groups = materialize(source_groups(counts, kept))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda values, part: values.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pair_values(kept, groups), "pair").unionByName(ranked(term_values(kept, groups), "term").where(F.col("rank") <= most_ranks))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents; see audit_sources for nulls, ties, repeats, long texts and empty tables."""
    return audit_sources(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (
  SELECT lang, source, rid,
         translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS df FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS lang_n FROM c GROUP BY lang, term HAVING sum(df) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS terms, sum(lang_n)::HUGEINT AS lang_total FROM k GROUP BY lang),
g AS (
  SELECT d.lang, d.source, coalesce(any_value(v.terms), 0) AS terms, any_value(v.lang_total) AS lang_total, coalesce(any_value(t.total), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN v ON v.lang = d.lang
  LEFT JOIN (SELECT c.lang, c.source, sum(c.n) AS total FROM c JOIN k ON c.lang = k.lang AND c.term = k.term GROUP BY ALL) t ON t.lang = d.lang AND t.source = d.source
  GROUP BY d.lang, d.source),
cell AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.terms) AS p,
         1 + (1000000000::HUGEINT * (k.lang_n + 1)) // (g.lang_total + g.terms) AS lang_p
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(any_value(x.value), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT m.lang, m.source, o.source AS item, sum(((m.p - o.p) * (m.p - o.p)) // o.p) AS value
    FROM cell m JOIN cell o ON m.lang = o.lang AND m.term = o.term AND m.source <> o.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  GROUP BY a.lang, a.source, b.source),
term AS (SELECT lang, source, term AS item, (((p - lang_p) * (p - lang_p)) // lang_p)::BIGINT AS value FROM cell WHERE n > 0 AND p > lang_p),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT FROM term)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
