"""Mixing sources to target weights.

Documents get hash-random keys.  A source is taken as often as its target holds its size; of the rest, documents are taken in key order up to the exact word.
Where that is comes from prefix sums in steps: over wide ranges of the key, over the equal ranges in the one that holds the cut, then within one of these.  So a document's
part in the mix follows from its key and a row per source; no text moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, field, materialize, packed, table, unpacked

WEIGHTS, MOST_EPOCHS, SEED = (5, 2, 1), 3, 17
#: Documents in one range of keys, ranges in a wide one, and the most sources that are broadcast.
RANGE_ROWS, WIDE_RANGES, BROADCAST_SOURCES = 4096, 4096, 100_000


def word_count(text: Column | str) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id: Column | str, seed: int = SEED) -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def placed(rows: DataFrame, name: str) -> DataFrame:
    """rows with place: from 0 by name in code-point order, null last.  No task takes more than its range of names and a count for each range."""
    low = F.lit((1 << 33) - 1).cast("long")
    ordered = rows.orderBy(F.col(name).asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id())
    ordered = materialize(ordered.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(low)))
    ranges = ordered.groupBy("_range").agg(F.count("*").alias("_n"))
    ranges = ranges.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return ordered.join(F.broadcast(ranges), "_range").withColumn("place", F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """sizes (source, source_size, n: a row per source) with target.

    Sources in code-point order, null last, weigh weights in turn.  A target stops at most times its source's size; the others share what is left by weight, again and again until
    none is above: target = min(most * size, level * weight), where the targets sum to all sizes.  Each sharing is one aggregate over the sources.
    """
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int"))
    rows = materialize(placed(sizes, "source").withColumn("weight", weight).drop("place")).withColumn("cap", most * F.col("source_size"))
    level, full = 0.0, None
    whole, shares = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    while True:
        above = F.col("cap") / F.col("weight") < F.lit(level)
        capped, taken = rows.where(above).agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (capped, taken) == full or taken == shares:
            break
        level, full = (whole - capped) / (shares - taken), (capped, taken)
    return rows.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))).drop("weight", "cap")


def beside(left: DataFrame, right: DataFrame, n_right: int, *names: str) -> DataFrame:
    """Left join on null-safe equal names; right is broadcast if it has BROADCAST_SOURCES rows at most."""
    right = right.select(*(F.col(c).alias(f"_{c}") for c in names), *(c for c in right.columns if c not in names))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    return left.join(F.broadcast(right) if n_right <= BROADCAST_SOURCES else right, same, "left").drop(*(f"_{c}" for c in names))


def crossing(rows: DataFrame, at: str) -> DataFrame:
    """From rows (source, rest, before, size, at) the value of column at where a source's words reach rest: source, rest, at, words (there) and before (it)."""
    sums = rows.groupBy("source", "rest", "before", at).agg(F.sum("size").alias("words"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy(at))
    return sums.withColumn("upto", upto).where("upto - words < rest AND upto >= rest").select("source", "rest", at, "words", (F.col("upto") - F.col("words")).alias("before"))


def mix_plan(slim: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """A row per source of slim (source, size, key): source_size, target, epochs, cut_key, cut_words and cut_size.

    Taken are all documents epochs times, those with keys below cut_key once more, and of those at cut_key (of cut_size words in all) cut_words.
    """
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = targets(sizes, weights, most).withColumn("budget", F.floor("target")).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = materialize(sources.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).withColumn("ranges", F.ceil(F.col("n") / RANGE_ROWS)))
    n = sources.count()
    spread = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / 2.0**32).cast("long")
    rows = beside(slim, sources.select("source", "rest", "ranges"), n, "source").where("rest > 0").withColumn("range", spread)
    rows = rows.withColumn("wide", F.floor(F.col("range") / WIDE_RANGES).cast("long")).withColumn("before", F.lit(0).cast("long"))
    for step in ("wide", "range"):
        found = materialize(crossing(rows, step).select("source", step, "before"))
        rows = beside(rows.drop("before"), found, n, "source", step).where("before IS NOT NULL")
    cut = crossing(rows, "key").select("source", F.col("key").alias("cut_key"), (F.col("rest") - F.col("before")).alias("cut_words"), F.col("words").alias("cut_size"))
    return beside(sources, cut, n, "source").select("source", "source_size", "target", "epochs", "cut_key", "cut_words", "cut_size")


def with_mix(docs: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """docs (source, size, key) with the plan's columns and part: the words taken beyond epochs whole copies."""
    part = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.floor(F.col("cut_words") * (F.col("size") / F.col("cut_size"))).cast("long")).otherwise(0)
    return beside(docs, plan, n_sources, "source").withColumn("part", F.when(F.col("cut_key").isNull(), 0).otherwise(part).cast("long"))


def slim_rows(docs: DataFrame, text: str, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col(f"`{text}`")).alias("size"), mix_key("doc_id", seed).alias("key"))


def mix_sources(docs: DataFrame, text: str = "text", weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row of docs (doc_id, source, text).

    Null sources are a source of their own.  Null and blank texts have size 0 and are taken 0 times.  Rows with equal ids have equal keys; at
    the cut they share its words by size.  An empty table gives an empty one.
    """
    slim = materialize(slim_rows(docs, text, seed))
    plan = materialize(mix_plan(slim, weights, most))
    mixed = with_mix(slim, plan, plan.count())
    return mixed.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part")).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, text: str = "text", weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of docs as often as the mix takes them, with docs' columns; a document cut in the mix has its first words, joined by spaces.

    Rows of 0 words are not in the mix.
    """
    plan = materialize(mix_plan(materialize(slim_rows(docs, text, seed)), weights, most))
    own = packed(docs).select("row", field("source").alias("source"), word_count(field(text)).alias("size"), mix_key(field("doc_id"), seed).alias("key"))
    copies = F.concat(F.array_repeat(F.col("size"), F.col("epochs").cast("int")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")))
    rows = with_mix(own, plan, plan.count()).where("size > 0").select("row", "size", F.explode(copies).alias("words"))
    words = F.filter(F.split(field(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " ")).otherwise(field(text))
    return unpacked(rows, **{text: cut})


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; see mix_sources for null sources and texts, ties, repeats and empty tables.  Long texts count whole."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH slim AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':17') AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM slim GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sizes),
rows AS (SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS level
  FROM rows WINDOW f AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size,
         least(cap::DOUBLE, coalesce((SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1), 0) * weight) AS target
  FROM levels),
part AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS epochs FROM goal),
kept AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs, floor(p.target)::BIGINT - p.epochs * p.source_size AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM slim s JOIN part p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, rest - before)))::BIGINT AS taken FROM kept
"""
