"""Language identification by prediction by partial matching: one frozen trie per language, the shortest code wins.

The tries are a table of grams by language.  Texts are coded exactly under the whole counts of every language: what each gram costs in each language is worked out once for all
grams met; the frequent ones, few by rule, go to every task, the others meet their costs in a join.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .common import LOWER, column_bytes, id_remainder, map_texts, materialize, row_id, slices, table
from .ppm import GramCounter, Lookup, gram_values, grams

ORDER = 3
#: 2**TOP_BITS values (grams by languages) at most go to every task.
TOP_BITS = 21
#: Languages whose sums are columns of one grouping; more take several rows.
WIDTH = 64
UNKNOWN = "und"


@dataclass
class Learned:
    """Languages in order of name, log10 of their shares of rows, and counts (lang, code, n) of the grams of each."""

    names: list[str]
    prior: list[float]
    counts: DataFrame


def language_counts(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> DataFrame:
    """lang, code and n over all rows with a lang; A-Z are lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, GramCounter] = defaultdict(GramCounter)

        def out() -> Iterator[pa.RecordBatch]:
            for name, c in counted.items():
                codes, n = c.take()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), codes, n], ["lang", "code", "n"])
            counted.clear()

        for part in slices(batches, "_text"):
            texts = defaultdict(list)
            for name, t in zip(part.column(0).to_pylist(), column_bytes(part, "_text"), strict=True):
                texts[name].append((t or b"").translate(LOWER))
            for name, own in texts.items():
                for codes, _, _ in grams(own, order):
                    counted[name].add(codes)
            if sum(c.held for c in counted.values()) > 1 << 21:
                yield from out()
        yield from out()

    found = map_texts(docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("_text")).where("lang IS NOT NULL"), run, "lang string, code long, n long")
    return found.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> Learned:
    """All languages that docs name, however few rows or grams they have."""
    shares = docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count("*").alias("n")).orderBy("lang").collect()
    n_all = sum(r["n"] for r in shares)
    return Learned([r["lang"] for r in shares], [log10(r["n"] / n_all) for r in shares], materialize(language_counts(docs, text, lang, order)))


def met_grams(rows: DataFrame, order: int) -> DataFrame:
    """code and met: how often each gram stands in the texts of rows (text; lower-cased A-Z), null ones left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = GramCounter()
        for part in slices(batches, "text"):
            for codes, _, _ in grams([t.translate(LOWER) for t in column_bytes(part, "text")], order):
                counter.add(codes)
            if counter.held > 1 << 21:
                yield pa.RecordBatch.from_arrays([*counter.take()], ["code", "met"])
        yield pa.RecordBatch.from_arrays([*counter.take()], ["code", "met"])

    return map_texts(rows.where("text IS NOT NULL").select("text"), run, "code long, met long").groupBy("code").agg(F.sum("met").alias("met"))


def code_lengths(rows: DataFrame, values: DataFrame, n_languages: int, order: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """rid and keep, and rid and sums (log10 by language; null for null texts) of rows (rid, keep, text), by values (code, met, values).

    Grams that make up 2**-bits of those met go to every task; the others meet their values in a join.
    """
    n_met = values.agg(F.coalesce(F.sum("met"), F.lit(0))).first()[0]
    common = F.col("met") * float(1 << bits) >= n_met
    top = values.where(common).select("code", "values").toArrow()
    matrix = np.zeros((top.num_rows + 1, n_languages))  # the last row, 0, stands for grams not found
    if top.num_rows:
        matrix[:-1] = np.array(top["values"].to_pylist())
    shared = rows.sparkSession.sparkContext.broadcast((Lookup(top["code"].to_numpy()), matrix))
    keep = rows.schema["keep"].dataType
    kinds = [pa.int64(), to_arrow_type(keep), pa.list_(pa.float64()), pa.int64(), pa.int64()]
    names = ["rid", "keep", "sums", "code", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, chances = shared.value
        for part in slices(batches, "text", 2 << 20):
            texts = column_bytes(part, "text")
            some = [i for i, t in enumerate(texts) if t is not None]
            rid, sums = part.column(0).to_numpy(), np.zeros((len(texts), n_languages))
            for codes, starts, owners in grams([texts[i].translate(LOWER) for i in some], order):
                place = lookup.find(codes)
                of = np.array(some)[owners]
                for j in range(n_languages):
                    np.add.at(sums[:, j], of, np.add.reduceat(chances[place, j], starts))
                lost = np.flatnonzero(place < 0)
                if len(lost):
                    at = np.searchsorted(starts, lost, "right") - 1
                    new, which = np.unique(codes[lost], return_inverse=True)
                    pairs, tf = np.unique(at * len(new) + which, return_counts=True)
                    n = len(pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(rid[of[pairs // len(new)]]), pa.nulls(n, kinds[1]), pa.nulls(n, kinds[2]), pa.array(new[pairs % len(new)].astype(np.int64)), pa.array(tf)], names)
            own = pa.array([list(x) if t is not None else None for x, t in zip(sums.tolist(), texts, strict=True)], kinds[2])
            n = len(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), own, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)

    schema = StructType().add("rid", "long").add("keep", keep).add("sums", ArrayType(DoubleType())).add("code", "long").add("tf", "long")
    out = materialize(map_texts(rows.select("rid", "keep", "text"), run, schema))
    whole = out.where("code IS NULL").select("rid", "keep", "sums")
    met = out.where("code IS NOT NULL").select("rid", "code", "tf").join(values.where(~common).select("code", "values"), "code")
    width = min(n_languages, WIDTH)
    chunks = F.transform(F.sequence(F.lit(0), F.lit((n_languages - 1) // width)), lambda c: F.slice("values", c * width + 1, F.lit(width)))
    parts = met.select("rid", "tf", F.posexplode(chunks).alias("chunk", "own")).groupBy("rid", "chunk").agg(*(F.sum(F.col("tf") * F.get("own", F.lit(j))).alias(f"s{j}") for j in range(width)))
    rare = parts.select("rid", "chunk", F.array(*(f"s{j}" for j in range(width))).alias("own")).groupBy("rid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "own"))), lambda x: x["own"])).alias("more"))
    both = F.zip_with("sums", "more", lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    found = whole.select("rid", "sums").join(rare, "rid", "left").select("rid", F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.slice(both, 1, n_languages)).alias("sums"))
    return whole.select("rid", "keep"), found


def identify_rows(rows: DataFrame, learned: Learned, bits: int | None = None, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """From rows (rid, keep, text): rid and keep of every row, and rid, pred and score of every row, by one reading of rows, so that rids agree.

    und and 0 for texts that are null or have no letter, and if no language was learned.  Of equal codes the first language by name wins.
    """
    rows = rows.select("rid", "keep", F.when(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)), F.col("text").cast("binary")).alias("text"))
    unknown = [F.lit(UNKNOWN).alias("pred"), F.lit(0.0).alias("score")]
    if not learned.names:
        rows = materialize(rows.select("rid", "keep"))
        return rows, rows.select("rid", *unknown)
    n = len(learned.names)
    bits = max(4, TOP_BITS - (n - 1).bit_length()) if bits is None else bits
    met = materialize(met_grams(rows, order))
    wanted = met.select("code", F.explode(F.array(*map(F.lit, learned.names))).alias("lang")).join(learned.counts, ["lang", "code"], "left")
    each = gram_values(wanted, learned.counts, order, "lang").groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("lang", "value"))), lambda x: x["value"]).alias("values"))
    values = materialize(each.join(met, "code"))
    kept, found = code_lengths(rows, values, n, order, bits)
    total = F.zip_with("sums", F.array(*map(F.lit, learned.prior)), lambda a, b: a + b)
    found = found.select("rid", total.alias("total")).select("rid", "total", F.array_max("total").alias("best"))
    rest = F.aggregate("total", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), F.greatest(x - F.col("best"), F.lit(-300.0))))
    pred = F.get(F.array(*map(F.lit, learned.names)), (F.array_position("total", F.col("best")) - 1).cast("int"))
    told = F.col("best").isNotNull()
    return kept, found.select("rid", F.when(told, pred).otherwise(UNKNOWN).alias("pred"), F.when(told, 1 / rest).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, learned: Learned, text: str = "text", names: tuple[str, str] = ("lang_pred", "lang_score"), bits: int | None = None) -> DataFrame:
    """docs with two columns of the given names more: the language, and its chance among the languages by Bayes' rule; see identify_rows.

    Columns of docs that have the new names already, in whatever case, give way to them.
    """
    columns = [c for c in docs.columns if c.lower() not in {x.lower() for x in names}]
    rows = docs.select(row_id().alias("rid"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("keep"), F.col(f"`{text}`").alias("text"))
    kept, found = identify_rows(rows, learned, bits)
    return kept.join(found, "rid").select(*(F.col("keep").getField(c).alias(c) for c in columns), F.col("pred").alias(names[0]), F.col("score").alias(names[1]))


def learned_rows(doc_id: Column | str = "doc_id") -> Column:
    return id_remainder(doc_id, 4) != 2


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; see identify_rows for nulls and ties.  Repeated rows each get their row, very long texts are read whole, an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    learned = learn(docs.where(learned_rows()))
    kept, found = identify_rows(docs.select(row_id().alias("rid"), F.struct("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out")).alias("keep"), "text"), learned)
    return kept.join(found, "rid").select("keep.doc_id", "keep.held_out", F.col("pred").alias("lang_pred"), "score")
