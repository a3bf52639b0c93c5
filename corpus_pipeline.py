"""Corpus pipeline: language ID, near-duplicate removal, surrogates for personal data, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs.  All but the last return the
columns of documents; rows are whole documents and, after mixing, copies of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import materialize, row_id, table
from tallyforge.llm.language_id import UNKNOWN, identify_rows, learn
from tallyforge.llm.mixing import mixed_documents
from tallyforge.llm.packing import pack_documents
from tallyforge.llm.pii import replace_pii, session_key
from tallyforge.llm.simhash import one_per_group

#: A language must be at least so likely among those learned.
LEAST_SCORE = 0.5
#: Words that a worker remembers while packing: few, since workers live on and other stages need the memory.
REMEMBERED = 300_000
#: Exceptions that are broadcast at most.
BROADCAST_ROWS = 100_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those of no clear language.  A null lang takes the prediction; others stay.

    Where no row names a language, none can be told: then all documents with a letter stay as they are.  Rows meet only the exceptions, which are few.
    """
    learned = learn(docs)
    if not learned.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows, found = identify_rows(docs.select(row_id().alias("rid"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("keep"), "text"), learned)
    nameless = rows.where(F.col("keep.lang").isNull()).select("rid", F.lit(True).alias("nameless"))
    clear = (F.col("pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    special = found.select("rid", "pred", clear.alias("clear")).join(nameless, "rid", "left").where("NOT clear OR nameless")
    special = materialize(special.select("rid", "clear", "pred"))
    met = rows.join(F.broadcast(special) if special.count() <= BROADCAST_ROWS else special, "rid", "left").where("clear IS NULL OR clear")
    return met.select(*((F.coalesce("keep.lang", "pred") if c == "lang" else F.col("keep").getField(c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays."""
    return one_per_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(replace_pii(docs, session_key(spark)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's cut in part."""
    return counted(mixed_documents(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED)


def counted(docs: DataFrame) -> DataFrame:
    """n_chars after text has changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("packing", packing),
]

#: Byte tries, fingerprints and tokens are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
