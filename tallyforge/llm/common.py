"""Helpers that the operators of this folder share: tables, scratch space, byte classes and row ids."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space that separates words: space and the five controls 0x09 to 0x0D, as bytes.split() has it.
SPACE = b" \t\n\r\x0b\x0c"
#: A-Z to a-z; every other byte stays.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Texts that go to Python at a time.
TEXT_ROWS = 512
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder of spark.checkpoint.dir; where that is unset, in a temporary folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tallyforge-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_count(rows: int, rows_per_bucket: int) -> int:
    """Buckets needed so that each holds about rows_per_bucket rows."""
    return max(1, math.ceil(rows / rows_per_bucket))


def id_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id counts as empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def row_id() -> Column:
    """A number for each row, by partition and place: the same each time the same files are read."""
    return F.monotonically_increasing_id()


def map_texts(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow, with batches of TEXT_ROWS rows at most from here on in the session: Spark counts rows, and texts are large."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(conf)) <= TEXT_ROWS:
        df.sparkSession.conf.set(conf, str(TEXT_ROWS))
    return df.mapInArrow(f, schema)


def rows_together(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches put together until they hold that many rows."""
    kept, held = [], 0
    for batch in batches:
        kept.append(batch)
        held += batch.num_rows
        if held >= rows:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept, held = [], 0
    if kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


def packed(docs: DataFrame) -> DataFrame:
    """docs as one struct column, row: so that columns added beside it can't clash with its own, whatever their names."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def field(name: str) -> Column:
    return F.col("row").getField(name)


def unpacked(rows: DataFrame, **changed: Column) -> DataFrame:
    """The columns that packed() took, those named in changed with new values."""
    return rows.select(*(changed.get(c, field(c)).alias(c) for c in rows.schema["row"].dataType.names))


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], name: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices whose column name holds about limit bytes at most (one long value may exceed it)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)



def gathered(batches: Iterable[pa.RecordBatch], name: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches put together until column name holds about limit bytes."""
    kept, held = [], 0
    for batch in batches:
        kept.append(batch)
        held += batch.column(batch.schema.get_field_index(name)).nbytes
        if held >= limit:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept, held = [], 0
    if kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


def segments(text: bytes, limit: int = 1 << 20) -> Iterator[bytes]:
    """text in parts of about limit bytes, cut before white space only, so that words stay whole."""
    at = 0
    while len(text) - at > limit:
        end = min((i for i in (text.find(s, at + limit) for s in (b" ", b"\n")) if i >= 0), default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]
