"""WARC archives: writing, reading, and revisit records for payloads that repeat.

Tasks make each record one gzip member, as is the custom, so that a record can be read alone.  Spark's own text writer writes the members, whatever store the path is
in and with its protection against lost tasks: it adds a separator to each row, so a row is a member without its last byte, and that byte, the highest of the
uncompressed size, is the separator, 0 for members of less than 16 MiB.  Longer records take several members.  A task begins a new file after FILE_BYTES.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_bytes, map_texts, materialize, scratch, slices, table

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of members after which a task begins a new file, and of content that one member holds.
FILE_BYTES, MEMBER_BYTES = 64 << 20, 15 << 20
#: Records' bytes that a task takes into Python at a time.
SLICE_BYTES = 16 << 20
BROADCAST_ROWS = 100_000
COLUMNS = "page_id long, record_type string, url string, refers_to long, payload_digest string, stated_digest string, payload_bytes long, payload binary"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits make four letters."""
    digest = F.sha1(data)
    letters = []
    for i in range(8):
        v = F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def record_text(date: Column) -> Column:
    """A record from page_id, url, html, payload_digest, payload_bytes and refers_to (null: response); without the blank lines that end it."""
    revisit = F.col("record_type") == "revisit"
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "_")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), http, F.when(revisit, "").otherwise(F.col("html")))


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload_digest, payload_bytes, record_type and refers_to.

    Of records with equal payloads of min_bytes at least, those with the largest page_id are responses (one, if ids are unique); the others revisit it, and so do those
    with a null page_id unless all are null.  A null html counts as empty.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), sha1_base32(html.cast("binary")).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    heads = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    shared = materialize(heads.where("n > 1").select("payload_digest", "largest"))
    found = rows.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, "payload_digest", "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return found.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("largest"))).drop("largest")


def members(record: bytes) -> Iterator[bytes]:
    """The gzip members of a record."""
    for at in range(0, max(1, len(record)), MEMBER_BYTES):
        yield gzip.compress(record[at : at + MEMBER_BYTES], 6, mtime=0)


def utc_now() -> Column:
    """Now, in UTC whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_archives(records: DataFrame, path: str, date: Column | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Gzipped archives with fresh headers, of about file_bytes each (one long record may exceed that), in a folder for each of a task's files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, file = 0, 0
        for part in slices(batches, "record", SLICE_BYTES):
            rows, files = [], []
            for record in column_bytes(part, "record"):
                if held >= file_bytes:
                    held, file = 0, file + 1
                for m in members(record + b"\r\n\r\n"):
                    rows.append(m[:-1])
                    files.append(file)
                    held += len(m)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(files, pa.int32())], ["value", "file"])

    made = map_texts(records.select(record_text(utc_now() if date is None else date).cast("binary").alias("record")), run, "value binary, file int")
    made.select(F.col("value").cast("string").alias("value"), "file").write.partitionBy("file").option("lineSep", "\0").text(path)


def unzipped(data: bytes) -> Iterator[bytes]:
    """What the gzip members of data hold, one by one."""
    while data:
        reader = zlib.decompressobj(31)
        out = reader.decompress(data) + reader.flush()
        if not reader.eof:
            raise ValueError("a gzip member is cut off")
        yield out
        data = reader.unused_data


def parse(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record; ValueError if one is broken.  parts: the content in order, cut anywhere; one record is held at a time."""
    parts, data = iter(parts), b""

    def more(n: int) -> bool:
        nonlocal data
        held, size = [data], len(data)
        while size < n and (x := next(parts, None)) is not None:
            held.append(x)
            size += len(x)
        data = b"".join(held)
        return size >= n

    while more(1):
        while (end := data.find(b"\r\n\r\n")) < 0 and more(len(data) + 1):
            pass
        if end < 0 or not data.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        head = dict(line.split(": ", 1) for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:])
        head = {k.lower(): v for k, v in head.items()}
        start, size = end + 4, int(head["content-length"])
        more(start + size + 4)
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where it says")
        yield head, data[start : start + size]
        data = data[start + size + 4 :]


def page_number(value: str | None) -> int | None:
    text = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return None if text in ("", "none") else int(text)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """COLUMNS of every record under path.  Digest and bytes are those of the payload that the record holds; payload is null unless asked for."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for head, block in parse(unzipped(content.as_py())):
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    stated = head.get("warc-payload-digest", "").removeprefix("sha1:")
                    held += len(payload) if payloads else 0
                    rows.append((page_number(head.get("warc-record-id")), head["warc-type"], head.get("warc-target-uri"), page_number(head.get("warc-refers-to")), digest, stated, len(payload), payload if payloads else None))
                    if len(rows) == 1000 or held > SLICE_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # A few files at a time: Spark counts rows, and each row is a file.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    return map_texts(files.select("content"), run, COLUMNS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records of read_archives with revisits' digest and bytes taken from the responses they refer to (null where there is none)."""
    originals = records.where("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("refers_to")).agg(F.max("payload_digest").alias("_digest"), F.max("payload_bytes").alias("_bytes"))
    wanted = originals.join(records.where("record_type = 'revisit'").select("refers_to").distinct(), "refers_to", "left_semi")
    again = records.where("record_type = 'revisit'").join(wanted, "refers_to", "left")
    again = again.withColumn("payload_digest", F.col("_digest")).withColumn("payload_bytes", F.col("_bytes")).drop("_digest", "_bytes")
    return records.where("record_type <> 'revisit'").unionByName(again)


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write deduplicated archives of pages under path, read them back, resolve their revisits.  An empty table gives an empty result."""
    write_archives(with_revisits(pages, min_bytes), path)
    return resolve_revisits(materialize(read_archives(pages.sparkSession, path).drop("payload")))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of archives read back; see with_revisits for nulls, ties and repeats.  Pages of any length are written whole; no pages: no rows."""
    found = archive_pages(table(spark, sf_dir, "pages"), scratch(spark))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j: substr('{BASE32}', (((('0x' || substr(h, (1 + 5 * (j // 4))::BIGINT, 5))::INTEGER >> (15 - 5 * (j % 4))::INTEGER) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM p
"""
