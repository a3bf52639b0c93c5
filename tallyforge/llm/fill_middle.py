"""Fill-in-the-middle forms of documents by a streaming matcher in two passes.

A text is a sequence of units, the matches of a pattern.  The first pass counts them; two keyed ranks up to that count are drawn; the second pass moves a lazy iterator over
the matches on to the lower and then to the higher rank.  No list of units is ever held: beside a text and its output, memory is constant.  The forms are psm (prefix,
suffix, middle), spm (suffix, prefix, middle) and plain.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_bytes, map_texts, slices, table

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50
SLICE_BYTES = 8 << 20


def checked_marks(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """marks, if an output can be taken apart at them: each begins at its first character only, so that none can arise where text and mark meet."""
    if not all(marks) or len(set(marks)) < 3:
        raise ValueError("marks must be three different texts")
    for a in marks:
        for b in marks:
            if (a != b and a in b) or any(a.startswith(b[-k:]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"{a!r} may begin inside {b!r}")
    return marks


def cut_places(text: str, pattern: re.Pattern, r1: int, r2: int) -> tuple[int, int, int]:
    """n, the number of units, and the places where the first r1 mod (n + 1) and the first r2 mod (n + 1) of them end, the lower one first."""
    n = sum(1 for _ in pattern.finditer(text))
    low, high = sorted((r1 % (n + 1), r2 % (n + 1)))
    units, places, at, end = pattern.finditer(text), [], 0, 0
    for rank in (low, high):
        for m in islice(units, rank - at):
            end = m.end()
        at = rank
        places.append(end)
    return n, places[0], places[1]


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers from the first half of the SHA-256 of seed, colon and the decimal doc_id (nothing, if null)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def fill_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", units: str = LINES, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row; other columns are not carried, so their names don't matter.

    rate: of 100 texts, those that are transformed; spm_rate: of these, those of form spm.  A text that is null (taken as empty), empty or holds a mark is plain: its output is
    the text and its lengths are null.  Where units leave gaps, a gap goes to the part after it.  Rows with equal ids take the same draws; a null id draws as
    one id.  Long texts stay whole.  An empty table gives an empty one.
    """
    begin, between, last = checked_marks(marks)
    pattern = re.compile(units)
    kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())]

    def one(doc: int | None, t: str) -> tuple:
        r1, r2, r3, r4 = draws(doc, seed)
        n, low, high = cut_places(t, pattern, r1, r2)
        if not t or any(m in t for m in marks) or r3 % 100 >= rate:
            return doc, n, "plain", None, None, t
        if r4 % 100 < spm_rate:
            return doc, n, "spm", low, high - low, "".join((between, t[high:], begin, t[:low], last, t[low:high]))
        return doc, n, "psm", low, high - low, "".join((begin, t[:low], between, t[high:], last, t[low:high]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", SLICE_BYTES):
            # Bytes that are no UTF-8 come through as they are.
            rows = [one(doc, (t or b"").decode("utf-8", "surrogateescape")) for doc, t in zip(part.column(0).to_pylist(), column_bytes(part, "_text"), strict=True)]
            *plain, output = zip(*rows, strict=True)
            columns = [*plain, [o.encode("utf-8", "surrogateescape") for o in output]]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, k) in zip(columns, kinds, strict=True)], [name for name, _ in kinds])

    chosen = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("_text"))
    made = map_texts(chosen, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that output was made from."""
    begin, between, last = checked_marks(marks)

    def parts(first: str, second: str) -> list[Column]:
        """What stands after the first mark, after the second and after the last one."""
        body = F.substr(output, F.lit(len(first) + 1))
        front = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(front) + len(second) + 1)
        back = F.substring_index(rest, last, 1)
        return [front, back, F.substr(rest, F.length(back) + len(last) + 1)]

    prefix, suffix, middle = parts(begin, between)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(between, begin)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms, lengths and digests of every document; see fill_middle for nulls, empty and very long texts, repeats and empty tables."""
    made = fill_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units FROM d),
k AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS r1, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS r2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, array_to_string(units[1:least(r1, r2)], '') AS prefix, array_to_string(units[least(r1, r2) + 1:greatest(r1, r2)], '') AS middle,
         array_to_string(units[greatest(r1, r2) + 1:], '') AS suffix
  FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
