"""Top-k search and WARC archives."""

import base64
import gzip
import hashlib
import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm.topk import OP2_SQL, Block, top_k
from tallyforge.llm.warc import archive_pages, parse, read_archives, unzipped, with_revisits, write_archives


def slow(rows, k, scale=256):
    values = [[math.floor(scale * x) for x in v] for _, v in rows]
    out = []
    for a, (i, _) in enumerate(rows):
        if i % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(values[a], values[b])), j) for b, (j, _) in enumerate(rows) if a != b)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [256, 8])
def test_search_equals_all_pairs(spark, scale):
    """At scale 8 nearly all scores tie; copies and negative values are among the rows."""
    rng = np.random.default_rng(scale)
    rows = [(i, v) for i, v in enumerate(np.round(rng.normal(size=(330, 5)), 2).tolist())]
    rows += [(1000 + i, rows[0][1]) for i in range(12)] + [(2000, [0.0] * 5), (2001, [-3.0, 2.5, 0.0, 0.0, 100.0]), (50, rows[3][1]), (50, rows[50][1]), (7, rows[0][1]), (7, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(df, F.col("vec_id") % 50 == 0, scale=scale, block_rows=100, query_rows=3)
    assert sorted(map(tuple, got.collect())) == slow(rows, 5, scale)


def test_search_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (None, [1.0, 1.0]), (50, [1.0, 0.0]), (7, [1.0, 2.0, 3.0]), (8, [70000.0, -1e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("width", F.lit("clash"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(df, F.col("vec_id") % 50 == 0).collect()}
    assert got[0, 1] == got[0, 2] == (6, 256 * 256 * 3) and (0, 4) in got and (0, 5) not in got and got[50, 1][0] == 8
    with pytest.raises(Exception, match="too large"):
        top_k(df.union(spark.createDataFrame([(9, [1e30, 0.0], 1)], "vec_id long, embedding array<double>, width string")), F.lit(True)).collect()
    assert top_k(df.where("false"), F.lit(True)).count() == 0 and top_k(df, F.lit(False)).count() == 0


def test_search_takes_large_components(spark):
    rows = [(0, [70000.0, 1.0]), (1, [80000.0, -2.0]), (2, [70000.0, 1.0]), (50, [-(2.0**20), 2.0**20]), (3, [2.0**20, -(2.0**14)]), (3, [2.0**20, -(2.0**14)]), (4, [2.0**50, 0.0]), (100, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(df.where("vec_id <> 4"), F.col("vec_id") % 50 == 0).collect()))
    assert got == slow([r for r in rows if r[0] != 4], 5)
    with pytest.raises(Exception, match="leaves a long"):
        top_k(df, F.col("vec_id") == 100).collect()
    assert sorted(map(tuple, top_k(df, F.col("vec_id") == 50).collect())) == [r for r in slow(rows, 5) if r[0] == 50]


def test_search_equals_its_sql_with_repeats(spark, same):
    rng = np.random.default_rng(8)
    rows = [(i % 60, v) for i, v in enumerate(np.round(rng.normal(size=(150, 3)), 1).tolist())] + [(0, None), (50, [1.0, None, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    same(top_k(df, F.col("vec_id") % 50 == 0), con.execute(OP2_SQL).df())


def test_block_counts_bits_exactly():
    rng = np.random.default_rng(0)
    values, queries = rng.integers(-300, 300, (130, 4)), rng.integers(-300, 300, (3, 4))
    block = Block.build(np.arange(130)[::-1], np.arange(130)[::-1], values[::-1])
    slices, base = block.sums(queries)
    for q in range(3):
        bits = [np.unpackbits(s[q].view(np.uint8), bitorder="little")[:130].astype(np.int64) for s in slices]
        assert (sum(b << i for i, b in enumerate(bits)) + base[q] == values @ queries[q]).all()


PAGES = [(1, "http://a/1", "<p>same</p>"), (3, "http://a/3", "<p>same</p>"), (2, None, "<p>same</p>"), (4, "http://a/4\r\nX: y", ""), (5, "http://a/5", None), (6, "u", "line\r\n\r\nWARC/1.1\r\n\r\nend é"), (7, "v", "long " * 100_000), (None, "w", "<p>same</p>"), (None, "w", "only null ids"), (8, "x", "twice"), (8, "x", "twice")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("n", F.lit("clash"))
    path = str(tmp_path / "warc")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in archive_pages(pages, path).collect()), key=repr)
    refers = {1: 3, 2: 3, 4: 5}
    want = []
    for i, _, html in PAGES:
        to = refers.get(i) if i is not None else (3 if html == "<p>same</p>" else None)
        want.append((i, len((html or "").encode()), digest(html), "revisit" if to else "response", to))
    assert got == sorted(want, key=repr)
    raw = [(h, b) for f in Path(path).rglob("part-*") for h, b in parse([gzip.decompress(f.read_bytes())])]
    assert all(len(list(parse([m]))) == 1 for f in Path(path).rglob("part-*") for m in unzipped(f.read_bytes()))
    assert len(raw) == len(PAGES) and all(int(h["content-length"]) == len(b) for h, b in raw)
    kept = {h["warc-record-id"]: b.partition(b"\r\n\r\n")[2] for h, b in raw if h["warc-type"] == "response"}
    assert kept["<urn:page:6>"] == PAGES[5][2].encode() and all(b.endswith(b"\r\n\r\n") for h, b in raw if h["warc-type"] == "revisit")


def test_small_payloads_and_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    found = {r["page_id"]: r["record_type"] for r in with_revisits(pages, min_bytes=12).collect()}
    assert found[1] == found[4] == "response"
    assert archive_pages(pages.where("false"), str(tmp_path / "none")).count() == 0
    write_archives(with_revisits(pages), str(tmp_path / "some"), file_bytes=200)
    assert len(list((tmp_path / "some").rglob("part-*"))) >= 6
    back = read_archives(spark, str(tmp_path / "some"), payloads=True)
    assert {bytes(r["payload"]) for r in back.where("record_type = 'response'").collect()} == {(h or "").encode() for _, _, h in PAGES}
    assert back.where("record_type = 'response' AND payload_digest <> stated_digest").count() == 0


def test_broken_archives_are_refused():
    with pytest.raises(ValueError):
        list(parse([b"WARC/1.1\r\nContent-Length: 10\r\n\r\nshort"]))
    with pytest.raises(ValueError):
        list(parse([b"garbage"]))
    with pytest.raises(ValueError):
        list(unzipped(gzip.compress(b"x" * 100)[:-9]))


def test_long_pages_and_dates_in_utc(spark, tmp_path):
    """Pages over a member's size; a session zone far from UTC."""
    import random
    from datetime import UTC, datetime

    rng = random.Random(1)
    rows = [(i, f"http://a/{i}", f"{i}" + "".join(chr(rng.randrange(32, 0x800)) for _ in range(1 << 20))) for i in range(3)] + [(9, "u", "x" * (17 << 20))]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        write_archives(with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")), str(tmp_path / "w"), file_bytes=1 << 20)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    back = {r["page_id"]: bytes(r["payload"]) for r in read_archives(spark, str(tmp_path / "w"), payloads=True).collect()}
    assert back == {i: h.encode() for i, _, h in rows}
    raw = [h for f in (tmp_path / "w").rglob("part-*") for h, _ in parse(unzipped(f.read_bytes()))]
    now = datetime.now(UTC).timestamp()
    assert all(abs(datetime.strptime(h["warc-date"] + "+0000", "%Y-%m-%dT%H:%M:%SZ%z").timestamp() - now) < 600 for h in raw)
