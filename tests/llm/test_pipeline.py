"""The pipeline's stages on a small table, each against a plain version of what it decides."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tallyforge.llm.simhash import simhash

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    words = {"en": "the and of to that with this from house".split(), "fr": "le la des une dans pour avec été maison".split()}
    rows = [(i, " ".join(rng.choice(words[k]) + str(rng.randrange(50)) for _ in range(40)), k, f"s{i % 2}", 0) for i, k in enumerate(["en", "fr"] * 20)]
    rows += [(100 + i, rows[i][1], rows[i][2], "s1", 0) for i in range(5)] + [(200, None, "en", "s0", 0), (201, "12 34 !!", "en", "s0", 0), (202, rows[3][1] + " mail ann@x.org", None, "s1", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit("own")).withColumn("_row", F.lit(1)).withColumn("a.b", F.lit("dot")).coalesce(2)


def test_stages(spark, docs, tmp_path):
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "pii", "mixing", "packing"] and P.ORACLE_SQL is None
    docs.write.parquet(str(tmp_path / "0"))
    kept = [spark.read.parquet(str(tmp_path / "0"))]
    for k, (_, stage) in enumerate(P.STAGES, 1):
        stage(spark, kept[-1], "").write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
    for df in kept[1:-1]:
        assert df.schema.simpleString() == kept[0].schema.simpleString()
    ids = [sorted(r["doc_id"] for r in df.collect()) for df in kept]
    assert set(ids[0]) - set(ids[1]) == {200, 201} and kept[1].where("lang IS NULL").count() == 0
    prints = {r["doc_id"]: simhash(r["text"].encode()) for r in kept[1].collect()}
    for i in ids[1]:
        least = [j for j in ids[2] if (prints[i] ^ prints[j]).bit_count() <= 4]
        assert least and (i in ids[2]) == (i in least)
    assert len(set(ids[2])) == len(ids[2]) and not set(range(100, 105)) & set(ids[2])
    assert ids[3] == ids[2] and kept[3].where(F.col("text").contains("ann@x.org")).count() == 0
    assert kept[3].where("n_chars <> length(text)").count() == 0
    whole = {r["doc_id"]: r["text"].split() for r in kept[3].collect()}
    for r in kept[4].collect():
        assert r["text"].split() == whole[r["doc_id"]][: len(r["text"].split())]
    n = kept[4].agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert abs(n - sum(map(len, whole.values()))) <= 4
    pieces = kept[5]
    assert {r["doc_id"] for r in pieces.collect()} == set(ids[4]) and pieces.where("offset + length > 2048").count() == 0


def test_an_empty_table_goes_through(spark, docs):
    out = docs.where("false")
    for _, stage in P.STAGES:
        out = stage(spark, out, "")
    assert out.count() == 0
