"""SimHash near-duplicates against all pairs."""

import random
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm.graph import connected_components
from tallyforge.llm.simhash import bucket_links, components, near_duplicates, near_links, one_per_group, segment_count, simhash, variant_masks


def groups(items, linked):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def near(a, b, d=4):
    return (a ^ b).bit_count() <= d


def planted(n, seed=1):
    """Chains and clusters: each new one flips a few bits of an earlier one, or is fresh."""
    rng = random.Random(seed)
    out = [0, (1 << 64) - 1]
    while len(out) < n:
        x = rng.choice(out) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted(set(out))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_by_definition():
    text = "The quick\tbrown fox JUMPS over the lazy dog É"
    words = "the quick brown fox jumps over the lazy dog É".split()
    hashes = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(len(words) - 3)]
    want = sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))
    assert simhash(text.encode()) == want
    assert simhash(None) == simhash(b" \n") == 0
    assert simhash(b"one two") == xxhash.xxh64(b"one two", seed=42).intdigest()


@pytest.mark.parametrize("distance", range(7))
def test_any_pair_within_reach_shares_a_variant(distance):
    rng = random.Random(distance)
    masks = variant_masks(segment_count(distance))
    assert segment_count(4) == 3 and len(masks) == 64
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), distance))
        assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("block", [3, 4096])
@pytest.mark.parametrize("distance", [1, 4, 5])
def test_links_connect_what_all_pairs_connect(spark, block, distance):
    items = planted(250)
    df = spark.createDataFrame([(signed(x),) for x in items], "fp long")
    links = [(x["a"] % (1 << 64), x["b"] % (1 << 64)) for x in near_links(df, distance, block).collect()]
    assert all(near(a, b, distance) for a, b in links)
    have = set(links) | {(b, a) for a, b in links}
    assert groups(items, lambda a, b: (a, b) in have) == groups(items, lambda a, b: near(a, b, distance))


def test_three_hundred_chains_stay_whole(spark):
    """Chains of four, each end out of the other's reach, through components(), over different numbers of partitions."""
    rng = random.Random(3)
    chains = []
    for _ in range(300):
        x, chain = rng.getrandbits(64), []
        places = rng.sample(range(rng.choice((12, 21, 64))), 12)
        for k in range(4):
            chain.append(x)
            for b in places[4 * k % 12 : 4 * k % 12 + 4]:
                x ^= 1 << b
        chains.append(chain)
    rows = [(1000 * i + k, 1000 * i + k, signed(x)) for i, chain in enumerate(chains) for k, x in enumerate(chain)]
    for parts in (1, 7):
        rng.shuffle(rows)
        found = components(spark.createDataFrame(rows, "rid long, doc_id long, fp long").repartition(parts)).collect()
        first = {r["fp"]: r["first"]["doc_id"] for r in found}
        assert all(first[signed(x)] == 1000 * i for i, chain in enumerate(chains) for x in chain)


def test_bucket_links_are_few():
    fps = np.array([1 << i for i in range(40)], np.uint64)
    assert len(bucket_links(fps)) == 39  # all 780 pairs are near
    assert sorted(bucket_links(np.array([0, 1, 1 << 40, (1 << 64) - 1, 3], np.uint64), 1)) == [(0, 1), (0, 1 << 40), (1, 3)]


@pytest.mark.parametrize("order", list(permutations(range(4))))
def test_bucket_links_follow_a_chain_in_every_order(order, monkeypatch):
    """Chains whose bits all lie in one segment, so that no other bucket repairs a lost link."""
    chain = [0x0, 0xF, 0xFF, 0xFFF]
    fps = np.array([chain[i] for i in order] + [(1 << 64) - 1], np.uint64)
    for matrix in (0, 512):
        monkeypatch.setattr("tallyforge.llm.simhash.MATRIX_ROWS", matrix)
        links = bucket_links(fps)
        assert all(near(a, b) for a, b in links) and len(links) == 3
        assert len(set(groups(chain, lambda a, b, links=links: (a, b) in links or (b, a) in links))) == 1


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["part"] for r in connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


BASE = " ".join(f"w{i}" for i in range(300))
ROWS = [(5, BASE), (3, BASE), (9, BASE + " tail"), (1, "other text of its own"), (2, None), (7, ""), (8, " \n"), (4, "x"), (4, "x"), (None, BASE), (None, "alone without an id")]


def test_documents_and_edges(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("rid", F.lit(1)).withColumn("row", F.lit(2))
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect()), key=repr)
    parts = groups([(simhash((t or "").encode())) for _, t in ROWS], near)
    least = {}
    for (i, _), p in zip(ROWS, parts):
        least[p] = min([x for x in (least.get(p), i) if x is not None], default=None)
    assert got == sorted(((i, least[p]) for (i, _), p in zip(ROWS, parts)), key=repr)
    kept = one_per_group(docs).collect()
    assert len(kept) == len(set(parts)) and kept[0]["fp"] == "clash" and set(kept[0].asDict()) == set(docs.columns)
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} == {x for x in least.values() if x is not None}
    assert near_duplicates(docs.where("false")).count() == 0 and one_per_group(docs.where("false")).count() == 0


def test_one_per_group_when_the_splits_change_between_reads(spark, tmp_path, monkeypatch):
    """As when an executor is lost or added: later plans cut the same files elsewhere."""
    import tallyforge.llm.simhash as S

    spark.createDataFrame([(i, f"text number {i} of its own") for i in range(40)], "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "docs"))
    conf, real = "spark.sql.files.maxPartitionBytes", S.materialize
    before = spark.conf.get(conf)

    def changed(df):
        out = real(df)
        spark.conf.set(conf, "65536")
        return out

    monkeypatch.setattr(S, "materialize", changed)
    try:
        assert S.one_per_group(spark.read.parquet(str(tmp_path / "docs"))).count() == 40
    finally:
        spark.conf.set(conf, before)
