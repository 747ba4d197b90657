import random

import numpy as np
import pytest

from tabmeter.llm import simhash
from tabmeter.llm.common import Staged
from tabmeter.llm.components import connected_components
from llm_cases import SCHEMA, prose


def grouped(fps: dict[int, int], bits: int = 2) -> dict[int, int]:
    """The smallest key of each key's group, by comparing all pairs."""
    low = {k: k for k in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= bits and low[b] < low[a]:
                    low[a], changed = low[b], True
    return low


def test_fingerprint_counts_repeated_shingles():
    import xxhash

    words = "a b c a b c d".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(5)]
    expected = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > 5)
    assert simhash.fingerprint("A b C a b\tc d") == expected
    assert simhash.fingerprint("Two words") == xxhash.xxh64_intdigest("two words", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("ÄB x y") == xxhash.xxh64_intdigest("ÄB x y".replace("B", "b"), 42)


def test_matches_all_pairs_on_odd_rows(odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == len(rows)
    fps = {}
    for i, row in enumerate(rows):
        fps[i] = simhash.fingerprint(row["text"])
    group = grouped(fps)
    lowest: dict[int, int] = {}
    for i, row in enumerate(rows):
        if row["doc_id"] is not None:
            lowest[group[i]] = min(lowest.get(group[i], row["doc_id"]), row["doc_id"])
    expected = sorted((str(r["doc_id"]), f"{fps[i]:016x}", lowest.get(group[i])) for i, r in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in found) == expected


@pytest.mark.parametrize("pairwise", [4, 256])
def test_links_of_crowded_buckets_are_whole(spark, monkeypatch, pairwise):
    """Chains, stars and random flips around few centres, with small and large buckets."""
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    draw = random.Random(3)
    fps = set()
    for _ in range(6):
        centre = draw.getrandbits(64)
        for _ in range(40):
            fps.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3))))
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    staged = Staged(spark)
    found = staged.write(simhash.verified_links(simhash.variant_rows(frame)), "found")
    assert (found.where("deep IS NOT NULL").count() > 0) == (pairwise == 4)
    links = found.where("deep IS NULL").select("a", "b").unionAll(simhash.deep_links(found))
    got = {r["node"]: r["component"] for r in connected_components(links, staged).collect()}
    for a, b in links.collect():
        assert ((a ^ b) % (1 << 64)).bit_count() <= 2
    assert {x: got.get(x, x) for x in signed} == grouped({x: x % (1 << 64) for x in signed})


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 200)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    draw = random.Random(1)
    draw.shuffle(links)
    frame = spark.createDataFrame([x if draw.random() < 0.5 else x[::-1] for x in links], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in connected_components(frame, Staged(spark)).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {500 + i: 500 for i in range(1, 50)}


def test_one_of_each_group_stays_and_empty_tables_pass(spark, odd_docs, no_docs):
    copies = [(i, prose(1, 50), "en", "a", None) for i in (9, 4, 6)] + [(5, prose(2, 50), "en", "a", None)]
    kept = simhash.keep_one(spark.createDataFrame(copies, SCHEMA))
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5]
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 2 and ids.count(7) == 1 and ids.count(1) == 1 and ids.count(2) == 0 and ids.count(100) == 1
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.keep_one(no_docs).collect() == []


def test_one_row_of_each_group_whatever_its_id(spark):
    one, two, three, four = (prose(i, 50) for i in (21, 22, 23, 24))
    rows = [(1, one), (1, two), (None, one), (None, three), (None, three), (None, three), (5, four), (3, four), (3, four)]
    for parts in (1, 4):
        frame = spark.createDataFrame([(d, t, "en", "a", None) for d, t in rows], SCHEMA).repartition(parts)
        kept = simhash.keep_one(frame)
        assert kept.schema == frame.schema
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
            [(1, one), (1, two), (None, three), (3, four)], key=str
        )


def test_a_column_named_like_the_row_number_stays(spark, odd_docs):
    docs = odd_docs.selectExpr("*", "'mine' AS llm_row", "'hash' AS llm_hash")
    found = simhash.keep_one(docs)
    assert found.columns == docs.columns
    assert {(r["llm_row"], r["llm_hash"]) for r in found.collect()} == {("mine", "hash")}
