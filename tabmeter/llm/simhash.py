"""SimHash near-duplicates: deletion-variant signatures over two segments."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tabmeter.llm.common import ROW, Staged, free, numbered, rows_of
from tabmeter.llm.components import connected_components

SEED = 42
SHINGLE = 3
BITS = 64
SEGMENT = 32  # two segments: of two differing bits, one segment has one at most
PAIRWISE = 256  # up to so many fingerprints of a bucket are compared with each other
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the hashes of all shingles of a text; 0 without words."""
    # bytes know no letters and blanks but those of ASCII
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):  # bounded memory for very long texts
        octets = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the unsigned fingerprint read as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text, width) for (text,) in rows_of(batch, "text")]
            fps = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def variants(fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each segment and each of its bits: the segment with that bit deleted."""
    for segment in range(BITS // SEGMENT):
        part = (fps >> np.uint64(SEGMENT * segment)) & np.uint64(2**SEGMENT - 1)
        for bit in range(SEGMENT):
            yield segment * SEGMENT + bit, part & ~np.uint64(1 << bit)


def variant_rows(distinct: DataFrame) -> DataFrame:
    """(variant, part, fp): 64 rows of a fingerprint, which fingerprints within two bits share
    at least one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), CHUNK):
                own = fps[at : at + CHUNK]
                for number, part in variants(own.view(np.uint64)):
                    key = (np.uint64(number) << np.uint64(SEGMENT)) | part
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own)], ["variant", "fp"])

    return distinct.select("fp").mapInArrow(run, "variant bigint, fp bigint")


def verified_links(rows: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b, deep): a spanning forest of the links in each bucket of equal variants.

    Buckets are read in order as a stream. A bucket of up to PAIRWISE fingerprints is
    compared in memory and gives fewer links than it has members. From a larger one each
    fingerprint goes on, with `deep` set, to `deep_links`, which finds the rest by equality.
    """

    def forest(fps: np.ndarray) -> list[tuple[int, int]]:
        far = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) > bits
        parent, found = list(range(len(fps))), []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in zip(*np.nonzero(np.triu(~far, 1)), strict=True):
            if (x := root(i)) != (y := root(j)):
                parent[y] = x
                found.append((int(fps[i]), int(fps[j])))
        return found

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("deep", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, large = None, np.empty(0, np.int64), False

        def close() -> list[tuple[int, int, int | None]]:
            if key is None or large or len(held) < 2:
                return []
            return [(a, b, None) for a, b in forest(held)]

        for batch in batches:
            keys = batch.column("variant").to_numpy(zero_copy_only=False)
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts = np.concatenate([[0], cuts]) if len(keys) else np.empty(0, np.int64)
            ends = np.concatenate([cuts, [len(keys)]])
            out: list[tuple[int, int, int | None]] = []
            # of the buckets inside the batch only those with several rows matter
            inner = [k for k in range(len(starts)) if k in (0, len(starts) - 1) or ends[k] - starts[k] > 1]
            for k in inner:
                own = fps[starts[k] : ends[k]]
                if keys[starts[k]] != key:
                    out += close()
                    key, held, large = keys[starts[k]], own, False
                else:
                    held = own if large else np.concatenate([held, own])
                if len(held) > PAIRWISE or large:
                    number = int(key >> SEGMENT)
                    out += [(int(fp), int(fp), number) for fp in held]
                    held, large = np.empty(0, np.int64), True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)
        if out := close():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)

    dealt = rows.repartition("variant").sortWithinPartitions("variant", "fp")
    return dealt.mapInArrow(run, "a bigint, b bigint, deep bigint")


def deep_links(found: DataFrame) -> DataFrame:
    """Links (a, b) among the members of large buckets, by equality alone.

    Members of a bucket differ by one bit at most in its segment. Two of them link if the
    other segment differs by one bit (equal after deleting it), or if the bucket's segment
    is equal and the other differs by two (equal after deleting both). All that share such a
    key are within two bits of each other, so a star to the smallest loses no link. The
    keys of a fingerprint are few whatever the size of the bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "mask_key", "fp"]
        for batch in batches:
            numbers = batch.column("deep").to_numpy(zero_copy_only=False)
            for number in np.unique(numbers):
                fps = batch.column("a").to_numpy(zero_copy_only=False)[numbers == number]
                other = 0 if number >= SEGMENT else SEGMENT
                single = [1 << (other + bit) for bit in range(SEGMENT)]
                masks = [(1 << int(number)) | one for one in single]
                masks += [x | y for i, x in enumerate(single) for y in single[i + 1 :]]
                for mask in masks:
                    key = fps.view(np.uint64) & ~np.uint64(mask)
                    kind = np.full(len(fps), mask, np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key.view(np.int64)), pa.array(fps)], names)

    members = found.where("deep IS NOT NULL").select("a", "deep").distinct()
    keys = members.mapInArrow(run, "kind bigint, mask_key bigint, fp bigint")
    low = keys.groupBy("kind", "mask_key").agg(F.min("fp").alias("b"), F.max("fp").alias("top"))
    stars = keys.join(low.where("b < top"), ["kind", "mask_key"]).where("fp <> b")
    return stars.select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, width: int = SHINGLE, bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs` (doc_id, text).

    Documents link if their fingerprints differ by at most `bits` (2) bits; component_id is
    the smallest doc_id reachable. Equal fingerprints are one node, so a group of copies
    costs one row however large it is. Null and empty texts, and texts of white space, have
    fingerprint zero and link like any other. Rows that share a doc_id each keep their row;
    a null doc_id keeps its row too and never names a component unless all members are
    null. An empty table gives an empty result; other columns are not read.
    """
    if bits != 2:
        raise ValueError("two segments and one deleted bit find links of up to two bits")
    staged = Staged(docs.sparkSession)
    marked = staged.write(fingerprints(docs, width), "fingerprints")
    classes = staged.write(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    found = staged.write(verified_links(variant_rows(classes), bits), "found")
    shallow = found.where("deep IS NULL").select("a", "b").distinct()
    joined = connected_components(shallow.unionAll(deep_links(found)), staged)
    members = classes.join(joined, classes.fp == joined.node, "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component")
    )
    lowest = members.groupBy("component").agg(F.min("low").alias("component_id"))
    named = staged.write(members.join(lowest, "component").select("fp", "component_id"), "named")
    staged.drop(found, classes)
    # classes of copies may be hot: join by (fp, salt) is left to the adaptive skew join
    hexed = F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint")
    return marked.join(named, "fp").select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, all columns kept.

    Rows are grouped each by its own text, whatever their ids. The smallest doc_id stays; of
    rows that share it the smallest hash of the text, then the smallest row number. Rows
    without an id come last. Rows with neither an id nor a word all stay."""
    staged = Staged(docs.sparkSession)
    number = free(ROW, docs.columns)
    rows = numbered(docs, staged, number)
    groups = near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"))
    named = groups.select(F.col("doc_id").alias(ROW), "fingerprint", "component_id")
    places = rows.select(F.col(number).alias(ROW), "doc_id", F.xxhash64("text").alias("llm_hash"))
    members = staged.write(named.join(places, ROW), "members")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "llm_hash", ROW)
    first = members.groupBy("component_id").agg(F.min(order).alias("first")).select(f"first.{ROW}")
    blank = members.where(F.col("doc_id").isNull() & (F.col("fingerprint") == "0" * (BITS // 4))).select(ROW)
    stay = first.unionAll(blank).withColumnRenamed(ROW, number)
    return rows.join(stay, number, "left_semi").select(*[f"`{c}`" for c in docs.columns])
