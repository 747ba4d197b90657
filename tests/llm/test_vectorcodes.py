import hashlib
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import CLASHES
from tabmeter.llm import vectorcodes
from vector_cases import VECTORS, floored, gap, moved, odd_vectors, spread

PARTS = vectorcodes.PARTS


def nearest(part, entries):
    return min(range(len(entries)), key=lambda i: (gap(part, entries[i]), i))


def by_hand(rows, entries=vectorcodes.ENTRIES, rounds=vectorcodes.ROUNDS):
    ints = [(i, floored(v, vectorcodes.SCALE), label) for i, v, label in rows]
    ints.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(ints[0][1]) // PARTS
    cut = [[v[p * width : (p + 1) * width] for _, v, _ in ints] for p in range(PARTS)]
    books = [own[:entries] for own in cut]
    for _ in range(rounds):
        books = [moved(b, own, [nearest(x, b) for x in own]) for b, own in zip(books, cut, strict=True)]
    codes = [[nearest(x, b) for x in own] for b, own in zip(books, cut, strict=True)]
    errors = [sum(gap(cut[p][i], books[p][codes[p][i]]) for p in range(PARTS)) for i in range(len(ints))]
    whole: dict = {}
    for (_, _, label), error in zip(ints, errors, strict=True):
        whole[label] = whole.get(label, 0) + error
    text = ",".join(str(x) for b in books for entry in b for x in entry)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted(
        (str(vec_id), "".join(f"{codes[p][i]:02x}" for p in range(PARTS)), errors[i], whole[label], digest)
        for i, (vec_id, _, label) in enumerate(ints)
    )


def rows_of(frame):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in frame.collect())


def test_looked_up_distances_are_the_plain_ones():
    draw = np.random.default_rng(1)
    vectors, books = draw.integers(-3, 4, (200, 12)), draw.integers(-3, 4, (3, 5, 4))
    block = vectorcodes.Block.read(*vectorcodes.Block.of(vectors).written())
    chosen, least = block.nearest(books)
    for p in range(3):
        for i, vector in enumerate(vectors.tolist()):
            part = vector[4 * p : 4 * p + 4]
            assert chosen[p, i] == nearest(part, books[p].tolist())
            assert least[p, i] == gap(part, books[p, chosen[p, i]].tolist())
    counts, sums = block.sums(chosen, 5)
    for p in range(3):
        for e in range(5):
            own = vectors[chosen[p] == e, 4 * p : 4 * p + 4]
            assert counts[p, e] == len(own) and sums[p, e].tolist() == own.sum(axis=0).tolist()


@pytest.mark.parametrize("width", [8, 64])
def test_matches_rounds_worked_out_by_hand(spark, monkeypatch, width):
    monkeypatch.setattr(vectorcodes, "BLOCK", 16)
    rows = [(i, v, None if i % 3 == 0 else i % 4) for i, v in enumerate(spread(90, width, width))]
    rows += [(3, rows[5][1], 1), (3, rows[5][1], 1), (None, rows[8][1], None)]
    table = spark.createDataFrame(rows + odd_vectors(width), VECTORS).repartition(4)
    table = table.withColumns({name: F.lit("extra") for name in (*CLASHES, "ints", "salt", "code", "error", "ids", "places")})
    assert rows_of(vectorcodes.compression_report(table)) == by_hand(rows)


def test_early_rounds_are_rounds_too(spark):
    rows = [(i, v, 0) for i, v in enumerate(spread(60, 16, 9))]
    for rounds in (0, 1):
        coded, books = vectorcodes.compress(spark.createDataFrame(rows, VECTORS), rounds=rounds)
        expected = [(r[0], r[1], r[2]) for r in by_hand(rows, rounds=rounds)]
        assert sorted((str(r["vec_id"]), r["code"], r["error"]) for r in coded.collect()) == expected
        assert books.shape == (8, 16, 2)


def test_codes_name_the_entries_that_stand_for_a_vector(spark):
    rows = [(i, v, 0) for i, v in enumerate(spread(40, 8, 11))]
    coded, books = vectorcodes.compress(spark.createDataFrame(rows, VECTORS))
    vectors = {i: floored(v, vectorcodes.SCALE) for i, v, _ in rows}
    for r in coded.collect():
        decoded = [x for p, e in enumerate(bytes.fromhex(r["code"])) for x in books[p, e].tolist()]
        assert gap(decoded, vectors[r["vec_id"]]) == r["error"]


def test_few_rows_copies_and_none(spark):
    few = [(i, v, None) for i, v in enumerate(spread(3, 8, 12))]
    assert rows_of(vectorcodes.compression_report(spark.createDataFrame(few, VECTORS))) == by_hand(few)
    copies = [(i, [0.25] * 8, 1) for i in range(40)]
    assert rows_of(vectorcodes.compression_report(spark.createDataFrame(copies, VECTORS))) == by_hand(copies)
    for empty in ([], odd_vectors(8)[:7]):
        none = vectorcodes.compression_report(spark.createDataFrame(empty, VECTORS))
        assert none.collect() == [] and len(none.columns) == 5
    with pytest.raises(ValueError, match="256"):
        vectorcodes.compress(spark.createDataFrame([], VECTORS), entries=257)


def test_label_error_beyond_a_long_is_null(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "compress", partial(vectorcodes.compress, rounds=0))
    rows = [(i, [15000.0 * (-1) ** i] * 64, 1) for i in range(16)]
    rows += [(100 + i, [0.0] * 64, 2) for i in range(200)]
    found = vectorcodes.compression_report(spark.createDataFrame(rows, VECTORS).repartition(2)).collect()
    assert {(r["error"], r["label_error"]) for r in found} == {(0, 0), (64 * 61440000**2, None)}
