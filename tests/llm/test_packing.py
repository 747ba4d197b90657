import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabmeter.llm import packing
from llm_cases import SCHEMA, prose


def checked(rows: list[tuple], pieces: list, window: int) -> list:
    """Every id in one piece, no gap and no overlap in windows, and ids as the library's."""
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts, got = defaultdict(list), defaultdict(list)
    for row in rows:
        texts[row["doc_id"]].append([*library.encode(row["text"] or "", add_special_tokens=False).ids, 1])
    for piece in pieces:
        got[piece["doc_id"]].append(piece)
    assert texts.keys() == got.keys()
    for doc, own in texts.items():
        assert sum(map(len, own)) == sum(p["length"] for p in got[doc])
        if len(own) == 1:
            parts = sorted(got[doc], key=lambda p: p["start"])
            assert b"".join(bytes(p["ids"]) for p in parts) == np.array(own[0], "<u4").tobytes()
            assert [p["start"] for p in parts] == [0, *np.cumsum([p["length"] for p in parts])[:-1]]
            assert {p["doc_tokens"] for p in parts} == {len(own[0])}
    line = sorted((p["sequence_id"] * window + p["offset"], p["length"]) for p in pieces)
    assert [at for at, _ in line] == [0, *np.cumsum([size for _, size in line])[:-1]]
    assert all(p["offset"] + p["length"] <= window for p in pieces)
    return line


def test_odd_rows_are_packed_whole(odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    checked(rows, packing.pack(odd_docs, window=128).collect(), 128)
    report = packing.packing_report(odd_docs)
    assert report.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ids = {(r["doc_id"], r["start"]): zlib.crc32(bytes(r["ids"])) for r in packing.pack(odd_docs).collect()}
    assert {(r["doc_id"], r["start"]): r["ids_crc32"] for r in report.collect()} == ids


def test_special_strings_are_the_librarys(spark):
    frame = spark.createDataFrame([(1, "a<|endoftext|>b <|endoftext|>", "en", "a", None)], SCHEMA)
    pieces = packing.pack(frame).collect()
    checked(frame.collect(), pieces, packing.WINDOW)
    assert 50256 in np.frombuffer(bytes(pieces[0]["ids"]), "<u4")


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0}, {"a": 1.0, "b": 0.0, "c": 1.0}, {}])
def test_windows_hold_the_mixture(spark, weights):
    sizes = {"a": 60, "b": 20, "c": 6}
    rows = [(i, prose(i, 40 + i % 50), "en", s, None) for i, s in enumerate(x for s, n in sizes.items() for x in [s] * n)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    pieces = packing.pack(frame, window=256, weights=weights).collect()
    line = checked(frame.collect(), pieces, 256)
    source = {r[0]: r[3] for r in rows}
    mixed = defaultdict(lambda: defaultdict(int))
    totals = defaultdict(int)
    for p in pieces:
        mixed[p["sequence_id"]][source[p["doc_id"]]] += p["length"]
        totals[source[p["doc_id"]]] += p["length"]
    whole = sum(totals.values())
    assert whole == sum(size for _, size in line)
    if weights is None:  # all sources last to the end
        for number in range(whole // 256 - 1):
            for s, n in totals.items():
                assert abs(mixed[number][s] - 256 * n / whole) <= 3
    elif weights == {"a": 3.0, "b": 1.0}:  # as long as both last; the third comes after them
        assert all(abs(mixed[n]["a"] - 192) <= 3 and mixed[n]["c"] == 0 for n in range(4))
        assert max(mixed) == max(n for n in mixed if mixed[n]["c"])


def test_deficits_carry_over_rounds():
    schedule = packing.Schedule({"a": 1000, "b": 7}, {"a": 1.0, "b": 0.01}, 10)
    taken = [size for start, size, line in schedule.places(1, 0, 7)]
    assert sum(taken) == 7 and len(taken) == 7  # a token whenever its credit is whole
    assert [s for s, _, _ in schedule.places(0, 995, 5)][0] == 0


def test_empty_table(no_docs):
    assert packing.pack(no_docs).collect() == []


def test_negative_weights_are_refused():
    with pytest.raises(ValueError):
        packing.Schedule({"a": 1}, {"a": -1.0}, 8)
