import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabmeter.llm import substrings
from tabmeter.llm.common import Staged, numbered
from llm_cases import SCHEMA, identity, prose


def brute(rows: list[tuple], length: int = 100) -> list[tuple]:
    """Every window of every text against the first place of its bytes."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first: dict[bytes, tuple] = {}
    for doc, text in order:
        data = (text or "").encode()
        for at in range(len(data) - length + 1):
            first.setdefault(hashlib.md5(data[at : at + length]).digest(), (doc, at))
    gone_at: dict[tuple, set] = {}
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            if first[hashlib.md5(data[at : at + length]).digest()] != (doc, at):
                gone[at : at + length] = True
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        out.append((doc, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def report(frame, **more):
    return sorted(((identity(r[0]) if r[0] is not None else None, *r[1:]) for r in substrings.removal_report(frame, **more).collect()), key=str)


def test_odd_rows_match_brute_force(odd_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert report(odd_docs) == brute(rows)


@pytest.mark.parametrize("hot", [2, 4096])
def test_shared_passages_match_brute_force(spark, monkeypatch, hot):
    """Copies, shared passages with different borders, periods, and a line in every text."""
    monkeypatch.setattr(substrings, "HOT", hot)
    draw, rows = random.Random(5), []
    passages = [prose(50 + i, 25) for i in range(4)]
    for i in range(40):
        parts = [prose(100 + i, draw.randint(3, 40)), draw.choice(passages)[draw.randint(0, 30) :], prose(7, 14)]
        draw.shuffle(parts)
        rows.append((i * 3, "\n".join(parts)))
    rows += [(1, rows[7][1]), (2, rows[7][1] + "!"), (200, "ab" * 300), (201, "ab" * 130 + "c"), (202, "abc" * 90)]
    frame = spark.createDataFrame([(d, t, "en", "a", None) for d, t in rows], SCHEMA).repartition(5)
    assert report(frame) == brute(rows)


def test_rows_that_share_an_id_but_not_a_text(spark):
    """Places of one text say nothing of another's bytes, and other documents are right."""
    shared = prose(61, 60)
    rows = [(1, shared), (1, "short"), (1, prose(62, 60)), (2, shared[50:] + prose(63, 20)), (3, prose(62, 60)[30:300])]
    frame = spark.createDataFrame([(d, t, "en", "a", None) for d, t in rows], SCHEMA)
    found = {r[0]: r for r in report(frame) if r[0] != 1}
    assert [found[i] for i in (2, 3)] == brute([rows[0], rows[3], (0, rows[2][1]), rows[4]])[2:]


def test_pieces_of_a_long_text_meet(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 500)
    monkeypatch.setattr(substrings, "CHUNK", 2000)
    text = prose(9, 900)
    rows = [(1, text), (2, text[1500:4200] + prose(10, 30) + text[100:777])]
    frame = spark.createDataFrame([(d, t, "en", "a", None) for d, t in rows], SCHEMA)
    assert report(frame) == brute(rows)


def test_triggers_depend_on_their_neighbours_only():
    draw = np.random.default_rng(2)
    data = draw.integers(97, 101, 5000).astype(np.uint8)
    whole = substrings.triggers(substrings.Rolling(data, substrings.BASES[0]).grams(substrings.GRAM))
    part = substrings.triggers(substrings.Rolling(data[1000:3000], substrings.BASES[0]).grams(substrings.GRAM)) + 1000
    inner = (1000 + substrings.REACH, 3000 - substrings.GRAM - substrings.REACH)
    assert [x for x in whole if inner[0] <= x < inner[1]] == [x for x in part if inner[0] <= x < inner[1]]


def test_stage_keeps_rows_and_whole_characters(spark, odd_docs, no_docs):
    cut = substrings.without_repeats(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[1] is None and texts[2] == "" and texts[4] == "é"
    assert substrings.removal_report(no_docs).collect() == [] == substrings.without_repeats(no_docs).collect()


def test_each_row_is_cut_by_its_own_spans(spark):
    """Null and shared ids: clean rows stay whole, and copies at equal places go."""
    seen, clean, other, twin = (prose(i, 60) for i in (71, 72, 73, 74))
    rows = [(1, seen), (2, other), (2, seen[:250]), (2, other), (None, seen[40:300]), (None, clean), (None, twin), (None, twin)]
    rows += [(None, None), (2, None), (None, prose(75, 20) + clean[:150])]
    frame = spark.createDataFrame([(d, t, "en", "a", None) for d, t in rows], SCHEMA).coalesce(1)
    ranked = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    whole = {rank: r for rank, *r in brute([(rank, rows[i][1]) for rank, i in enumerate(ranked)])}
    wanted = [(rows[i][0], *whole[rank]) for rank, i in enumerate(ranked)]
    assert report(frame) == sorted(wanted, key=str)
    texts = [r["text"] for r in substrings.without_repeats(frame).collect() if r["doc_id"] is None]
    assert clean in texts and texts.count(twin) == 1 and texts.count("") == 2


def test_settled_places_are_runs_dealt_by_row(spark):
    rows = [(1, "x" * 120_000)] + [(i, prose(5, 40)) for i in range(2, 18)]
    frame = spark.createDataFrame([(d, t, "en", "a", None) for d, t in rows], SCHEMA).coalesce(1)
    data = substrings.with_bytes(numbered(frame, Staged(spark)))
    settled = [r for r in substrings.entries(data, 100, 8).collect() if r["bucket"] >= 8]
    n = {r["bucket"]: np.frombuffer(r["n"], np.uint16) for r in settled if 1 in np.frombuffer(r["doc"], np.int64)}
    assert sum(len(x) for x in n.values()) < 10 and sum(int(x.sum()) for x in n.values()) > 119_000
    assert len({r["bucket"] for r in settled}) == 8
    assert report(frame) == brute(rows)


def test_no_letter_is_made_of_two_halves(spark):
    """Cuts that begin and end inside characters: what is left has only letters of the text."""
    shared = "".join(random.Random(8).choices("абвгдежзиклмнопрстуфхцчшы", k=120))
    rows = [(1, "xé" + shared + "é!"), (2, "aЩ" + shared + "ìb")]  # é and Щ end, é and ì begin alike
    frame = spark.createDataFrame([(d, t, "en", "a", None) for d, t in rows], SCHEMA)
    found = {r["doc_id"]: r["text"] for r in substrings.without_repeats(frame).collect()}
    assert found == {1: rows[0][1], 2: "ab"}
    assert substrings.cut("aЖ1éb".encode(), [{"lo": 2, "n": 1}], 3, whole=True)[0] == b"ab"
    assert substrings.cut("aЖ1éb".encode(), [{"lo": 2, "n": 1}], 3)[0].decode() == "aЩb"


def test_columns_with_inner_names_stay(spark, odd_docs):
    docs = odd_docs.withColumns({"llm_row": F.lit("mine"), "llm_spans": F.lit("too"), "Llm_row_": F.lit(1)})
    found = substrings.without_repeats(docs)
    assert found.columns == docs.columns
    assert {(r["llm_row"], r["llm_spans"], r["Llm_row_"]) for r in found.collect()} == {("mine", "too", 1)}
