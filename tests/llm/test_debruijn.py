import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import SCHEMA, identity, prose
from tabmeter.llm import debruijn
from tabmeter.llm.common import Staged

BLANKS = re.compile("[^\x20\x09-\x0d]+")


def by_hand(rows, length=debruijn.LENGTH):
    """(doc_id, n_words, n_removed, sha256 of the kept words) of rows (doc_id, text)."""
    last = float("inf")
    texts = [(last if i is None else i, i, BLANKS.findall(text or "")) for i, text in rows]
    first: dict[tuple, float] = {}
    for doc, _, words in texts:
        for at in range(len(words) - length + 1):
            key = tuple(words[at : at + length])
            first[key] = min(first.get(key, last), doc)
    out = []
    for doc, doc_id, words in texts:
        gone = set()
        for at in range(len(words) - length + 1):
            if first[tuple(words[at : at + length])] < doc:
                gone.update(range(at, at + length))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((str(doc_id), len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def rows_of(frame):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in frame.collect())


def corpus(seed: int, docs: int) -> list[tuple]:
    """Texts from few words, with passages, copies, near copies and periodic stretches."""
    draw = random.Random(seed)
    passage = prose(seed, 40).split()
    rows = []
    for i in range(docs):
        words = [draw.choice("ab cd ef gh ij kl mn".split()) + str(draw.randrange(4)) for _ in range(draw.randrange(60))]
        kind = draw.randrange(6)
        if kind == 0:
            words += passage[draw.randrange(10) :] + words[:5]
        elif kind == 1 and rows:
            words = list(rows[draw.randrange(len(rows))][1].split())
            if words and draw.random() < 0.7:
                words[draw.randrange(len(words))] = "changed"
        elif kind == 2:
            words = ["tick", "tock", "tack"][: draw.randint(1, 3)] * draw.randint(1, 20) + words
        rows.append((draw.randrange(docs), draw.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize(("seed", "length"), [(1, 13), (2, 13), (3, 5), (4, 2), (5, 1)])
def test_matches_windows_compared_by_hand(spark, seed, length):
    rows = corpus(seed, 120)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = debruijn.deduplicate(docs, length).withColumn("kept_sha256", F.sha2("kept", 256))
    assert rows_of(found) == by_hand(rows, length)


def test_odd_rows(spark, odd_docs):
    docs = odd_docs.withColumns({x: F.lit("extra") for x in ("core", "phrase", "spans", "path", "kind", "llm_row")})
    docs = docs.unionAll(docs.where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("bigint")))
    docs = docs.unionAll(docs.where("doc_id IN (6, 103)").withColumn("doc_id", F.col("doc_id") + 1000))
    rows = [(identity(r["doc_id"]) if r["doc_id"] is not None else None, r["text"]) for r in docs.collect()]
    assert rows_of(debruijn.removal_report(docs)) == by_hand(rows)


def test_texts_longer_than_a_piece(spark):
    long = prose(3, 200_000)
    assert len(long) > debruijn.PIECE
    rows = [(5, long), (2, " ".join(long.split()[150_000:150_100])), (9, long[-900:]), (11, "x" * (1 << 21))]
    assert rows_of(debruijn.removal_report(spark.createDataFrame(rows, "doc_id bigint, text string"))) == by_hand(rows)


def test_no_rows(spark, no_docs):
    found = debruijn.removal_report(no_docs)
    assert found.collect() == [] and found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    blank = spark.createDataFrame([(1, None, None, None, None), (2, " ", None, None, None)], SCHEMA)
    assert rows_of(debruijn.removal_report(blank)) == by_hand([(1, None), (2, " ")])


def test_crowds_that_share_a_passage(spark):
    """A passage in every document makes its cores hot; their places need not meet."""
    passage = prose(7, 50)
    rows = [(i, f"{prose(i, 8)} {passage} {prose(i + 900, 8)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    texts = debruijn._texts(docs)
    assert len(debruijn.hot_cores(texts, 13)) > 5
    assert rows_of(debruijn.removal_report(docs)) == by_hand(rows)
    spans = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in debruijn.deduplicate(docs).collect()}
    words = len(passage.split())
    assert spans[0] == [] and spans[1] == [(8, words)]


def test_paths_are_whole(spark):
    """Two documents that share a passage give one path of all its windows."""
    passage = prose(11, 90)
    rows = [(1, f"{prose(1, 30)} {passage} {prose(2, 30)}"), (2, f"{prose(3, 20)} {passage} {prose(4, 20)}")]
    texts = debruijn._texts(spark.createDataFrame(rows, "doc_id bigint, text string"))
    staged = Staged(spark)
    found = staged.write(debruijn.shared_places(debruijn.places(texts, 13, np.empty(0, np.int64))), "places")
    parts = debruijn.repeated_paths(texts, found, staged, 13)
    placed = parts.selectExpr("path", "explode(sequence(at, at + n - 1)) AS at", "doc").distinct().collect()
    assert len({r["path"] for r in placed}) == 1 and {r["doc"] for r in placed} == {1}
    assert sorted(r["at"] for r in placed) == list(range(len(passage.split()) - 12))


@pytest.mark.parametrize("links", [{}, {2: 1, 3: 2, 4: 3, 9: 8}, {2: 1, 1: 2, 5: 5, 7: 6, 12: 11, 13: 12, 11: 13}])
def test_runs_join_to_paths_and_circles_open_at_the_smallest(spark, links):
    """Runs by number: a run begins at the node of its own number and ends at that of the next."""
    after = {b: a for a, b in links.items()}
    runs = [(r, -r, 0, 10 + r, r) for r in range(1, 14)]
    node = {r: r for r in range(1, 14)}
    rows = [(r, node[r], 100 + r if r not in after else node[after[r]], 0, 10 + r) for r, *_ in runs]
    frame = spark.createDataFrame(rows, "run bigint, tail bigint, head bigint, at bigint, n bigint")
    joints = spark.createDataFrame([(a,) for a in links], "node bigint")
    found = {r["run"]: (r["path"], r["skip"]) for r in debruijn.paths_of(frame, joints, Staged(spark)).collect()}
    expected = {}
    for r in links:
        chain, at = [r], r
        while at in links and links[at] not in chain:
            at = links[at]
            chain.append(at)
        if at in links:  # a circle
            low = min(chain)
            chain = chain[: chain.index(low) + 1]
            if r == low:
                continue
        expected[r] = (chain[-1], sum(10 + x for x in chain[1:]))
    assert found == expected


def test_phrases_cover_each_window_once(monkeypatch):
    monkeypatch.setattr(debruijn, "PIECE", 40)
    draw = random.Random(1)
    data = " \n".join(draw.choice(["a", "bb", "ccc"]) for _ in range(400)).encode()
    whole = data.split()
    seen = []
    for first, words in debruijn.word_chunks(data, 12):
        assert words == whole[first : first + len(words)]
        if len(words) >= 13:
            _, _, lo, n = debruijn.phrases(words, np.array([len(words)]), 13)
            seen += [first + a + i for a, b in zip(lo.tolist(), n.tolist()) for i in range(b)]
    assert seen == list(range(len(whole) - 12))


def test_cut_joins_overlapping_spans():
    lo, n = np.array([0, 1, 20]), np.array([1, 3, 1])
    kept, words, gone = debruijn.cut(" ".join(map(str, range(30))).encode(), lo, n, 5)
    assert (words, gone) == (30, [(0, 8), (20, 5)])
    assert kept.split() == [str(i) for i in range(30) if not (i < 8 or 20 <= i < 25)]
