import itertools
import re
from collections import Counter

import numpy as np

from tabmeter.llm import linecrf
from llm_cases import SCHEMA, prose


def brute(text):
    """The base counts, straight from their definitions."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    base = (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
    return (*base, n < 20 or 100 * len(inside) > 30 * n)


def test_base_counts_on_odd_rows(odd_docs, no_docs):
    found = linecrf.quality_rules(odd_docs)
    assert found.columns == linecrf.NAMES
    texts = Counter((r["doc_id"], *brute(r["text"])) for r in odd_docs.collect())
    rows = found.collect()
    assert Counter(tuple(r)[:7] for r in rows) == texts
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert linecrf.quality_rules(no_docs).collect() == [] == linecrf.keep_good(no_docs).collect()
    kept = linecrf.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if r["kept"])


def test_repeated_windows_may_overlap():
    for text in ("a " * 30, "a b c d e f g h " * 2 + "x", prose(1, 40) + " " + prose(1, 40), "a b c d e f g h"):
        assert linecrf.measured(text)[0] == brute(text)[:5]


def test_viterbi_finds_the_best_of_all_paths():
    draw = np.random.default_rng(0)
    field = linecrf.LineField(draw.normal(size=(len(linecrf.FEATURES), 2)), draw.normal(size=(2, 2)))
    for n in range(1, 7):
        lines = [tuple(x) for x in draw.random((n, len(linecrf.FEATURES)))]
        scores = np.array(lines) @ field.weights

        def value(path):
            steps = sum(field.follow[a, b] for a, b in itertools.pairwise(path))
            return sum(scores[i, y] for i, y in enumerate(path)) + steps

        assert value(field.mark(lines)) == max(map(value, itertools.product((0, 1), repeat=n)))
    assert field.mark([]) == []


def test_training_raises_the_likelihood_and_learns_runs():
    clean, loud = linecrf.line_features("A line of words.", b"A line of words.".split(), False), (1.0, 1.0, *[0.0] * 8)
    field = linecrf.LineField.fit([[clean] * 6, [loud] * 6, [clean] * 3], [[0] * 6, [1] * 6, [0] * 3])
    assert field.mark([clean] * 4) == [0] * 4 and field.mark([loud] * 4) == [1] * 4
    assert field.follow[0, 0] > field.follow[0, 1] and field.follow[1, 1] > field.follow[1, 0]
    assert linecrf.LineField.fit([], []).mark([loud]) == [0]


def test_junk_goes_and_prose_stays(spark):
    rows, junk = [], set()
    for i in range(120):
        text = "\n".join(prose(1000 + 7 * i + j, 25) for j in range(3))
        if i % 3 == 0:
            junk.add(i)
            text = "\n".join(
                [" ".join(w + "***" for w in line.split()) if i % 2 else line.upper() + " !!" for line in text.split("\n")]
            )
        rows.append((i, text, "en", "a", None))
    found = linecrf.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"] for r in found if not r["kept"]} == junk


def test_training_reads_whole_texts(spark):
    rows = []
    for i in range(60):
        clean = [prose(9000 + 45 * i + j, 12) for j in range(40)]
        loud = [" ".join(w + "***" for w in prose(70_000 + 60 * i + j, 9).split()) for j in range(60)]
        rows.append((i, "\n".join(clean + loud), "en", "a", None))
    docs = spark.createDataFrame(rows, SCHEMA)
    field = linecrf.train(docs)
    assert field.weights.any()
    assert all(linecrf.judged(text, field)[6] < 0.6 for _, text, *_ in rows)
    assert all(not r["kept"] for r in linecrf.quality_rules(docs, field).collect() if r["content_share"] < 0.5)


def test_stretches_cover_every_line_evenly():
    lines = [(float(i),) for i in range(100)]
    found = Counter(x for i in range(4000) for x in linecrf.stretch(f"text {i}", lines, 32))
    assert set(found) == set(lines) and max(found.values()) < 1.3 * min(found.values())
    assert linecrf.stretch(None, [], 32) == [] and linecrf.stretch("a", lines[:32], 32) == lines[:32]
