import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tabmeter.llm import wordbpe

PATH = public_tokenizers.path(wordbpe.VOCABULARY)


@pytest.fixture(scope="module")
def both():
    return wordbpe.WordBpe(PATH), Tokenizer.from_file(PATH)


def encoded(bpe, text):
    words = [*bpe.split(text)]
    fresh = [w for w in dict.fromkeys(words) if isinstance(w, str)]
    known = dict(zip(fresh, bpe.encode_words(fresh), strict=True))
    return [i for w in words for i in (known[w] if isinstance(w, str) else [w])]


def agrees(both, text):
    bpe, library = both
    ids = library.encode(text, add_special_tokens=False).ids
    assert encoded(bpe, text) == ids
    assert " ".join(bpe.tokens[i] for i in ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(both, text):
    agrees(both, text)


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet="abcdehilnorst'ÉéßΣ0 .", max_size=80))
def test_word_like_text(both, text):
    agrees(both, text)


def test_special_strings_new_letters_and_long_words(both):
    for text in ("", "  \n", "<|endoftext|>A<|startoftext|> b", "don't WE'LL", "ab" * 4000, "İIıΣΑΣ", "a\U00018e04b", "é"):
        agrees(both, text)


def test_bulk_merging_is_merging(both):
    bpe, _ = both
    draw = random.Random(4)
    parts = [t.removesuffix(bpe.end) for t in draw.sample(bpe.tokens[600:49000], 400)]
    words = ["".join(draw.sample(parts, draw.randint(1, 3))) + "\0" for _ in range(500)]
    assert bpe.merge_all(words) == [bpe.merge(w) for w in words]


def test_pairs_are_checked_as_merging_goes(both):
    """Two tokens are compatible if merging their letters gives them back."""
    bpe, _ = both
    draw = random.Random(6)
    inner = [i for i in range(512, 49000) if not bpe.tokens[i].endswith(bpe.end)]
    final = [i for i in range(512, 49000) if bpe.tokens[i].endswith(bpe.end)]
    one, two = np.array([draw.choice(inner) for _ in range(600)]), np.array([draw.choice(final) for _ in range(600)])
    spelt = [bpe.tokens[a] + bpe.tokens[b].removesuffix(bpe.end) + "\0" for a, b in zip(one, two, strict=True)]
    merged = [bpe.merge(s) == [a, b] for s, a, b in zip(spelt, one.tolist(), two.tolist(), strict=True)]
    assert bpe.compatible(one, two).tolist() == merged and 50 < sum(merged) < 590


def test_odd_rows(odd_docs, no_docs, both):
    _, library = both
    expected = Counter()
    for row in odd_docs.select("doc_id", "text").collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digests = (hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        expected[(row["doc_id"], len(ids), *digests)] += 1
    assert Counter(tuple(r) for r in wordbpe.encoding_report(odd_docs).collect()) == expected
    assert wordbpe.encoding_report(no_docs).collect() == []


def test_forgetting_words_changes_nothing(odd_docs, monkeypatch):
    before = sorted(map(str, wordbpe.encoding_report(odd_docs).collect()))
    monkeypatch.setattr(wordbpe, "HELD", 1)
    monkeypatch.setattr(wordbpe, "BLOCK", 100)
    assert sorted(map(str, wordbpe.encoding_report(odd_docs).collect())) == before
