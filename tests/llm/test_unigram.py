import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest

from tabmeter.llm import unigram
from llm_cases import SCHEMA

PATH = public_tokenizers.path(unigram.VOCABULARY)
TEXTS = {
    "en": "the cat and the dog went to the house with the children and they were happy there",
    "de": "der hund und die katze gingen mit den kindern in das haus und waren dort glücklich",
    "fr": "le chien et le chat sont allés à la maison avec les enfants et ils étaient heureux",
}


def summed(word: str, chances: np.ndarray) -> np.ndarray:
    """The chance of all segmentations, by recursion over the first piece."""
    own, _ = unigram.pieces(PATH)
    number = {t: i for i, t in enumerate(own)}

    def rest(text):
        if not text:
            return np.ones(chances.shape[1])
        total = chances[-1] / unigram.LETTERS * rest(text[1:])
        for n in range(1, len(text) + 1):
            if text[:n] in number:
                total = total + chances[number[text[:n]]] * rest(text[n:])
        return total

    return rest(unigram.MARK + word)


@pytest.fixture(scope="module")
def chances():
    draw = np.random.default_rng(0)
    own, _ = unigram.pieces(PATH)
    table = draw.random((len(own) + 1, 3)) ** 4
    return table / table.sum(axis=0)


def test_forward_sums_all_segmentations(chances):
    words = ["thing", "größe", "a", "éàü", "日本", "aaaaa", "interesting"]
    found = unigram.Lattice(words, PATH).log_chances(chances)
    assert np.allclose(found, np.log([summed(w, chances) for w in words]), atol=1e-9)


def test_expected_uses_are_the_gradient(chances):
    words, weight = ["thing", "the", "thin"], np.array([[2.0, 1, 1], [1, 3, 1], [1, 1, 1]])
    uses = unigram.Lattice(words, PATH).uses(chances, weight)
    own, _ = unigram.pieces(PATH)
    for piece in ("th", "ing", "▁the", "t"):
        k, more = own.index(piece), chances.copy()
        more[k] *= 1 + 1e-5
        change = unigram.Lattice(words, PATH).log_chances(more) - unigram.Lattice(words, PATH).log_chances(chances)
        assert np.allclose((change * weight).sum(axis=0) / 1e-5, uses[k], rtol=1e-3, atol=1e-9)


def test_long_and_strange_words_stay_in_range(chances):
    found = unigram.Lattice(["x" * 40, "\U0001d11e" * 0 + "ʬ" * 40, "日" * 40], PATH).log_chances(chances)
    assert np.isfinite(found).all() and (found > -1500).all()


def test_long_runs_are_summed_whole(chances):
    """A run of 200 letters against a sum in logarithms, letter by letter."""
    own, _ = unigram.pieces(PATH)
    number = {t: i for i, t in enumerate(own)}
    words = [(TEXTS["en"] + TEXTS["de"]).replace(" ", "")[:200].ljust(200, "z"), "ʬ日" * 500, "the"]
    for word, found in zip(words, unigram.Lattice(words, PATH).log_chances(chances), strict=True):
        text = unigram.MARK + word
        logs = [np.zeros(chances.shape[1])]
        for end in range(1, len(text) + 1):
            ways = [logs[end - 1] + np.log(chances[-1] / unigram.LETTERS)]
            ways += [
                logs[start] + np.log(chances[number[text[start:end]]])
                for start in range(max(0, end - 40), end)
                if text[start:end] in number
            ]
            logs.append(np.logaddexp.reduce(ways))
        assert np.allclose(found, logs[-1], rtol=1e-9, atol=1e-8)


def test_uses_of_a_long_run_are_the_gradient(chances):
    words, weight = [("theinteresting" * 20)], np.ones((1, 3))
    uses = unigram.Lattice(words, PATH).uses(chances, weight)
    own, _ = unigram.pieces(PATH)
    for piece in ("th", "ing", "e"):
        k, more = own.index(piece), chances.copy()
        more[k] *= 1 + 1e-6
        change = unigram.Lattice(words, PATH).log_chances(more) - unigram.Lattice(words, PATH).log_chances(chances)
        assert np.allclose(change[0] / 1e-6, uses[k], rtol=1e-3, atol=1e-6)


def corpus(spark):
    rows = []
    for i in range(90):
        lang = list(TEXTS)[i % 3]
        words = TEXTS[lang].split()
        rows.append((i, " ".join(words[(i * 7 + j * 5) % len(words)] for j in range(12)), lang, "a", None))
    return spark.createDataFrame(rows, SCHEMA)


def test_held_out_documents_are_identified(spark):
    found = unigram.predict_languages(corpus(spark)).collect()
    for row in found:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
        assert row["lang_pred"] == list(TEXTS)[row["doc_id"] % 3] and 0.5 < row["score"] <= 1.0


def test_held_out_languages_teach_nothing(spark):
    docs = corpus(spark)
    turned = docs.selectExpr(
        "doc_id", "text", "IF(crc32(CAST(doc_id AS STRING)) % 4 = 2, 'xx', lang) AS lang", "source", "n_chars"
    )
    assert sorted(unigram.predict_languages(docs).collect()) == sorted(unigram.predict_languages(turned).collect())


def test_odd_rows(odd_docs, no_docs, spark):
    rows = {}
    for row in unigram.predict_languages(odd_docs).collect():
        rows[row["doc_id"]] = row
    assert {rows[i]["lang_pred"] for i in (1, 2, 3)} == {"und"} and rows[100]["lang_pred"] == "en"
    assert rows[None]["held_out"] is False
    assert unigram.predict_languages(no_docs).collect() == []
    untaught = unigram.predict_languages(odd_docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()
    assert {(r["lang_pred"], r["score"]) for r in untaught} == {("und", 0.0)}
    digits = spark.createDataFrame([(1, "123 _ ...", None, None, None)], SCHEMA)
    model = unigram.Languages(["en"], np.full((len(unigram.pieces(PATH)[0]) + 1, 1), 1e-5), PATH)
    assert unigram.predict_languages(digits, model).first()["lang_pred"] == "und"


def test_letters_are_those_of_the_categories_l():
    assert unigram.letter_runs("½ ² ① Ⅷ 日本 a_b éÀ ª x2y 一 ٣") == ["日本", "a", "b", "éÀ", "ª", "x", "y", "一"]
    for c in map(chr, range(0x110000)):
        if not 0xD800 <= ord(c) < 0xE000:
            assert bool(unigram.LETTER.fullmatch(c)) == (unicodedata.category(c)[0] == "L"), hex(ord(c))


def test_texts_of_number_forms_have_no_language(spark):
    rows = [(4 * i + k, TEXTS[lang], lang, "s", 1) for i in range(12) for k, lang in enumerate(TEXTS)]
    rows += [(1000, "½ ² ①", None, "s", 1), (1001, "Ⅷ 3/4", None, "s", 1)]
    found = {r["doc_id"]: r["lang_pred"] for r in unigram.predict_languages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1000] == found[1001] == "und" and found[0] == "en"
