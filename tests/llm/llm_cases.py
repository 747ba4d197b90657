"""Rows and texts that the tests of this folder share."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside, as extra columns of their input.
CLASHES = ("fp", "component", "row", "hits", "doc", "lo", "n", "queue", "signs", "words", "ids", "data", "start", "score", "kept")


def prose(seed: int, words: int) -> str:
    """Made-up sentences, the same for the same seed."""
    draw = random.Random(seed)
    parts = ["ba", "ke", "li", "mon", "tar", "su", "fin", "dor", "pel", "ga", "ru", "ven", "sti", "ho", "ny"]
    out = []
    for i in range(words):
        word = "".join(draw.choice(parts) for _ in range(draw.randint(1, 4)))
        out.append(word.capitalize() + "" if i % 9 == 0 else word + "." * (i % 9 == 8))
    return " ".join(out) + "."


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 3),
    (None, "no id here " * 12, "en", None, None),
    (None, None, None, None, None),
    (4, "é" * 400, None, "b", 400),
    (5, "x" * 120_000, "en", "b", None),
    (6, "one two three four five " * 3000, "en", "a", None),
    (7, "same row twice, same row twice", "en", "a", 1),
    (7, "same row twice, same row twice", "en", "a", 1),
    (8, "tabs\tand\x0bforms\x0c and 日本語 words joined \U0001d11e", "en", "c", 1),
    (9, "word", "en", "a", 4),
    (-5, "a negative id", "en", "a", 4),
]


def identity(value):
    """NaN, as pandas writes null ids, as None."""
    return None if value != value else int(value)
