"""Licence scan with a positional index of rare words, in DataFrame operations only.

The index has a posting for each template: the rarest word of its key phrase and the place
that word has in the template. As a template counts only where its whole key phrase stands,
each of its places in a text has that word. The text's words are looked up in the postings;
the place of a word in the text less its place in the template says where the template
would begin. There the key phrase must stand word by word, and the words that stand in place
must carry most of the template's weight, each weighing its inverse document frequency.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Label, wording, and the phrase of it that must stand in place.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version", "apache license"),
    ("apache", "software distributed under the license is distributed on an as is basis without warranties or conditions", "without warranties or conditions"),
    ("gpl", "licensed under the gnu general public license version", "general public license"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published", "general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc", "licensed under cc by nc", "cc by nc"),
    ("cc", "licensed under a creative commons attribution international license", "creative commons attribution"),
    ("reserved", "all rights reserved", "all rights reserved"),
)
#: Phrases whose every place counts.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: A word is a run of letters, digits and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SMALL, LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHARE = 0.6  # of a template's weight that must stand in place


@dataclass(frozen=True)
class Template:
    """A wording, and where the key phrase is in it; all of a base phrase is key."""

    label: str
    words: tuple[str, ...]
    key: range
    base: bool

    def opener(self, weight: dict[str, float]) -> int:
        """The place of the rarest word of the key phrase, the first of equals."""
        return max(self.key, key=lambda i: (weight[self.words[i]], -i))


def templates() -> list[Template]:
    found = []
    for label, text, phrase, base in [(*t, False) for t in TEMPLATES] + [(*t, t[1], True) for t in BASE]:
        words, key = tuple(text.split()), tuple(phrase.split())
        start = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        found.append(Template(label, words, range(start, start + len(key)), base))
    return found


def vocabulary() -> list[str]:
    return sorted({word for t in templates() for word in t.words})


def words_column() -> Column:
    """The words of `text`, A-Z in small letters."""
    return F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), LARGE, SMALL), F.lit(WORD), F.lit(0))


def rarity(docs: DataFrame) -> dict[str, float]:
    """The inverse document frequency of the templates' words in `docs`."""
    known = F.array_intersect(words_column(), F.array(*map(F.lit, vocabulary())))
    # the empty word stands for the rows themselves
    held = docs.select(F.explode(F.concat(F.array(F.lit("")), known)).alias("word")).groupBy("word").count()
    spread = {row["word"]: row["count"] for row in held.collect()}  # the templates' words at most
    return {word: math.log(1.0 + spread.get("", 0) / (1.0 + spread.get(word, 0))) for word in vocabulary()}


def places(template: Template, weight: dict[str, float]) -> Column:
    """(label, base, start, share) of every place where the template stands, an array."""
    opener = template.opener(weight)
    total = sum(weight[word] for word in template.words)

    def stands(at: Column, i: int) -> Column:
        # a negative place is no place, so nothing stands before a text
        return F.coalesce(F.get("words", at - F.lit(opener - i)) == template.words[i], F.lit(False))

    def share(at: Column) -> Column:
        if template.base:
            return F.lit(1.0)
        parts = [F.when(stands(at, i), weight[word]).otherwise(0.0) for i, word in enumerate(template.words)]
        return F.least(reduce(operator.add, parts) / F.lit(total or 1.0), F.lit(1.0))

    here = F.filter("hits", lambda at: reduce(operator.and_, [stands(at, i) for i in template.key]))
    found = F.transform(
        here,
        lambda at: F.struct(
            F.lit(template.label).alias("label"),
            F.lit(template.base).alias("base"),
            (at - F.lit(opener)).cast("bigint").alias("start"),
            share(at).alias("share"),
        ),
    )
    return F.filter(found, lambda x: x["share"] >= SHARE)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every
    row of `docs` (doc_id, text).

    n_base counts the places of base phrases, first_word and last_word are the first and last
    of them in words from 0 (null without any). `labels` has those of the base phrases and of
    all templates found; `score` is the largest share of a found template's weight that
    stands in place, 1 for a base phrase, 0 for nothing. Null and empty texts have no words
    and empty labels. Rows are scanned each by its own text, whatever its doc_id, null or
    repeated. An empty table gives an empty result; other columns are not read.
    """
    weight = rarity(docs)
    openers = sorted({t.words[t.opener(weight)] for t in templates()})
    looked_up = F.transform("words", lambda word, at: F.when(word.isin(openers), at))
    found = F.concat(*[places(t, weight) for t in templates()])
    rows = (
        docs.select("doc_id", words_column().alias("words"))
        .select("doc_id", "words", F.array_compact(looked_up).alias("hits"))
        .select("doc_id", F.size("words").cast("bigint").alias("n_words"), found.alias("found"))
        .select("doc_id", "n_words", "found", F.filter("found", lambda x: x["base"]).alias("base"))
    )

    def listed(name: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(f"{name}.label")), ",")

    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        listed("base").alias("base_labels"),
        listed("found").alias("labels"),
        F.coalesce(F.array_max("found.share"), F.lit(0.0)).alias("score"),
    )
