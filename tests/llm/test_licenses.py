import random
import re
from collections import Counter

from tabmeter.llm import licenses
from llm_cases import SCHEMA, prose


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for label, phrase in licenses.BASE:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    "Released under the MIT License. mit-license, MIT\nLICENSE and the Apache License",
    "GNU General Public.License general public license, general licence public license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Permission is hereby granted, free of cost, to any person obtaining a copy of this software",
    "Licensed under CC BY-NC 4.0. All rights reserved.",
    "all rights not reserved; rights reserved all",
    "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "the mit of licenses, apache licenses, publicly licensed é mİt license mit\xa0license",
    "mit license " * 400,
]


def test_base_counts_on_odd_rows(spark, odd_docs):
    extra = spark.createDataFrame([(500 + i, t, "en", "a", None) for i, t in enumerate(TEXTS)], SCHEMA)
    docs = odd_docs.unionByName(extra, allowMissingColumns=True)
    found = licenses.scan_licenses(docs).collect()
    assert Counter(tuple(r)[:6] for r in found) == Counter((r["doc_id"], *brute(r["text"])) for r in docs.collect())
    labels = {r["doc_id"]: r["labels"] for r in found}
    assert [labels[500 + i] for i in range(9)] == ["apache,mit", "gpl", "mit", "", "cc,reserved", "", "bsd", "", "mit"]
    for row in found:
        assert set(filter(None, row["base_labels"].split(","))) <= set(filter(None, row["labels"].split(",")))
        assert (row["score"] > 0) == bool(row["labels"]) and 0.0 <= row["score"] <= 1.0


def test_key_words_must_stand_in_place(spark):
    near = "Licensed under the Apache Group License, version 2"
    rows = [(1, near, "en", "a", None), (2, prose(1, 30) + " " + near.replace("Group ", ""), "en", "a", None)]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1]["labels"] == "" and found[2]["labels"] == "apache" and found[2]["first_word"] == 33


def test_the_rarest_key_word_opens(spark):
    weight = {word: 1.0 for word in licenses.vocabulary()} | {"license": 0.1, "public": 3.0, "software": 9.0}
    opened = {t.words[t.opener(weight)] for t in licenses.templates()}
    assert {"mit", "apache", "public"} <= opened and not {"license", "software"} & opened
    rows = [(i, "a license" + " mit" * (i == 0), "en", "a", None) for i in range(9)]
    found = licenses.rarity(spark.createDataFrame(rows, SCHEMA))
    assert found["mit"] > found["license"] and found["apache"] > found["mit"]


def stands(text):
    """The labels found by trying every template at every place."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = set()
    for t in licenses.templates():
        for start in range(-len(t.words), len(words)):
            here = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t.words)]
            if all(here[i] for i in t.key) and sum(here) >= 0.6 * len(here):
                found.add(t.label)
    return ",".join(sorted(found))


def test_labels_match_brute_force(spark, monkeypatch):
    """With all words equally rare, over wordings with words left out, changed and joined."""
    monkeypatch.setattr(licenses, "rarity", lambda docs: {word: 1.0 for word in licenses.vocabulary()})
    draw, rows = random.Random(3), []
    for i in range(400):
        words = draw.choice(licenses.TEMPLATES)[1].split() + draw.choice(licenses.TEMPLATES)[1].split()
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(len(words))] = draw.choice(["of", "not", "license", "public", "MIT"])
        at = draw.randrange(4)
        rows.append((i, " ".join(words[at : len(words) - draw.randrange(6)]), "en", "a", None))
    found = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: stands(text) for i, text, *_ in rows}
    assert len(set(found.values())) > 10


def test_every_word_of_a_key_phrase_is_compared(spark):
    texts = [
        "licensed for cc or nc",
        "licensed via cc not nc",
        "permission was hereby granted free from charge to any person obtaining a copy of this software",
        "licensed under cc by nc",
    ]
    rows = [(i, t, "en", "a", None) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {0: "", 1: "", 2: "", 3: "cc"}


def test_no_python_in_the_plan(odd_docs, no_docs):
    plan = licenses.scan_licenses(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert licenses.scan_licenses(no_docs).collect() == []


def test_one_file_with_all_templates(spark):
    text = f" {prose(3, 20)} ".join(wording for _, wording, _ in licenses.TEMPLATES)
    rows = [(1, text, "en", "a", None), (2, prose(4, 50), "en", "a", None)]
    rows += [(10 + i, wording, "en", "a", None) for i, (_, wording, _) in enumerate(licenses.TEMPLATES)]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1]["labels"] == ",".join(sorted({label for label, *_ in licenses.TEMPLATES}))
    assert found[2]["labels"] == ""
    for i, (label, *_) in enumerate(licenses.TEMPLATES):
        assert label in found[10 + i]["labels"].split(",")
