"""The pipeline against its stages worked out one by one in plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabmeter.llm import linecrf, preference, queries, simhash
from llm_cases import SCHEMA, prose


def cut_repeats(texts: dict[int, str], length: int = 100) -> dict[int, str]:
    first, out = {}, {}
    for doc in sorted(texts):
        data = texts[doc].encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            place = first.setdefault(hashlib.md5(data[at : at + length]).digest(), (doc, at))
            if place != (doc, at):
                gone[at : at + length] = True
        out[doc] = np.frombuffer(data, np.uint8)[~gone].tobytes().decode(errors="ignore")
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Prose, junk, copies, near copies and a passage that many documents share."""
    rows, labels = [], []
    passage = prose(5, 40)
    for i in range(90):
        text = "\n".join(prose(400 + 3 * i + j, 30) for j in range(3))
        if i % 10 == 3:
            text = " ".join(w + "$$$" for w in text.split())
        if i % 5 == 1:
            text += "\n" + passage
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 0 if i % 10 == 3 else 1, 0))
    rows += [(200, rows[4][1], "en", "s1", 1), (201, rows[5][1], "en", None, 1), (202, None, None, None, None)]
    rows += [(203, "too short", "en", "s1", 9), (204, rows[8][1] + " end", "en", "s1", 1)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "quality_classifier", "near_duplicates", "repeated_passages", "packed_sequences"
    ]
    assert queries.QUERIES["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None


def test_run_is_the_stages_worked_out_by_hand(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    field = linecrf.train(docs)
    texts = {i: t for i, t in texts.items() if linecrf.judged(t, field)[-1]}
    assert not {3, 13, 202, 203} & texts.keys() and len(texts) > 70

    kept = docs.where(F.col("doc_id").isin(list(texts)))
    model = preference.train(preference.sign_table(kept), spark.read.parquet(f"{corpus}/labels.parquet"))
    texts = {i: t for i, t in texts.items() if np.dot(preference.signs(t), model.weights) >= model.cut}
    assert len(texts) > 70

    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    texts = {i: t for i, t in texts.items() if not any(j < i and (prints[i] ^ prints[j]).bit_count() <= 2 for j in prints)}
    assert not {200, 201} & texts.keys() and {4, 5} <= texts.keys()

    texts = cut_repeats(texts)
    from tokenizers import Tokenizer
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}

    found = corpus_pipeline.run(spark, corpus).collect()
    got = {i: b"".join(bytes(p["ids"]) for p in sorted((p for p in found if p["doc_id"] == i), key=lambda p: p["start"])) for i in ids}
    assert {p["doc_id"] for p in found} == ids.keys()
    assert got == {i: np.array(x, "<u4").tobytes() for i, x in ids.items()}
    line = sorted((p["sequence_id"] * 2048 + p["offset"], p["length"]) for p in found)
    assert [at for at, _ in line] == [0, *np.cumsum([n for _, n in line])[:-1]]


def test_every_stage_takes_odd_and_empty_documents(spark, odd_docs, no_docs, corpus):
    for given in (odd_docs, no_docs):
        docs = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, given, corpus)
            assert docs.columns == given.columns and docs.schema.simpleString() == given.schema.simpleString()
            assert docs.count() <= given.count()
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, corpus)
        assert pieces.select("doc_id").distinct().count() <= docs.count()
