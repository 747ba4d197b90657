import zlib

import numpy as np

from tabmeter.llm import preference
from llm_cases import SCHEMA, prose


def corpus(spark, n=300):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(i, 30 + i % 40)
        rows.append((i, " ".join(w + "&&&" for w in text.split()) if bad else text, "en", "a", None))
        labels.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus(spark)
    found = {r["doc_id"]: r for r in preference.quality_scores(docs, labels).collect()}
    for i, row in found.items():
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert row["predicted"] == int(row["score"] >= 0.3) == int(i % 4 != 0)
    kept = preference.keep_liked(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in found if i % 4}


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(spark)
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 1 - quality, quality) AS quality")
    one, two = (sorted(preference.quality_scores(docs, x).collect()) for x in (labels, turned))
    assert one == two


def test_odd_rows_and_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(12)] + [(None, 1), (100, None), (101, 0)], "doc_id bigint, quality int")
    found = preference.quality_scores(odd_docs, labels).collect()
    assert len(found) == odd_docs.count()
    assert all(0.0 <= r["score"] <= 1.0 and r["held_out"] is not None for r in found)
    assert preference.quality_scores(no_docs, labels).collect() == []
    for none in (labels.limit(0), labels.where("quality = 1")):
        assert {r["predicted"] for r in preference.quality_scores(odd_docs, none).collect()} == {1}
        assert preference.keep_liked(odd_docs, none).count() == odd_docs.count()


def test_weights_lower_the_pairwise_loss_to_its_minimum():
    draw = np.random.default_rng(1)
    liked, disliked = draw.normal(0.3, 1, (200, 14)), draw.normal(0, 1, (150, 14))
    weights = preference.fit_weights(liked, disliked)
    i = np.arange(preference.PAIRS)
    pairs = liked[i % 200] - disliked[(i * 7919 + i // 200) % 150]

    def loss(w):
        return np.log1p(np.exp(-pairs @ w)).mean() + preference.RIDGE / 2 * w @ w

    for k in range(14):
        for step in (-1e-3, 1e-3):
            assert loss(weights + step * np.eye(14)[k]) >= loss(weights)


def test_cut_is_between_the_kinds():
    assert 1.0 < preference.best_cut(np.array([2.0, 3.0, 4.0]), np.array([0.0, 1.0])) < 2.0
    cut = preference.best_cut(np.array([1.0, 3.0, 4.0]), np.array([0.0, 2.0]))
    assert cut in (0.5, 2.5)
