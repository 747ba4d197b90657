"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

The chance that one document is preferred to another is the logistic function of the
difference of their scores, and scores are linear in signs of the whole text. Weights are
fitted to pairs of a liked and a disliked document by the logistic loss on the differences
of their signs; the cut between liked and disliked is a quantile of the scores of all
labelled rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabmeter.llm.common import Staged, drawn, rows_of
from tabmeter.llm.linecrf import SYMBOLS

FEATURES = (
    "symbols", "capitals", "stutter", "bare", "marked", "sentences", "short_words", "word_length",
    "repeated_lines", "top_word", "sameness", "digits", "few_words", "empty",
)
PER_CLASS = 2000  # bound of the labelled rows of each kind that pairs are drawn from
PAIRS = 20_000
RIDGE, NEWTON = 1e-3, 25
GRID = 1000  # quantiles of the scores that the cut is chosen from
LIKED = 0.3  # score from which a document is predicted to be liked
FOLDS, HELD = 5, 0


def signs(text: str | None) -> list[float]:
    """Signs of a whole text, in the order of FEATURES, each between 0 and 1."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 2) + [1.0, 1.0]
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    return [
        min(1.0, 10.0 * sum(map(text.count, SYMBOLS)) / len(text)),
        sum(c for w, c in counts.items() if len(w) > 2 and w.isupper()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        sum(c for w, c in counts.items() if len(w) <= 2 and not w.isalnum() and w[0] < 128) / n,
        sum(c for w, c in counts.items() if w[-1:] in b"!#*$%&|<>") / n,
        min(1.0, 4.0 * sum(c for w, c in counts.items() if w[-1:] in b".?") / n),
        sum(c for w, c in counts.items() if len(w) <= 3) / n,
        min(1.0, sum(len(w) * c for w, c in counts.items()) / n / 20.0),
        1.0 - len(set(lines)) / max(1, len(lines)),
        max(counts.values()) / n,
        1.0 - min(1.0, 2.0 * len(counts) / n),
        min(1.0, 5.0 * sum(map(text.count, "0123456789")) / len(text)),
        max(0.0, 1.0 - n / 20.0),
        0.0,
    ]


def sign_table(docs: DataFrame) -> DataFrame:
    """(doc_id, signs) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signs(text) for (text,) in rows_of(batch, "text")]
            arrays = [batch.column("doc_id"), pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "signs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, signs array<double>")


@dataclass
class Preference:
    """Weights of the signs, and the score that divides liked from disliked."""

    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    cut: float = -1.0

    def raw(self, column: str = "signs") -> Column:
        terms = [F.col(column)[i] * F.lit(w) for i, w in enumerate(self.weights)]
        return sum(terms[1:], terms[0])

    def score(self, column: str = "signs") -> Column:
        """Chance of being liked: 0.3 at the cut, so that no rounding moves a row over it."""
        away = F.least(F.greatest(self.raw(column) - F.lit(self.cut), F.lit(-30.0)), F.lit(30.0))
        low, high = F.lit(LIKED) * F.exp(away), 1 - F.lit(1 - LIKED) * F.exp(-away)
        return F.when(away < 0, low).otherwise(high)


def fit_weights(liked: np.ndarray, disliked: np.ndarray) -> np.ndarray:
    """Newton's method on the logistic loss of sign differences of preference pairs."""
    size = liked.shape[1]
    i = np.arange(PAIRS)
    # every row takes part in pairs with many rows of the other kind
    pairs = liked[i % len(liked)] - disliked[(i * 7919 + i // len(liked)) % len(disliked)]
    weights = np.zeros(size)
    for _ in range(NEWTON):
        chance = 1.0 / (1.0 + np.exp(-np.clip(pairs @ weights, -30, 30)))
        gradient = pairs.T @ (1.0 - chance) / len(pairs) - RIDGE * weights
        curve = (pairs * (chance * (1.0 - chance))[:, None]).T @ pairs / len(pairs) + RIDGE * np.eye(size)
        weights += np.linalg.solve(curve, gradient)
    return weights


def best_cut(liked: np.ndarray, disliked: np.ndarray) -> float:
    """The quantile that tells the two kinds apart best, from evenly spaced quantiles of both;
    of equally good ones the middle of the first run."""
    grid = np.unique(np.concatenate([liked, disliked]))
    lost = np.searchsorted(liked, grid, "left") / len(liked)
    passed = 1.0 - np.searchsorted(disliked, grid, "left") / len(disliked)
    error = lost + passed
    best = np.flatnonzero(error <= error.min() + 1e-12)
    at = best[0]
    # between the last disliked score below and the first liked one from the cut on
    below = grid[at - 1] if at > 0 else grid[at] - 1.0
    return float((below + grid[at]) / 2)


def fold(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def train(table: DataFrame, labels: DataFrame) -> Preference:
    """The ranking of labelled rows outside the held-out fold.

    Pairs come from about PER_CLASS rows of each kind, by a hash of their ids, twice as many
    at most; the cut from quantiles over all labelled rows. Rows of `labels` without an id or a quality
    count for nothing; of several for one document the worst counts."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("liked"))
    known = table.where(fold() != HELD).join(marks, "doc_id").select("doc_id", "signs", (F.col("liked") >= 1).alias("liked"))
    sizes = {row["liked"]: row["count"] for row in known.groupBy("liked").count().collect()}
    kinds = []
    for kind in (True, False):
        share = min(1.0, PER_CLASS / max(1, sizes.get(kind, 0)))
        some = known.where((F.col("liked") == kind) & drawn(share, "doc_id")).select("doc_id", "signs").limit(2 * PER_CLASS)
        rows = sorted((row["doc_id"], row["signs"]) for row in some.collect())
        kinds.append(np.array([own for _, own in rows], float).reshape(-1, len(FEATURES)))
    if not len(kinds[0]) or not len(kinds[1]):
        return Preference()
    weights = fit_weights(*kinds)
    found = Preference(weights.tolist())
    steps = [float(x) for x in np.linspace(0, 1, GRID + 1)]
    quantiles = {
        row["liked"]: np.array(row["q"])
        for row in known.groupBy("liked").agg(F.percentile_approx(found.raw(), steps, 10 * GRID).alias("q")).collect()
    }
    found.cut = best_cut(quantiles[True], quantiles[False])
    return found


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs` (doc_id, text), ranked by
    `labels` (doc_id, quality).

    Null and empty texts have a score like any other; a null doc_id is not held out; rows
    are scored each by its own text. Without labels of both kinds every score is above the
    cut. An empty table gives an empty result; only the named columns are read.
    """
    table = Staged(docs.sparkSession).write(sign_table(docs), "signs")
    found = train(table, labels)
    held = F.coalesce(fold() == HELD, F.lit(False)).alias("held_out")
    scored = table.select("doc_id", held, found.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= LIKED).cast("int"))


def keep_liked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that `quality_scores` predicts to be liked, with all their columns."""
    table = Staged(docs.sparkSession).write(sign_table(docs), "signs")
    found, columns = train(table, labels), docs.columns
    weights = np.array(found.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [float(np.dot(signs(text), weights)) >= found.cut for (text,) in rows_of(batch, "text")]
            yield batch.select(columns).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
