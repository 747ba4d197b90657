"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate.

The field is trained on a bounded sample of documents whose lines are marked by plain signs
(symbols, capitals, repeated words or lines, lists without sentences). It weighs the signs
and learns how lines of a kind follow each other, so a line without a sign between marked
ones, or with one between clean ones, is judged by its neighbours too. Viterbi's algorithm
then finds the likeliest marks of all lines of every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabmeter.llm.common import drawn, rows_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
SPAN = 8  # words in a window for repeats
MIN_WORDS, MAX_REPEATED = 20, 30  # base rule: words at least, per cent of repeated words at most
CONTENT_SHARE = 0.5  # of the words, in content lines, for a document to stay
SAMPLE_DOCS, STRETCH = 1000, 32  # bound of the training sample: documents, lines of one in a row
STEPS, RATE, RIDGE = 150, 0.1, 1e-3

FEATURES = ("bias", "symbols", "capitals", "sameness", "repeat", "short", "open", "bare", "marked", "digits")
Line = tuple[float, ...]


def line_features(line: str, words: list[bytes], again: bool) -> Line:
    """Signs of one line with words, each between 0 and 1."""
    n, chars = len(words), len(line)
    plain = line.rstrip(BLANKS)
    marks = sum(map(line.count, SYMBOLS))
    loud = sum(w.isupper() and len(w) > 2 for w in words)
    return (
        1.0,
        min(1.0, 5.0 * marks / chars),
        loud / n,
        1.0 - len(set(words)) / n if n >= 5 else 0.0,
        float(again),
        float(n < 4),
        float(plain[-1:] not in (".", "!", "?", ":", '"')),
        sum(not (w.isalnum() or len(w) > 2 or w[0] > 127) for w in words) / n,
        sum(w[-1:] in b"!#*$%&|<>" for w in words) / n,
        min(1.0, 3.0 * sum(map(line.count, "0123456789")) / chars),
    )


def weak_label(f: Line) -> int:
    """1 (boilerplate) if a plain sign is strong."""
    return int(f[1] >= 0.25 or f[2] >= 0.6 or f[3] >= 0.5 or f[4] == 1.0 or f[7] >= 0.3 or f[8] >= 0.5)


def measured(text: str | None) -> tuple[tuple[int, int, int, int, int], list[Line], list[int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), and the features and word
    counts of the lines with words."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    lines, sizes, seen, dups = [], [], set(), 0
    for line in text.split("\n"):
        if own := line.encode().split():
            again = line in seen
            seen.add(line)
            dups += again
            lines.append(line_features(line, own, again))
            sizes.append(len(own))
    repeated = 0
    if n > SPAN:
        hashes = np.fromiter(map(hash, words), np.int64, n)
        windows = np.zeros(n - SPAN + 1, np.int64)
        for i in range(SPAN):
            windows = windows * np.int64(0x5851F42D4C957F2D) + hashes[i : n - SPAN + 1 + i]
        order = np.argsort(windows)
        same = np.diff(windows[order]) == 0
        twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        edge = np.zeros(n + 1, np.int64)
        edge[twice] += 1
        edge[twice + SPAN] -= 1
        repeated = int((np.cumsum(edge[:-1]) > 0).sum())
    chars = len(text) - sum(map(text.count, BLANKS))
    return (n, chars, sum(map(text.count, SYMBOLS)), dups, repeated), lines, sizes


class LineField:
    """Weights of the two labels' features, and of each label after each other."""

    def __init__(self, weights: np.ndarray, follow: np.ndarray) -> None:
        self.weights, self.follow = weights, follow

    def mark(self, lines: list[Line]) -> list[int]:
        """The likeliest labels of a document's lines (Viterbi); ties go to content."""
        if not lines:
            return []
        scores = (np.array(lines) @ self.weights).tolist()
        stay = self.follow.tolist()
        (a, b), back = scores[0], []
        for x, y in scores[1:]:
            from_a = a + stay[0][0] >= b + stay[1][0], a + stay[0][1] >= b + stay[1][1]
            a, b = max(a + stay[0][0], b + stay[1][0]) + x, max(a + stay[0][1], b + stay[1][1]) + y
            back.append(from_a)
        label = int(b > a)
        out = [label]
        for from_a in reversed(back):
            label = 0 if from_a[label] else 1
            out.append(label)
        return out[::-1]

    @classmethod
    def fit(cls, sequences: list[list[Line]], labels: list[list[int]]) -> LineField:
        """Most likely weights of labelled sequences, by gradient steps on the exact likelihood."""
        size = len(FEATURES)
        weights, follow = np.zeros((size, 2)), np.zeros((2, 2))
        if not sequences:
            return cls(weights, follow)
        count, longest = len(sequences), max(map(len, sequences))
        x, y = np.zeros((count, longest, size)), np.zeros((count, longest), int)
        mask = np.zeros((count, longest))
        for i, (seq, own) in enumerate(zip(sequences, labels, strict=True)):
            x[i, : len(seq)], y[i, : len(seq)], mask[i, : len(seq)] = seq, own, 1.0
        hot = np.eye(2)[y] * mask[:, :, None]
        pairs = mask[:, 1:]
        seen_follow = np.einsum("nta,ntb->ab", hot[:, :-1] * pairs[:, :, None], hot[:, 1:])
        seen_weights = np.einsum("ntf,nta->fa", x, hot)
        total = mask.sum()
        first = [np.zeros_like(weights), np.zeros_like(follow)]
        second = [np.zeros_like(weights), np.zeros_like(follow)]
        for step in range(1, STEPS + 1):
            node = x @ weights
            ahead = np.zeros((count, longest, 2))
            ahead[:, 0] = node[:, 0]
            for t in range(1, longest):
                new = np.logaddexp.reduce(ahead[:, t - 1, :, None] + follow, axis=1) + node[:, t]
                ahead[:, t] = np.where(mask[:, t, None] > 0, new, ahead[:, t - 1])
            whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
            behind = np.zeros((count, longest, 2))
            want_follow = np.zeros((2, 2))
            for t in range(longest - 2, -1, -1):
                on = mask[:, t + 1, None] > 0
                ahead_of = (node[:, t + 1] + behind[:, t + 1])[:, None, :] + follow
                both = np.exp(ahead[:, t, :, None] + ahead_of - whole[:, None, None]) * pairs[:, t, None, None]
                want_follow += both.sum(axis=0)
                behind[:, t] = np.where(on, np.logaddexp.reduce(ahead_of, axis=2), 0.0)
            marginal = np.exp(ahead + behind - whole[:, None, None]) * mask[:, :, None]
            for k, (value, seen, want) in enumerate(
                (
                    (weights, seen_weights, np.einsum("ntf,nta->fa", x, marginal)),
                    (follow, seen_follow, want_follow),
                )
            ):
                gradient = (seen - want) / total - RIDGE * value
                first[k] = 0.9 * first[k] + 0.1 * gradient
                second[k] = 0.999 * second[k] + 0.001 * gradient**2
                value += RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return cls(weights, follow)


def stretch(text: str | None, lines: list[Line], size: int) -> list[Line]:
    """The lines that a document teaches: it is cut into equal stretches of at most `size`
    lines, and a hash of its text draws one, so every line is as likely as any other."""
    parts = -(-len(lines) // size)
    if parts < 2:
        return lines
    turn = zlib.crc32((text or "").encode()) % parts
    return lines[turn * len(lines) // parts : (turn + 1) * len(lines) // parts]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, size: int = STRETCH) -> LineField:
    """The field of a sample of `docs`: about `sample_docs` rows by a hash, twice as many at
    most, and a stretch of up to `size` lines of each, drawn from the whole text. Only the
    lines' features reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stretch(text, measured(text)[1], size) for (text,) in rows_of(batch, "text")]
            kind = pa.list_(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([[list(f) for f in x] for x in found], kind)], ["lines"])

    share = min(1.0, sample_docs / max(1, docs.count()))
    picked = docs.select("doc_id", "text").where(drawn(share, "doc_id", "text"))
    rows = picked.mapInArrow(run, "lines array<array<double>>").limit(2 * sample_docs).collect()
    sequences = sorted([tuple(map(tuple, row["lines"])) for row in rows if row["lines"]])
    chosen = [list(s) for s in sequences]
    return LineField.fit(chosen, [[weak_label(f) for f in s] for s in chosen])


def judged(text: str | None, field: LineField) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept)."""
    base, lines, sizes = measured(text)
    n, repeated = base[0], base[4]
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    content = sum(size for size, label in zip(sizes, field.mark(lines), strict=True) if label == 0)
    share = content / n if n else 0.0
    return (*base, failed, share, not failed and share >= CONTENT_SHARE)


def quality_rules(docs: DataFrame, field: LineField | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    content_share, kept) of every row of `docs` (doc_id, text).

    A row stays unless it fails the base rule or fewer than half of its words stand in lines
    marked as content. Null and empty texts have no words and fail; rows are judged each by
    its own text, whatever its doc_id, null or repeated; an empty table gives an empty
    result; other columns are not read. Without training rows all lines are content.
    """
    field = field or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        for batch in batches:
            rows = [judged(text, field) for (text,) in rows_of(batch, "text")]
            if rows:
                arrays = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], NAMES)

    return docs.select("doc_id", "text").mapInArrow(
        run,
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, content_share double, kept boolean",
    )


NAMES = [
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"
]


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that `quality_rules` keeps, with all their columns.

    Each row is judged by its own text: null and empty texts go, repeated rows and rows of
    one doc_id stay or go each, a doc_id may be null, and a share of exactly half stays. An
    empty table stays empty; further columns pass whatever their names."""
    field, columns = train(docs), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [judged(text, field)[-1] for (text,) in rows_of(batch, "text")]
            yield batch.select(columns).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
