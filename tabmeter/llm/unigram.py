"""Language identification by unigrams summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The chance of
a word is the sum, over all ways to cut it into pieces, of the product of their chances; a
forward pass over the word computes it, and a text's chance is the product over its words.
The probabilities are fitted by expectation and maximisation: the expected uses of every
piece come from the forward sums of the training words and a walk back, computed where the
words are, and only sums for each piece are gathered.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

from tabmeter.llm.common import Staged, drawn, rows_of

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"  # begins a word
SAMPLE_DOCS = 400  # training documents of each language, about
ROUNDS = 3
FLOOR = 0.05  # expected uses added to every piece of every language
STEPS = 32  # letters after which the sums of a word are brought back into range
HELD = 1 << 23  # letters of the words whose chances a task remembers
BLOCK = 1 << 22  # bytes of text handled together
BULK = 1 << 18  # letters of the words summed at a time, about
LETTERS = 140_000.0  # letters there are, any of which the piece for unknown ones may be
#: Nats that are taken out of each letter's cost, to keep products in range: of letters that
#: are pieces, and of others.
SCALE, FAR = 2.5, 18.0
BASE = np.uint64(0x9E3779B97F4A7C15)
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

# \w takes fractions, superscripts and number forms for letters; Unicode's categories L do not.
NUMBERS = "".join(c for c in map(chr, range(0x20000)) if c.isnumeric() and unicodedata.category(c)[0] != "L")
LETTER = re.compile(rf"[^\W\d_{re.escape(NUMBERS)}]")
_RUNS, _LETTERS = re.compile(r"[^\W\d_]+").findall, re.compile(f"{LETTER.pattern}+").findall


def letter_runs(text: str) -> list[str]:
    """The runs of letters of a text. Only runs with number forms take the slow pattern."""
    runs = _RUNS(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [word for run in runs for word in ([run] if run.isalpha() else _LETTERS(run))]


@cache
def pieces(path: str) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """The vocabulary's pieces of letters, and by length the hashes of their beginnings with
    the piece that ends there or -1. The last piece stands for any letter."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    own = sorted({t.lower() for t in texts if t.strip(MARK) and LETTER.search(t) and not t.startswith("<")} | {MARK})
    number = {t: i for i, t in enumerate(own)}
    table: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
    for n in range(1, max(map(len, own)) + 1):
        heads = sorted({t[:n] for t in own if len(t) >= n})
        keys = np.zeros(len(heads), np.uint64)
        for column in np.array([[ord(c) for c in t] for t in heads], np.uint64).T:
            keys = keys * BASE + column + np.uint64(1)
        order = np.argsort(keys)
        table.append((keys[order], np.array([number.get(t, -1) for t in heads], np.int64)[order]))
    return own, table


def spread_unknown(chances: np.ndarray) -> np.ndarray:
    """The chances, with that of an unknown letter dealt out among all letters."""
    return np.concatenate([chances[:-1], chances[-1:] / LETTERS])


class Lattice:
    """All pieces that fit into the words, by where they end."""

    def __init__(self, words: list[str], path: str) -> None:
        own, table = pieces(path)
        marked = [MARK + w for w in words]
        self.sizes = np.array([len(w) for w in marked], np.int64)
        flat = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.first = np.cumsum(self.sizes) - self.sizes
        inside = np.arange(len(flat)) - np.repeat(self.first, self.sizes)
        room = np.repeat(self.sizes, self.sizes) - inside
        live, hashed = np.arange(len(flat)), np.zeros(len(flat), np.uint64)
        found = [(live, np.ones(len(flat), np.int64), np.full(len(flat), len(own)))]  # any letter
        for n in range(1, len(table)):
            hashed = hashed * BASE + flat[live + n - 1]
            keys, ids = table[n]
            place = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            piece = np.where(keys[place] == hashed, ids[place], -2)
            hit = piece >= 0
            found.append((live[hit], np.full(int(hit.sum()), n), piece[hit]))
            on = (piece > -2) & (room[live] > n)
            live, hashed = live[on], hashed[on]
            if n == 1:
                strange = np.ones(len(flat), bool)
                strange[found[-1][0]] = False
            if not len(live):
                break
        start, size, piece = map(np.concatenate, zip(*found, strict=True))
        stop = inside[start] + size
        # a word of n letters has n + 1 nodes, so nodes are numbered apart from letters
        shift = np.repeat(np.arange(len(words)), self.sizes)
        node = start + shift[start]
        order = np.lexsort([node + size, stop])
        self.node, self.end, self.size, self.piece = (x[order] for x in (node, node + size, size, piece))
        self.cuts = np.searchsorted(stop[order], np.arange(int(self.sizes.max(initial=0)) + 2))
        self.begin = self.first + np.arange(len(words))
        self.finish = self.begin + self.sizes
        self.nodes = len(flat) + len(words)
        self.reach = int(self.size.max(initial=1))
        spread = np.concatenate([[0.0], np.cumsum(np.where(strange, FAR, SCALE))])
        self.spread = spread[self.first + self.sizes] - spread[self.first]
        letter = self.node - shift[start[order]]
        self.gain = np.exp(spread[letter + self.size] - spread[letter])[:, None]

    def forward(self, chances: np.ndarray, keep: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each word and language the summed chance of all ways through it, and the log of
        what was divided out of it. `keep` receives, place by place, the share of each piece
        in the sum at its end.

        Sums of long words leave the range of doubles. Every STEPS letters the last sums of a
        word, as far back as a piece reaches, are divided by their largest."""
        chances = spread_unknown(chances)
        sums = np.zeros((self.nodes, chances.shape[1]))
        logs = np.zeros((len(self.sizes), chances.shape[1]))
        sums[self.begin] = 1.0
        for t in range(1, len(self.cuts) - 1):
            a, b = self.cuts[t], self.cuts[t + 1]
            part = sums[self.node[a:b]] * chances[self.piece[a:b]] * self.gain[a:b]
            end = self.end[a:b]
            heads = np.flatnonzero(np.diff(end, prepend=-1))
            sums[end[heads]] = np.add.reduceat(part, heads, axis=0)
            if keep is not None:
                keep.append(part / np.maximum(sums[end], 1e-300))
            if t % STEPS == 0 and len(on := np.flatnonzero(self.sizes > t)):
                back = self.begin[on, None] + np.arange(max(0, t - self.reach), t + 1)
                peak = np.maximum(sums[back].max(axis=1), 1e-300)
                sums[back] /= peak[:, None]
                logs[on] += np.log(peak)
        return sums[self.finish], logs

    def log_chances(self, chances: np.ndarray) -> np.ndarray:
        whole, logs = self.forward(chances)
        return np.log(np.maximum(whole, 1e-300)) + logs - self.spread[:, None]

    def uses(self, chances: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of every piece in each language, each word counted `weight` times.

        From the end of a word backwards, the expected visits of a place are dealt out to the
        pieces that end there by their shares in its sum, and so reach where they begin."""
        shares: list[np.ndarray] = []
        self.forward(chances, shares)
        out, visits = np.zeros_like(chances), np.zeros((self.nodes, chances.shape[1]))
        visits[self.finish] = weight
        for t in range(len(self.cuts) - 2, 0, -1):
            a, b = self.cuts[t], self.cuts[t + 1]
            dealt = visits[self.end[a:b]] * shares.pop()
            np.add.at(out, self.piece[a:b], dealt)
            np.add.at(visits, self.node[a:b], dealt)
        return out


def words_of(text: str | None) -> list[str]:
    """Runs of letters in small letters."""
    return letter_runs(text.lower()) if text else []


def bulks(words: list[str]) -> Iterator[slice]:
    """Stretches of words that are summed together: about BULK letters, one word at least."""
    sizes = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    borders = [0, *(np.flatnonzero(np.diff(sizes // BULK)) + 1).tolist(), len(words)]
    return (slice(a, b) for a, b in zip(borders, borders[1:], strict=False) if a < b)


class Languages:
    """Chances of the pieces by language."""

    def __init__(self, names: list[str], chances: np.ndarray, path: str) -> None:
        self.names, self.chances, self.path = names, chances, path

    def log_chances(self, words: list[str]) -> np.ndarray:
        """The log chance of each word in each language."""
        parts = [Lattice(words[own], self.path).log_chances(self.chances) for own in bulks(words)]
        return np.concatenate(parts) if parts else np.empty((0, len(self.names)))


def fold(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def word_counts(docs: DataFrame, sample_docs: int) -> DataFrame:
    """(lang, word, n) of a sample of each language's training rows, by a hash of their ids."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(fold() != HELD_OUT, F.lit(False)))
    sizes = {row["lang"]: row["count"] for row in known.groupBy("lang").count().collect()}
    shares = {lang: min(1.0, sample_docs / n) for lang, n in sizes.items()}
    if not shares:
        return known.select("lang", F.lit("").alias("word"), F.lit(0).cast("bigint").alias("n")).limit(0)
    limit = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in rows_of(batch, "lang", "text"):
                counts.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, word, n) for lang, own in counts.items() for word, n in own.items()]
            if rows:
                arrays = [pa.array(x) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "word", "n"])

    counted = known.where(drawn(limit, "doc_id")).select("lang", "text").mapInArrow(run, "lang string, word string, n bigint")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, path: str | None = None) -> Languages:
    """Chances fitted to about `sample_docs` documents of each language in `docs`
    (doc_id, text, lang); rows without an id, a text or a language teach nothing, nor does
    the held-out fold."""
    path = path or public_tokenizers.path(VOCABULARY)
    counts = Staged(docs.sparkSession).write(word_counts(docs, sample_docs), "words")
    names = sorted(row["lang"] for row in counts.select("lang").distinct().collect())
    size = len(pieces(path)[0]) + 1
    chances = np.full((size, max(1, len(names))), 1.0 / size)
    if not names:
        return Languages([], chances, path)
    number = {name: i for i, name in enumerate(names)}
    for _ in range(ROUNDS):
        now = chances

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(now)
            for batch in batches:
                rows = [*rows_of(batch, "lang", "word", "n")]
                for own in bulks([word for _, word, _ in rows]):
                    some = rows[own]
                    weight = np.zeros((len(some), now.shape[1]))
                    weight[np.arange(len(some)), [number[lang] for lang, _, _ in some]] = [n for _, _, n in some]
                    total += Lattice([w for _, w, _ in some], path).uses(now, weight)
            piece, lang = np.nonzero(total)
            if len(piece):
                arrays = [pa.array(piece), pa.array(lang), pa.array(total[piece, lang])]
                yield pa.RecordBatch.from_arrays(arrays, ["piece", "lang", "uses"])

        found = counts.mapInArrow(run, "piece bigint, lang bigint, uses double").groupBy("piece", "lang")
        chances = np.full_like(now, FLOOR)
        for row in found.agg(F.sum("uses").alias("uses")).collect():  # pieces times languages at most
            chances[row["piece"], row["lang"]] += row["uses"]
        chances /= chances.sum(axis=0)
    return Languages(names, chances, path)


def predict_languages(docs: DataFrame, model: Languages | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of `docs` (doc_id, text, lang).

    The score is the chance of the predicted language given the whole text, all languages
    being equally likely before it. Texts that are null or have no letter are `und` with
    score 0, as is everything if no row teaches a language. Ties go to the first language
    by name. Rows are judged each by its own text; a null doc_id is not held out; an empty
    table gives an empty result; other columns are not read. A run of letters is summed
    whole, however long; its pieces take some hundred bytes of memory a letter.
    """
    model = model or train(docs)
    held = F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        held = 0
        table = np.zeros((1024, len(model.names)))
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
            for block in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(sizes // BLOCK)) + 1):
                if not len(block):
                    continue
                part = batch.slice(block[0], len(block))
                if held > HELD:
                    known.clear()
                    held = 0
                names, scores = [], []
                texts = [words_of(text) if model.names else [] for text in part.column("text").to_pylist()]
                fresh = [w for w in dict.fromkeys(w for words in texts for w in words) if w not in known]
                if len(known) + len(fresh) > len(table):
                    table = np.concatenate([table[: len(known)], np.zeros((len(known) + 2 * len(fresh), table.shape[1]))])
                table[len(known) : len(known) + len(fresh)] = model.log_chances(fresh)
                held += sum(map(len, fresh))
                known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                for words in texts:
                    if not words:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    total = table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0)
                    best = int(total.argmax())
                    names.append(model.names[best])
                    scores.append(float(1.0 / np.exp(np.minimum(total - total[best], 0.0)).sum()))
                arrays = [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held, "text").mapInArrow(
        run, "doc_id bigint, held_out boolean, lang_pred string, score double"
    )
