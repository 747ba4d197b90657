"""BPE encoding by speculation: greedy longest matches, checked in bulk, merged only on failure.

A sequence of tokens is what BPE merging gives exactly if every token is what merging gives
for its own letters and every two neighbours are what merging gives for theirs. So for each
new word the longest token that fits is taken again and again, for all words of a batch at
once; the tokens and all pairs of neighbours are then tested with array operations, and only
the words that fail are merged step by step.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from tabmeter.llm.packing import byte_letters

VOCABULARY = "word_bpe_49k.json"
HELD = 1 << 19  # words whose ids a task remembers; beyond it, it starts afresh
BLOCK = 1 << 22  # bytes of text handled together
BULK = 1 << 15  # words matched at a time
LONG = 64  # letters; longer words go to the heap at once
BASE = np.uint64(0x9E3779B97F4A7C15)


class WordBpe:
    """Encoder and decoder of a vocabulary with word ends, from its tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in (self.vocab | self.special).items():
            self.tokens[i] = token
        self.octets = byte_letters()
        self.letters = {b: c for c, b in self.octets.items()}
        self.library = Tokenizer.from_file(path)
        self.known_letters: set[str] = set()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern, regex.V0).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.space = regex.compile(r"\s+").sub
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        left, right = np.arange(size), np.arange(size)
        for rank, (a, b) in enumerate(model["merges"]):
            made = self.vocab[a + b]
            self.merges[self.vocab[a], self.vocab[b]] = (rank, made)
            left[made], right[made] = self.vocab[a], self.vocab[b]
        self.left, self.right, self.size = left, right, size
        pairs = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(pairs)
        self.pair_keys = pairs[order]
        self.pair_made = np.array([x[1] for x in self.merges.values()], np.int64)[order]
        self._table()
        made = np.flatnonzero(left != np.arange(size))
        sound = np.ones(size, bool)
        sound[made] = self.compatible(left[made], right[made], made)
        for i in made:  # parts come before what is made of them
            sound[i] &= sound[left[i]] and sound[right[i]]
        self.sound = sound

    def _table(self) -> None:
        """Hashes of all tokens, by length in letters; a word end counts as one letter."""
        own = {t: i for t, i in self.vocab.items() if t not in self.special}
        spelt = {t.removesuffix(self.end) + ("\0" if t.endswith(self.end) else ""): i for t, i in own.items()}
        self.spelt, self.longest = spelt, max(map(len, spelt))
        #: By length: hashes of all beginnings of tokens, with the token that ends there or -1.
        self.by_size: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
        for n in range(1, self.longest + 1):
            heads = sorted({s[:n] for s in spelt if len(s) >= n})
            keys = np.zeros(len(heads), np.uint64)
            for column in np.array([[ord(c) for c in s] for s in heads], np.uint64).T:
                keys = keys * BASE + column + np.uint64(1)
            order = np.argsort(keys)
            self.by_size.append((keys[order], np.array([spelt.get(s, -1) for s in heads], np.int64)[order]))

    def compatible(self, one: np.ndarray, two: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the letters of each pair of tokens gives back the pair.

        Undoing the merges of both from the last to the first, a merge across the border
        must never come before the one undone. Ids are in the order of the merges.
        `limit`: merges from this id on don't count."""
        one, two, good = one.copy(), two.copy(), np.ones(len(one), bool)
        limit = np.full(len(one), self.size) if limit is None else limit.copy()
        live = np.arange(len(one))
        while len(live):
            a, b, cap = one[live], two[live], limit[live]
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == key) & (self.pair_made[at] < cap)
            good[live[bad]] = False
            a_leaf, b_leaf = self.left[a] == a, self.left[b] == b
            undo_a = ((a > b) | b_leaf) & ~a_leaf
            undo_b = ~undo_a & ~b_leaf
            limit[live] = np.where(undo_a, a, np.where(undo_b, b + 1, cap))
            one[live] = np.where(undo_a, self.right[a], a)
            two[live] = np.where(undo_b, self.left[b], b)
            live = live[~bad & (undo_a | undo_b)]
        return good

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches of spelt words: the tokens of all words in order, -1 where nothing
        fits, and the word of each."""
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        ends = np.cumsum(sizes)
        at, stop = ends - sizes, ends
        best = np.full(len(flat), -1, np.int64)
        step = np.ones(len(flat), np.int64)
        room = np.repeat(stop, sizes) - np.arange(len(flat))
        live, hashed = np.arange(len(flat)), np.zeros(len(flat), np.uint64)
        for n in range(1, self.longest + 1):
            hashed = hashed * BASE + flat[live + n - 1]
            keys, ids = self.by_size[n]
            place = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            token = np.where(keys[place] == hashed, ids[place], -2)
            best[live[token >= 0]], step[live[token >= 0]] = token[token >= 0], n
            on = (token > -2) & (room[live] > n)  # some token begins like this
            live, hashed = live[on], hashed[on]
            if not len(live):
                break
        found, owner, index, live = [], [], [], np.arange(len(words))
        for turn in range(int(sizes.max(initial=0))):
            found.append(best[at[live]])
            owner.append(live)
            index.append(np.full(len(live), turn))
            at[live] += step[at[live]]
            live = live[at[live] < stop[live]]
            if not len(live):
                break
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        tokens, owners = np.concatenate(found), np.concatenate(owner)
        order = np.lexsort([np.concatenate(index), owners])
        return tokens[order], owners[order]

    def merge(self, spelt: str) -> list[int]:
        """Exact merging: always the earliest rule, and of its places the first."""
        letters = [*spelt]
        if letters and letters[-1] == "\0":
            letters.pop()
            letters[-1] += "\0"
        ids: list[int | None] = [self.spelt.get(c) for c in letters]
        if None in ids:
            raise ValueError("the vocabulary lacks a letter")
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, made, a, b) for rank, made, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, m[1], ids[x], ids[y]))
        return [i for i in ids if i is not None]

    def _ranks(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """What merging each pair makes, as ids in the order of the rules; `size` if nothing."""
        key = one * self.size + two
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_made[at], self.size)

    def merge_all(self, spelt: list[str]) -> list[list[int]]:
        """`merge` for many short words, one merge of every word in each turn."""
        flat, sizes = [], []
        for word in spelt:
            letters = [self.spelt[c] for c in word[:-2]] + [self.spelt[word[-2:]]]
            flat += letters
            sizes.append(len(letters))
        out: list[list[int]] = [[] for _ in spelt]
        ids, owner = np.array(flat, np.int64), np.repeat(np.arange(len(spelt)), sizes)
        made = np.full(len(ids), self.size)
        near = np.flatnonzero(owner[1:] == owner[:-1])
        made[near] = self._ranks(ids[near], ids[near + 1])
        while len(ids):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.repeat(np.minimum.reduceat(made, starts), np.diff(np.append(starts, len(ids))))
            over = least == self.size
            if over.any():
                at = np.flatnonzero(over)
                first = np.flatnonzero(np.diff(owner[at], prepend=-1))
                own, cuts = ids[at].tolist(), np.append(first, len(at)).tolist()
                for i, begin, end in zip(owner[at][first].tolist(), cuts[:-1], cuts[1:], strict=True):
                    out[i] = own[begin:end]
                ids, owner, made, least = ids[~over], owner[~over], made[~over], least[~over]
            place = np.flatnonzero(made == least)
            place = place[np.diff(owner[place], prepend=-1) != 0]
            ids[place] = made[place]
            keep = np.ones(len(ids), bool)
            keep[place + 1] = False
            ids, owner, made = ids[keep], owner[keep], made[keep]
            place = place - np.arange(len(place))
            for at in (place, place[place > 0] - 1):
                last = (at + 1 >= len(ids)) | (owner[np.minimum(at + 1, len(ids) - 1)] != owner[at])
                made[at] = np.where(last, self.size, self._ranks(ids[at], ids[np.minimum(at + 1, len(ids) - 1)]))
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, as merging gives them."""
        spelt = ["".join(map(self.letters.__getitem__, w.encode())) + "\0" for w in words]
        out: list[list[int]] = [[] for _ in words]
        short = [i for i, s in enumerate(spelt) if len(s) <= LONG]
        for i in (i for i, s in enumerate(spelt) if len(s) > LONG):
            out[i] = self.merge(spelt[i])
        for base in range(0, len(short), BULK):
            some = short[base : base + BULK]
            tokens, owner = self.propose([spelt[i] for i in some])
            good = np.ones(len(some), bool)
            known = tokens >= 0
            good[owner[~known]] = False
            good[owner[known & ~self.sound[np.maximum(tokens, 0)]]] = False
            pair = np.flatnonzero((owner[1:] == owner[:-1]) & known[1:] & known[:-1])
            fine = self.compatible(tokens[pair], tokens[pair + 1])
            good[owner[pair[~fine]]] = False
            cuts, ids = np.append(np.flatnonzero(np.diff(owner)) + 1, len(owner)).tolist(), tokens.tolist()
            failed, begin = [], 0
            for i, end, ok in zip(some, cuts, good.tolist(), strict=True):
                if ok:
                    out[i] = ids[begin:end]
                else:
                    failed.append(i)
                begin = end
            for i, own in zip(failed, self.merge_all([spelt[i] for i in failed]), strict=True):
                out[i] = own
        return out

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special tokens. Letters that Python's tables don't know
        yet are left to the library's own tables."""
        if text.isascii() or self.assigned(set(text)):
            return self.words(self.normal(text))
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.octets.__getitem__, word)).decode() for word, _ in found]

    def assigned(self, letters: set[str]) -> bool:
        """Whether Python's tables have a category for each of the letters."""
        fresh = {c for c in letters - self.known_letters if unicodedata.category(c) != "Cn"}
        self.known_letters |= fresh
        return letters <= self.known_letters

    def normal(self, text: str) -> str:
        """Composed letters, single blanks, small letters one by one."""
        text = unicodedata.normalize("NFC", text)
        return self.space(" ", text).replace("Σ", "σ").lower()

    def split(self, text: str) -> Iterator[str | int]:
        """The words of a text in order, and the ids of special tokens in it."""
        for part in self.cut(text):
            if part in self.special:
                yield self.special[part]
            elif part:
                yield from self.pieces(part)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every row of `docs` (doc_id, text).

    `ids` are the whole text's tokens as little-endian 32-bit integers, `decoded` the tokens
    with blanks between them, as there is no decoder to join them. Null, empty and blank texts
    have no ids and decode to nothing; each row is encoded by itself, whatever its doc_id; an
    empty table gives an empty result; other columns are not read. What a task remembers of
    words is bounded and changes no result.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)
        fixed = {i: (np.array([i], "<u4").tobytes(), bpe.tokens[i]) for i in bpe.special.values()}
        known: dict[str | int, tuple[bytes, str]] = dict(fixed)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
            for block in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(sizes // BLOCK)) + 1):
                part = batch.slice(block[0], len(block)) if len(block) else batch.slice(0, 0)
                if len(known) > HELD:
                    known = dict(fixed)
                texts = [[*bpe.split(text)] if text else [] for text in part.column("text").to_pylist()]
                fresh = [w for w in dict.fromkeys(chain.from_iterable(texts)) if w not in known]
                for word, ids in zip(fresh, bpe.encode_words(fresh), strict=True):
                    known[word] = (np.array(ids, "<u4").tobytes(), " ".join(map(bpe.tokens.__getitem__, ids)))
                blobs, decoded = [], []
                for words in texts:
                    both = [known[w] for w in words]
                    blobs.append(b"".join([x[0] for x in both]))
                    decoded.append(" ".join([x[1] for x in both]))
                arrays = [part.column("doc_id"), pa.array(blobs, pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary, decoded string")


def encoding_report(docs: DataFrame) -> DataFrame:
    """How many ids each row has, and digests of the ids and of the decoded text."""
    return encode_decode(docs).select(
        "doc_id",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
