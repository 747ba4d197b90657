"""Mixture-controlled packing by deficit round-robin over the queues of the sources.

In every round each source gets a quantum in proportion to its weight; what it can't use
in whole tokens stays as its deficit for the next round. The credit of a source after r
rounds is thus floor(r * quantum), which needs no state: given the tokens of its source
that stand before it, a document knows the rounds and places of its pieces. The tokens
before each task's documents are one small table, so deficits carry over windows and
partitions alike, and no task sees more than its own documents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tabmeter.llm.common import Staged

VOCABULARY = "byte_bpe_50k.json"
WINDOW = 2048
END = 1
ROWS = 1 << 12  # pieces placed at a time


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizer file; its special tokens are found in texts."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_letters()
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_table(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, queue, part, start, n, ids): the ids of each row, closed by END, and how many
    tokens of its queue stand before it in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, used = byte_encoder(path), {}
        part, special = TaskContext.get().partitionId(), encoder.special_tokens_set
        for batch in batches:
            starts, sizes, blobs = [], [], []
            for queue, text in zip(batch.column("queue").to_pylist(), batch.column("text"), strict=True):
                ids = encoder.encode(text.as_py() or "", allowed_special=special, disallowed_special=())
                blob = np.array([*ids, END], "<u4").tobytes()
                starts.append(used.get(queue, 0))
                sizes.append(len(ids) + 1)
                blobs.append(blob)
                used[queue] = starts[-1] + sizes[-1]
            n = len(blobs)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("queue"),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(blobs, pa.binary()),
                ],
                ["doc_id", "queue", "part", "start", "n", "ids"],
            )

    queue = F.coalesce(F.concat(F.lit("source "), F.col("source")), F.lit("none")).alias("queue")
    return docs.select("doc_id", queue, "text").mapInArrow(
        run, "doc_id bigint, queue string, part int, start bigint, n bigint, ids binary"
    )


class Schedule:
    """Rounds of the deficit round-robin, for queues of known totals and weights.

    A phase is a run of rounds with the same queues; when one runs out, its share goes to
    the others. Within a phase the credit of a queue after r rounds is
    floor(r * window * weight / weights), but never more than it has left.
    """

    def __init__(self, totals: Mapping[str, int], weights: Mapping[str, float] | None, window: int) -> None:
        self.queues, self.window = sorted(totals), window
        left = np.array([totals[q] for q in self.queues], np.int64)
        share = left.astype(float) if weights is None else np.array([weights.get(q, 0.0) for q in self.queues], float)
        if (share < 0).any() or not np.isfinite(share).all():
            raise ValueError("weights must be finite and not negative")
        if not (share > 0).any():
            share[:] = 1.0
        scale = min(1 << 20, (1 << 60) // max(int(left.sum()) + window, 1))
        self.phases: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        done, line = np.zeros_like(left), 0
        while (left > 0).any():
            live = left > 0
            own = np.where(live, share, 0.0)
            own = own if own.any() else live.astype(float)
            weight = np.where(own > 0, np.maximum(1, np.round(own / own.sum() * scale)), 0).astype(np.int64)
            going = weight > 0
            # rounds until the first of the live queues runs out
            need = [-(-int(x) * int(weight.sum()) // (window * int(w))) for x, w in zip(left[going], weight[going], strict=True)]
            rounds = max(1, min(need))
            self.phases.append((done.copy(), left.copy(), weight, line))
            used = self._credit(weight, left, np.array([rounds]))[0]
            done, left, line = done + used, left - used, line + int(used.sum())
        self.starts = np.array([p[0] for p in self.phases], np.int64).reshape(len(self.phases), len(self.queues))

    def _credit(self, weight: np.ndarray, left: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        return np.minimum(rounds[:, None] * (self.window * weight)[None, :] // max(int(weight.sum()), 1), left[None, :])

    def places(self, queue: int, begin: int, n: int) -> list[tuple[int, int, int]]:
        """(start, length, line): pieces of tokens begin .. begin + n - 1 of a queue, and where
        they stand on the line that is cut into windows."""
        out: list[tuple[int, int, int]] = []
        at = begin
        phase = int(np.searchsorted(self.starts[:, queue], at, "right")) - 1
        while at < begin + n:
            first, left, weight, line = self.phases[phase]
            last = self.starts[phase + 1, queue] if phase + 1 < len(self.phases) else first[queue] + left[queue]
            stop = min(begin + n, int(last))
            if stop > at:
                total, gain = int(weight.sum()), self.window * int(weight[queue])
                low = -(-(at - int(first[queue]) + 1) * total // gain) - 1
                high = -(-(stop - int(first[queue])) * total // gain) - 1
                for base in range(low, high + 1, ROWS):
                    rounds = np.arange(base, min(base + ROWS, high + 1), dtype=np.int64)
                    now, then = self._credit(weight, left, rounds), self._credit(weight, left, rounds + 1)
                    place = line + now.sum(axis=1) + (then - now)[:, :queue].sum(axis=1)
                    start = np.maximum(first[queue] + now[:, queue], at)
                    end = np.minimum(first[queue] + then[:, queue], stop)
                    place = place + start - (first[queue] + now[:, queue])
                    for s, e, p in zip(start.tolist(), end.tolist(), place.tolist(), strict=True):
                        while s < e:
                            size = min(e - s, self.window - p % self.window)
                            out.append((s - begin, size, p))
                            s, p = s + size, p + size
                at = stop
            phase += 1
        return out


def pack(docs: DataFrame, window: int = WINDOW, weights: Mapping[str, float] | None = None, path: str | None = None) -> DataFrame:
    """Pieces of the rows of `docs` (doc_id, text, source) in windows of `window` tokens.

    (doc_id, start, length, ids, doc_tokens, sequence_id, offset): `ids` are the piece's
    tokens as little-endian 32-bit integers. Each row's ids, and id 1 after them, lie in
    exactly one piece each. Every window but the last is full and holds the sources in the
    proportions of `weights` (by source; None: of their tokens) as long as they last,
    within one token a source; a source without weight comes after the others. Null text
    is empty and gives one piece with the closing id; a null source is a source of its own;
    a null doc_id is kept; repeated rows are packed each; an empty table gives no rows.
    The totals of the sources, one number each, go through the driver.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    staged = Staged(docs.sparkSession)
    tokens = staged.write(token_table(docs, path), "tokens")
    sums = tokens.groupBy("queue", "part").agg(F.max(F.col("start") + F.col("n")).alias("size"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged.write(sums.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))), "bases")
    totals = {row["queue"]: row["total"] for row in bases.groupBy("queue").agg(F.sum("size").alias("total")).collect()}
    named = None if weights is None else {f"source {k}" if k is not None else "none": v for k, v in weights.items()}
    schedule = Schedule(totals, named, window)
    number = {queue: i for i, queue in enumerate(schedule.queues)}
    joined = tokens.join(bases.select("queue", "part", "base"), ["queue", "part"]).select(
        "doc_id", "queue", (F.col("base") + F.col("start")).alias("begin"), "n", "ids"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            fields = (batch.column(x).to_pylist() for x in ("doc_id", "queue", "begin", "n", "ids"))
            for doc, queue, begin, n, ids in zip(*fields, strict=True):
                for start, size, line in schedule.places(number[queue], begin, n):
                    piece = ids[4 * start : 4 * (start + size)]
                    rows.append((doc, start, size, piece, n, line // window, line % window))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                arrays = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return joined.mapInArrow(
        run,
        "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint",
    )


def packing_report(docs: DataFrame) -> DataFrame:
    """The pieces of `pack`, with a checksum for their ids."""
    return pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
