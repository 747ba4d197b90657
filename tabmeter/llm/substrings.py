"""Exact substring removal by prefix-free parsing.

A rolling hash picks triggers: places whose 16-byte hash is the strict minimum of its
neighbourhood, so that a trigger depends on nothing but the bytes around it. Triggers cut
each text into phrases. A phrase holds the window starts between two triggers and reaches
one window length past the last of them, so a suffix that starts in a phrase is decided,
as far as it matters, by the phrase alone. The dictionary is the distinct phrases, each
with its first place; the parse is the list of places. Only dictionary phrases that share
their core with another one are sorted by their suffixes, and the first place of each
phrase carries that order over to the corpus. Text that repeats many times thus costs one
phrase, not one row a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabmeter.llm.common import ROW, Staged, free, numbered, shuffle_parts

LENGTH = 100
GRAM = 16  # bytes under the rolling hash
REACH = 10  # a trigger is the minimum of this many hashes on either side
PIECE = 1 << 16  # texts are parsed in pieces of so many window starts
CHUNK = 1 << 18  # pieces are parsed together up to so many bytes
BLOCK = 16  # chunks whose phrases are packed together
RUN = 1 << 15  # settled windows that follow each other make one run up to so many places
HOT = 1024  # from so many phrases of one core on, each window is dealt out by itself
LAST = np.iinfo(np.int64).max  # where rows without an id stand in the order

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size, both = max(n, 2 * CHUNK), []
        for value in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, value, np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Hashes of any stretch of a buffer, from prefix sums."""

    def __init__(self, buffer: np.ndarray, base: int) -> None:
        powers, self.inverse = _powers(base, len(buffer) + 1)
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers[: len(buffer)], out=self.sums[1:])

    def grams(self, width: int) -> np.ndarray:
        """Hashes of all stretches of one width."""
        return _mix((self.sums[width:] - self.sums[:-width]) * self.inverse[: len(self.sums) - width])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def triggers(hashes: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Places whose hash is below that of `reach` neighbours on either side."""
    edge = np.full(reach, np.iinfo(np.uint64).max, np.uint64)
    low, width = np.concatenate([edge, hashes, edge]), 1
    while 2 * width <= reach:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    if rest := reach - width:
        low = np.minimum(low[:-rest], low[rest:])
    n = len(hashes)
    return np.flatnonzero((hashes < low[:n]) & (hashes < low[reach + 1 : reach + 1 + n]))


def parse(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(owner, lo, count, core, phrase): the phrases of the texts buffer[start:end].

    A phrase stands for the windows that start at lo .. lo + count - 1. `core` hashes the
    bytes around its trigger that all of them hold, `phrase` all it covers. Equal windows
    have equal cores. A window too far from any trigger is a phrase of its own.
    """
    one, two = Rolling(buffer, BASES[0]), Rolling(buffer, BASES[1])
    after = length // 2  # of the core's bytes, those from the trigger on
    found = triggers(one.grams(GRAM))
    owner = np.searchsorted(starts, found, "right") - 1
    before = np.concatenate([[-LENGTH * 8], found[:-1]]) if len(found) else found
    lo = np.maximum(np.maximum(before - REACH + 1, found - (length - after)), starts[owner])
    hi = np.minimum(found - REACH, ends[owner] - length)
    good = hi >= lo
    found, owner, lo, hi = found[good], owner[good], lo[good], hi[good]

    covered = np.zeros(len(buffer) + 1, np.int8)
    for from_, to in ((starts, ends - length + 1), (lo, hi + 1)):
        covered[from_] += 1
        covered[to] -= 1
    lone = np.flatnonzero(np.cumsum(covered[:-1], dtype=np.int8) == 1)
    return (
        np.concatenate([owner, np.searchsorted(starts, lone, "right") - 1]),
        np.concatenate([lo, lone]),
        np.concatenate([hi - lo + 1, np.ones(len(lone), np.int64)]),
        np.concatenate([one.of(found - REACH, found + after), one.of(lone, lone + length)]),
        np.concatenate([two.of(lo, hi + length), two.of(lone, lone + length)]),
    )


def pieces(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(buffer, starts, ends, doc, row, offset) of the batch's texts, cut so that every window
    lies in exactly one piece."""
    docs, numbers = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("doc", "row"))
    held: list[tuple[bytes, int, int, int]] = []
    size = 0

    def close() -> tuple[np.ndarray, ...]:
        buffer = np.frombuffer(b"".join(x[0] for x in held), np.uint8)
        ends = np.cumsum([len(x[0]) for x in held])
        starts = np.concatenate([[0], ends[:-1]])
        return buffer, starts, ends, *(np.array([x[i] for x in held], np.int64) for i in (1, 2, 3))

    for doc, row, value in zip(docs, numbers, batch.column("data"), strict=True):
        data = value.as_py() or b""
        for at in range(0, max(0, len(data) - length + 1), PIECE):
            piece = data[at : at + PIECE + length - 1]
            held.append((piece, doc, row, at))
            size += len(piece)
            if size >= CHUNK:
                yield close()
                held, size = [], 0
    if held:
        yield close()


BLOBS = {"core": np.uint64, "phrase": np.uint64, "doc": np.int64, "row": np.int64, "lo": np.int64, "n": np.uint16}
PLACE = ("lo", "row", "doc", "phrase", "core")  # sort keys, the last one first
ENTRIES = "bucket int, core binary, phrase binary, doc binary, row binary, lo binary, n binary"


def entries(data: DataFrame, length: int, buckets: int) -> DataFrame:
    """The phrases of all texts, packed by bucket of their core.

    A phrase that a block of texts holds more than once goes to its bucket once; its later places
    are settled already. Those that follow each other become one run, which goes to one of the
    buckets from `buckets` on by its row, as settled places need not meet.
    """

    def packed(columns: dict[str, np.ndarray], bucket: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        first = np.concatenate([[0], cuts])
        arrays = [pa.array(bucket[order][first], pa.int32())]
        for name, kind in BLOBS.items():
            whole = columns[name][order].astype(kind)
            arrays.append(pa.array([x.tobytes() for x in np.split(whole, cuts)], pa.binary()))
        return pa.RecordBatch.from_arrays(arrays, ["bucket", *BLOBS])

    def blocks(chunks: Iterator[tuple]) -> Iterator[list[tuple]]:
        while block := [*islice(chunks, BLOCK)]:
            yield block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (x for batch in batches for x in blocks(pieces(batch, length))):
            parts = []
            for buffer, starts, ends, doc, number, offset in block:
                owner, lo, n, core, phrase = parse(buffer, starts, ends, length)
                parts.append((core, phrase, doc[owner], number[owner], lo - starts[owner] + offset[owner], n))
            columns = dict(zip(BLOBS, map(np.concatenate, zip(*parts, strict=True)), strict=True))
            bucket = (columns["core"] % np.uint64(buckets)).astype(np.int64)
            same = columns["core"] ^ (columns["phrase"] * np.uint64(BASES[0]))
            order = np.argsort(same)
            twin = np.diff(same[order]) == 0
            many = order[np.concatenate([twin, [False]]) | np.concatenate([[False], twin])]
            many = many[np.lexsort([columns[x][many] for x in PLACE])]
            late = repeats(columns, many)
            bucket[late] = buckets + columns["row"][late] % buckets
            alone = merged(columns, late)
            columns, bucket = {name: values[alone] for name, values in columns.items()}, bucket[alone]
            if len(bucket):
                yield packed(columns, bucket)

    return data.mapInArrow(run, ENTRIES)


def merged(columns: dict[str, np.ndarray], late: np.ndarray) -> np.ndarray:
    """Which places stay once settled ones that follow each other are merged into the first,
    whose n is then that of the run."""
    alone = np.ones(len(columns["lo"]), bool)
    if len(late):
        late = late[np.lexsort([columns["lo"][late], columns["row"][late]])]
        row, lo, n = (columns[x][late] for x in ("row", "lo", "n"))
        ends, new = lo + n, np.ones(len(late), bool)
        new[1:] = (np.diff(row) != 0) | (lo[1:] != ends[:-1]) | (np.diff(lo // RUN) != 0)
        opens = np.flatnonzero(new)
        columns["n"][late[opens]] = ends[np.append(opens[1:], len(late)) - 1] - lo[opens]
        alone[late[~new]] = False
    return alone


def repeats(columns: dict[str, np.ndarray], order: np.ndarray) -> np.ndarray:
    """Of the sorted places, those with the same phrase at an earlier place."""
    if not len(order):
        return order
    core, phrase, row, lo = (columns[x][order] for x in ("core", "phrase", "row", "lo"))
    new = np.concatenate([[True], (np.diff(core) != 0) | (np.diff(phrase) != 0)])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order[(row != row[head]) | (lo != lo[head])]


def dictionary(packed: DataFrame, buckets: int) -> DataFrame:
    """(doc, row, lo, n, core, hot): settled places, whose windows all have an earlier copy
    (core is null), and the first places of phrases that share a core with other phrases."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        columns = {
            name: np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind) for name, kind in BLOBS.items()
        }
        hot = np.zeros(0, bool)
        if key[0].as_py() >= buckets:
            late, open_ = np.arange(len(columns["core"])), np.empty(0, np.int64)
        else:
            order = np.argsort(columns["core"])
            twin = np.diff(columns["core"][order]) == 0
            many = order[np.concatenate([twin, [False]]) | np.concatenate([[False], twin])]
            many = many[np.lexsort([columns[x][many] for x in PLACE])]
            late = repeats(columns, many)
            new = np.ones(len(many), bool)
            core, phrase = columns["core"][many], columns["phrase"][many]
            new[1:] = (np.diff(core) != 0) | (np.diff(phrase) != 0)
            firsts = many[new]
            _, group, size = np.unique(columns["core"][firsts], return_inverse=True, return_counts=True)
            open_ = firsts[size[group] > 1] if len(firsts) else firsts
            hot = size[group][size[group] > 1] > HOT if len(firsts) else hot
        rows = np.concatenate([late, open_])
        core = columns["core"].view(np.int64)[rows]
        return pa.table(
            {
                "doc": columns["doc"][rows],
                "row": columns["row"][rows],
                "lo": columns["lo"][rows],
                "n": columns["n"][rows].astype(np.int32),
                "core": pa.array(core, mask=np.arange(len(rows)) < len(late)),
                "hot": np.concatenate([np.zeros(len(late), bool), hot]),
            }
        )

    return packed.groupBy("bucket").applyInArrow(
        run, "doc bigint, row bigint, lo bigint, n int, core bigint, hot boolean"
    )


def phrase_texts(data: DataFrame, marks: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, doc, row, lo, n, data): the bytes of the phrases whose suffixes are to be
    sorted.

    Phrases with the same core meet in one bucket. Where a core has very many, their
    windows go each to the bucket of its own hash."""
    span = F.struct("lo", "n", "core", "hot")
    wanted = marks.where("core IS NOT NULL").groupBy("row").agg(F.collect_list(span).alias("spans"))
    joined = data.join(wanted, "row").select("doc", "row", "data", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, row, value, spans in zip(*(batch.column(x) for x in ("doc", "row", "data", "spans")), strict=True):
                doc, row, view = doc.as_py(), row.as_py(), memoryview(value.as_py())
                for lo, n, core, hot in (x.values() for x in spans.as_py()):
                    own = bytes(view[lo : lo + n - 1 + length])
                    if not hot:
                        rows.append(((core % (1 << 64)) % buckets, doc, row, lo, n, own))
                    else:
                        deal = Rolling(np.frombuffer(own, np.uint8), BASES[0]).grams(length) % np.uint64(buckets)
                        rows += [(b, doc, row, lo + i, 1, own[i : i + length]) for i, b in enumerate(deal.tolist())]
                    size += n + length
                if size > CHUNK:
                    yield frame(rows)
                    rows, size = [], 0
            if rows:
                yield frame(rows)

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        arrays = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["bucket", "doc", "row", "lo", "n", "data"])

    return joined.mapInArrow(run, "bucket int, doc bigint, row bigint, lo bigint, n int, data binary")


def suffix_order(phrases: DataFrame, length: int) -> DataFrame:
    """(row, lo, n): runs of windows that also start at an earlier place.

    All suffixes of a bucket's phrases are sorted by 128 bits of hash of their first `length`
    bytes, and equal ones by their place: only equality matters, not the alphabet."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        buffer = np.frombuffer(b"".join(x.as_py() for x in table.column("data")), np.uint8)
        doc, number, lo, n = (table.column(x).to_numpy() for x in ("doc", "row", "lo", "n"))
        sizes = n.astype(np.int64) + length - 1
        first = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(first, n) + inside
        columns = {
            "core": Rolling(buffer, BASES[0]).of(at, at + length),
            "phrase": Rolling(buffer, BASES[1]).of(at, at + length),
            "doc": doc[row],
            "row": number[row],
            "lo": lo[row] + inside,
        }
        order = np.argsort(columns["core"])
        twin = np.diff(columns["core"][order]) == 0
        many = order[np.concatenate([twin, [False]]) | np.concatenate([[False], twin])]
        many = many[np.lexsort([columns[x][many] for x in PLACE])]
        late = np.sort(repeats(columns, many))
        # windows of a phrase that follow each other make one run
        new = np.ones(len(late), bool)
        new[1:] = (np.diff(late) != 1) | (np.diff(row[late]) != 0)
        opens = np.flatnonzero(new)
        count = np.diff(np.concatenate([opens, [len(late)]]))
        return pa.table({"row": columns["row"][late[opens]], "lo": columns["lo"][late[opens]], "n": count.astype(np.int32)})

    return phrases.groupBy("bucket").applyInArrow(run, "row bigint, lo bigint, n int")


def repeated_spans(rows: DataFrame, staged: Staged, length: int = LENGTH) -> DataFrame:
    """(row, lo, n): windows of `length` bytes starting at lo .. lo + n - 1 of a numbered row
    that also start at an earlier place of the corpus. Rows without an id come last, rows of
    one id in the order of their numbers."""
    data = with_bytes(rows)
    buckets = 8 * shuffle_parts(rows.sparkSession)
    marks = staged.write(dictionary(entries(data, length, buckets), buckets), "marks")
    found = staged.write(suffix_order(phrase_texts(data, marks, length, buckets), length), "runs")
    return marks.where("core IS NULL").select("row", "lo", "n").unionAll(found)


def with_bytes(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.coalesce("doc_id", F.lit(int(LAST))).alias("doc"),
        F.col(ROW).alias("row"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"),
    )


def cut(data: bytes, spans: list[dict] | None, length: int, whole: bool = False) -> tuple[bytes, int, int]:
    """The bytes that no span covers, how many are covered, and in how many runs. With `whole`
    a character that loses one of its bytes loses all."""
    if not spans:
        return data, 0, 0
    lo, n = (np.array([x[name] for x in spans]) for name in ("lo", "n"))
    ends = np.minimum(lo + n - 1 + length, len(data))
    size = len(data) + 1
    edge = np.bincount(np.minimum(lo, len(data)), minlength=size) - np.bincount(ends, minlength=size)
    gone, flat = np.cumsum(edge[:-1]) > 0, np.frombuffer(data, np.uint8)
    if whole and len(flat):
        heads = np.flatnonzero(flat & 0xC0 != 0x80)
        gone = np.repeat(np.logical_or.reduceat(gone, heads), np.diff(heads, append=len(flat)))
    kept = flat[~gone].tobytes()
    return kept, int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())


def _with_spans(docs: DataFrame, length: int) -> tuple[DataFrame, str]:
    """The rows with a list of their spans, and the name of that column."""
    staged = Staged(docs.sparkSession)
    number, list_name = free(ROW, docs.columns), free("llm_spans", docs.columns)
    rows = numbered(docs, staged, number)
    spans = repeated_spans(rows.select("doc_id", "text", F.col(number).alias(ROW)), staged, length)
    lists = spans.groupBy(F.col("row").alias(number)).agg(F.collect_list(F.struct("lo", "n")).alias(list_name))
    return rows.join(lists, number, "left"), list_name


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of `docs` (doc_id, text).

    A byte goes if a string of `length` bytes around it also starts earlier: in a row of
    smaller doc_id, in an earlier row of the same one, or earlier in the same row; strings
    may overlap and never cross rows. Null texts are empty, as are empty ones: nothing goes.
    Rows that share a doc_id are texts of their own, in the order of the numbers they are
    written with; rows without an id come last, in that order too. An empty table gives an
    empty result; other columns are not read.
    """
    joined, _ = _with_spans(docs.select("doc_id", "text"), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("llm_spans"), strict=True):
                data = (text.as_py() or "").encode()
                kept, removed, runs = cut(data, spans.as_py(), length)
                rows.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest()))
            arrays = [pa.array(x) for x in zip(*rows, strict=True)] if rows else []
            if arrays:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    return joined.select("doc_id", "text", "llm_spans").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs` with repeated strings cut from `text`, all rows and columns kept.

    A character that loses some of its bytes goes whole; null texts stay null, empty ones
    empty. Ties, repeated rows, shared and missing ids are as in `removal_report`; further
    columns pass whatever their names."""
    joined, list_name = _with_spans(docs, length)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if text.as_py() is None else cut(text.as_py().encode(), spans.as_py(), length, whole=True)[0].decode()
                for text, spans in zip(batch.column("text"), batch.column(list_name), strict=True)
            ]
            arrays = [pa.array(texts, pa.string()) if name == "text" else batch.column(name) for name in columns]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return joined.mapInArrow(run, docs.schema)
