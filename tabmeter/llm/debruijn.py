"""Repeated passages by compaction of a De Bruijn graph of words.

Windows of k words are the edges of a graph whose nodes are the k - 1 words that two
windows of a text share. Each text is cut into phrases: runs of windows that have the same
smallest hash of four words, the core. Equal windows have equal cores, so only phrases with
a core that several documents hold matter, and a phrase that is alone with its core is a
path of edges that nothing else holds. Phrases that share a core with others are opened into
single edges. Edges and paths that stand in two documents or more are the repeated pieces of
the graph. Windows of a phrase that follow each other and stand first in the same other phrase make one
part; the windows that a phrase owns itself are the pieces that make up the graph. Pieces
that meet in a node where one piece ends and one begins are joined: first those that follow
each other in their source document, by place, then the remaining ones by joins that double
the distance to the head of a path each time. Parts map to pieces, pieces to paths and to the
document they come from; a span of a later document that lies on a path goes.

Phrases and edges are compared by a hash of their words at their own places together with
their core, 128 bits in all. A path may pass a node inside a phrase at which another path ends or begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabmeter.llm.common import Staged, drawn

LENGTH = 13
GRAM = 4  # words under a core
PIECE = 1 << 20  # bytes of a text that are split into words at a time
CHUNK = 1 << 17  # words whose windows are worked out together
BLOCK = 1 << 22  # words among whose phrases copies are settled before any shuffle
SAMPLE_DOCS = 4096  # documents drawn to find cores that very many share
HOT_SHARE = 0.01  # of the drawn documents
HOT_CORES = 10_000
SALTS = 32  # tasks that share the phrases of a hot core
LAST = np.iinfo(np.int64).max  # where rows without an id stand in the order
BLANK = re.compile(rb"[ \t-\r]")
BASE = np.uint64(0x9E3779B97F4A7C15)
OPEN, HOT, LATE = 0, 1, 2


def word_chunks(data: bytes, overlap: int) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first word, words) of stretches of a text; each begins with the last
    `overlap` words of the one before."""
    at, first, carry = 0, 0, []
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            blank = BLANK.search(data, end)
            end = blank.start() if blank else len(data)
        words = carry + data[at:end].split()
        yield first, words
        carry = words[max(0, len(words) - overlap) :]
        first, at = first + len(words) - len(carry), end


_POWERS: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any stretch of words, from prefix sums over the hashes of the words."""

    def __init__(self, words: list[bytes]) -> None:
        n = len(words)
        if len(_POWERS[0]) <= n:
            for i, base in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
                row = np.full(max(2 * n, 2 * CHUNK), base, np.uint64)
                row[0] = 1
                _POWERS[i] = np.multiply.accumulate(row)
        single = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(single * _POWERS[0][:n], out=self.sums[1:])

    def of(self, first: np.ndarray, count: np.ndarray | int) -> np.ndarray:
        return _mixed((self.sums[first + count] - self.sums[first]) * _POWERS[1][first])

    def all(self, count: int) -> np.ndarray:
        """Those of all stretches of one length."""
        places = max(0, len(self.sums) - count)
        return _mixed((self.sums[count:] - self.sums[:places]) * _POWERS[1][:places])


def phrases(words: list[bytes], ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(core, phrase, first window, windows) of the phrases of texts that end at the words
    `ends`; `phrase` is the hash of all words under it."""
    gram = min(GRAM, length)
    count, width = len(words) - length + 1, length - gram + 1
    if count <= 0:
        return (np.empty(0, np.int64),) * 4
    hashes = Hashes(words)
    grams = hashes.all(gram)
    core, place = grams[:count].copy(), np.arange(count)
    for i in range(1, width):
        other = grams[i : i + count]
        less = other < core
        core = np.where(less, other, core)
        place[less] = np.flatnonzero(less) + i
    window = np.arange(count)
    inside = window + length <= ends[np.searchsorted(ends, window, "right")]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    stops = np.flatnonzero(new | ~inside)
    after = np.append(stops, count)[np.searchsorted(stops, first, "right")]
    phrase = hashes.of(first, after - first + length - 1)
    return core[first].view(np.int64), phrase.view(np.int64), first, after - first


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tidy(Staged):
    """Staged tables whose shuffle files go as soon as a table is written: nothing reads them
    again, and together they would be many times the input."""

    def write(self, frame: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        conf = self.spark.conf
        before = conf.get(CLEANUP)
        conf.set(CLEANUP, "true")
        try:
            return super().write(frame, name, compression)
        finally:
            conf.set(CLEANUP, before)


COLUMNS = ("core", "phrase", "doc", "row", "lo")
PLACES = "kind int, core bigint, phrase bigint, doc bigint, row bigint, lo bigint, n int"


def _parsed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(words, phrases) of chunks of the texts of batches (doc, row, data)."""
    words: list[bytes] = []
    owners: list[tuple[int, int, int, int]] = []  # doc, row, number of the first word, end

    def close() -> tuple[int, dict[str, np.ndarray]]:
        doc, row, base, ends = (np.array(x, np.int64) for x in zip(*owners, strict=True))
        starts = np.concatenate([[0], ends[:-1]])
        core, phrase, first, n = phrases(words, ends, length)
        own = np.searchsorted(ends, first, "right")
        lo = first - starts[own] + base[own]
        return len(words), {"core": core, "phrase": phrase, "doc": doc[own], "row": row[own], "lo": lo, "n": n}

    for batch in batches:
        docs, rows = (batch.column(x).to_pylist() for x in ("doc", "row"))
        for doc, row, value in zip(docs, rows, batch.column("data"), strict=True):
            for base, own in word_chunks(value.as_py(), length - 1):
                if len(own) < length:
                    continue
                words += own
                owners.append((doc, row, base, len(words)))
                if len(words) >= CHUNK:
                    yield close()
                    words, owners = [], []
    if owners:
        yield close()


def settled(columns: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The phrases of a block, and which of them are settled: those of a phrase that a smaller
    document of the block holds, as all their windows go. Its last place stays open beside
    its first ones, so that the documents of a phrase are known from open places. Settled
    phrases that follow each other in a text become one run."""
    order = np.lexsort([columns[x] for x in reversed(COLUMNS)])
    columns = {name: values[order] for name, values in columns.items()}
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(columns["core"]) != 0) | (np.diff(columns["phrase"]) != 0)
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    late = columns["doc"] > columns["doc"][head]
    late &= ~np.append(new[1:], True)
    at = np.flatnonzero(late)
    at = at[np.lexsort([columns[x][at] for x in ("lo", "row", "doc")])]
    doc, row, lo, n = (columns[x][at] for x in ("doc", "row", "lo", "n"))
    opens = np.ones(len(at), bool)
    opens[1:] = (np.diff(doc) != 0) | (np.diff(row) != 0) | (lo[1:] != (lo + n)[:-1])
    first = np.flatnonzero(opens)
    if len(first):
        columns["n"][at[first]] = (lo + n)[np.append(first[1:], len(at)) - 1] - lo[first]
    keep = np.ones(len(late), bool)
    keep[at[~opens]] = False
    return {name: values[keep] for name, values in columns.items()}, late[keep]


def places(texts: DataFrame, length: int, hot: np.ndarray) -> DataFrame:
    """(kind, core, phrase, doc, row, lo, n) of the phrases of all texts (doc, row, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            whole = {name: np.concatenate([x[name] for x in held]) for name in held[0]}
            columns, late = settled(whole)
            kind = np.where(late, LATE, np.where(np.isin(columns["core"], hot), HOT, OPEN))
            arrays = [pa.array(kind, pa.int32()), *(pa.array(columns[x]) for x in COLUMNS)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(columns["n"], pa.int32())], ["kind", *COLUMNS, "n"])

        for words, columns in _parsed(batches, length):
            held.append(columns)
            size += words
            if size >= BLOCK:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    return texts.mapInArrow(run, PLACES)


def hot_cores(texts: DataFrame, length: int) -> np.ndarray:
    """Cores in more than HOT_SHARE of about SAMPLE_DOCS drawn documents. They need no count to
    be known as shared, so their places need not meet; any other core may be missing here."""
    n = texts.select("doc").count()
    sample = texts.where(drawn(min(1.0, SAMPLE_DOCS / max(n, 1)), "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, columns in _parsed(batches, length):
            pairs = np.unique(np.stack([columns["core"], columns["doc"], columns["row"]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0])], ["core"])

    counted = sample.mapInArrow(run, "core bigint").groupBy("core").count()
    least = max(2.0, HOT_SHARE * min(n, SAMPLE_DOCS))
    found = counted.where(F.col("count") >= least).orderBy(F.desc("count"), "core").limit(HOT_CORES).collect()
    return np.array([row["core"] for row in found], np.int64)


def shared_places(found: DataFrame) -> DataFrame:
    """Places whose core stands in two documents, with `mixed`: whether several phrases have it.

    Places of a core meet by its key; those that need not meet are spread by their own."""
    free = F.col("kind") != OPEN
    keyed = found.withColumn("key", F.when(free, F.xxhash64("row", "lo")).otherwise(F.col("core")))
    core = Window.partitionBy("key", "kind")
    wide = keyed.select(
        *found.columns,
        (F.min("doc").over(core) < F.max("doc").over(core)).alias("several"),
        (F.min("phrase").over(core) < F.max("phrase").over(core)).alias("mixed"),
    )
    return wide.where(free | F.col("several")).select(*found.columns, (free | F.col("mixed")).alias("mixed"))


def opened_phrases(texts: DataFrame, known: DataFrame, length: int) -> DataFrame:
    """(core, phrase, hot, i, edge, tail, head, doc, row, lo, n, hi): each phrase at its first
    place as one row, or as one a window if it is mixed; `tail` and `head` are the hashes of
    its first and last node."""
    fields = F.struct("lo", "n", "core", "phrase", "mixed", "hot", "hi")
    lists = known.groupBy("doc", "row").agg(F.sort_array(F.collect_list(fields)).alias("wanted"))
    joined = texts.join(lists, ["doc", "row"])
    names = ["core", "phrase", "hot", "i", "edge", "tail", "head", "doc", "row", "lo", "n", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            docs, rows = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("doc", "row"))
            lists = batch.column("wanted")
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            asked = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
            asked |= {x: np.repeat(own, np.diff(ends, prepend=0)) for x, own in (("doc", docs), ("row", rows))}
            held: list[bytes] = []
            spots: list[tuple[int, int, int]] = []  # phrases from, to, place of word 0 in held
            for number, data in enumerate(batch.column("data")):
                if (docs[number], rows[number]) == last:  # equal rows follow each other
                    continue
                last = docs[number], rows[number]
                begin = ends[number - 1] if number else 0
                lo = asked["lo"][begin : ends[number]]
                for base, words in word_chunks(data.as_py(), length - 1):
                    from_, to = np.searchsorted(lo, [base, base + max(0, len(words) - length + 1)])
                    if from_ < to:
                        spots.append((begin + from_, begin + to, len(held) - base))
                        held += words
                    if len(held) >= CHUNK:
                        yield opened(held, spots, asked)
                        held, spots = [], []
            if spots:
                yield opened(held, spots, asked)

    def opened(held: list[bytes], spots: list[tuple[int, int, int]], asked: dict[str, np.ndarray]) -> pa.RecordBatch:
        words, pick = Hashes(held), np.concatenate([np.arange(a, b) for a, b, _ in spots])
        own = {name: values[pick] for name, values in asked.items()}
        shift = np.repeat([x for _, _, x in spots], [b - a for a, b, _ in spots])
        mixed = own["mixed"].astype(bool)
        times = np.where(mixed, own["n"], 1)
        of = np.repeat(np.arange(len(times)), times)
        i = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        n = np.where(mixed, 1, own["n"])[of]
        lo = own["lo"][of] + i
        at, edge = lo + shift[of], own["phrase"][of]
        edge[mixed[of]] = words.of(at[mixed[of]], length).view(np.int64)
        tail, head = (words.of(x, length - 1).view(np.int64) for x in (at, at + n))
        arrays = [own["core"][of], own["phrase"][of], own["hot"].astype(bool)[of], i, edge, tail, head]
        arrays += [own["doc"][of], own["row"][of], lo, n, own["hi"][of]]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), *[pa.int64()] * 6, pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x).cast(kind) for x, kind in zip(arrays, kinds, strict=True)], names)

    return joined.mapInArrow(
        run,
        "core bigint, phrase bigint, hot boolean, i int, edge bigint, tail bigint, head bigint, doc bigint, "
        "row bigint, lo bigint, n int, hi bigint",
    )


def parts_of(opened: DataFrame) -> DataFrame:
    """(core, phrase, i, n, owner, at, doc, row, lo, tail, head): the windows of each phrase that
    stand in two documents, as stretches that the phrase `owner` holds from its window `at` on
    at the first place of all. Where a phrase is its own owner, doc, row and lo are that place.

    All steps are by core, so rows are dealt out once. Only windows of hot cores, which very
    many phrases may hold, are counted first and salted."""
    place, same = F.struct("doc", "row", "lo", "phrase", "i"), ["core", "edge"]
    most = opened.where(~F.col("hot")).repartition("core")
    most = most.withColumns({x: f.over(Window.partitionBy(*same)) for x, f in (("source", F.min(place)), ("top", F.max("hi")))})
    crowd = opened.where("hot").withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    counted = crowd.groupBy(*same).agg(F.min(place).alias("source"), F.max("hi").alias("top"))
    counted = counted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    crowd = crowd.join(counted, [*same, "salt"])
    return _stretches(most).unionByName(_stretches(crowd))


def _stretches(sourced: DataFrame) -> DataFrame:
    order = Window.partitionBy("core", "phrase").orderBy("i")

    def before(value: Column) -> Column:
        return F.lag(value).over(order)

    ends, stops = F.col("i") + F.col("n"), F.col("source.i") + F.col("n")
    follows = (
        (before(ends) == F.col("i"))
        & (before(F.col("source.phrase")) == F.col("source.phrase"))
        & (before(stops) == F.col("source.i"))
    )
    # windows that stand in one document only are left out first, so they part stretches
    repeated = sourced.where("source.doc < top").withColumn("opens", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    numbered = repeated.withColumn("number", F.sum("opens").over(order))
    return numbered.groupBy("core", "phrase", "number").agg(
        F.min("i").alias("i"),
        F.sum("n").alias("n"),
        F.min("source.phrase").alias("owner"),
        F.min("source.i").alias("at"),
        F.min("source.doc").alias("doc"),
        F.min("source.row").alias("row"),
        F.min("source.lo").alias("lo"),
        F.min_by("tail", "i").alias("tail"),
        F.max_by("head", "i").alias("head"),
    ).drop("number")


def runs_of(pieces: DataFrame, staged: Staged) -> tuple[DataFrame, DataFrame]:
    """Pieces with `run` and `at` (their first window in it), and the nodes (node) that may be
    passed: where one piece ends and one begins.

    A run is a stretch of pieces that follow each other in their source document by such
    nodes. Very long documents are sorted in stretches of their own."""
    ends = pieces.select(F.col("tail").alias("node"), F.lit(1).alias("begin"), F.lit(0).alias("end"))
    ends = ends.unionAll(pieces.select(F.col("head"), F.lit(0), F.lit(1)))
    degrees = ends.groupBy("node").agg(F.sum("begin").alias("begin"), F.sum("end").alias("end"))
    joints = staged.write(degrees.where("begin = 1 AND end = 1").select("node"), "joints")
    marked = pieces.join(joints, pieces["tail"] == joints["node"], "left")
    stretch = Window.partitionBy("doc", "row", F.shiftright("lo", 16)).orderBy("lo")
    follows = F.col("node").isNotNull() & (F.lag(F.col("lo") + F.col("n")).over(stretch) == F.col("lo"))
    opens = marked.withColumn("opens", F.when(F.coalesce(follows, F.lit(False)), None).otherwise(F.col("lo")))
    start = F.last("opens", ignorenulls=True).over(stretch.rowsBetween(Window.unboundedPreceding, 0))
    named = opens.withColumn("start", start).withColumn("run", F.xxhash64("doc", "row", "start"))
    return named.select(*pieces.columns, "run", (F.col("lo") - F.col("start")).alias("at")), joints


def paths_of(runs: DataFrame, joints: DataFrame, staged: Staged) -> DataFrame:
    """(run, path, skip): the path of each run that another one precedes, and how many windows
    of the path stand before it. A path is named by its first run.

    Each round replaces a run's predecessor by the predecessor's predecessor, so a path of n
    runs takes log2(n) joins. A circle of runs is opened at its smallest one."""
    ends = runs.groupBy("run").agg(
        F.min_by("tail", "at").alias("tail"),
        F.max_by("head", "at").alias("head"),
        F.max(F.col("at") + F.col("n")).alias("size"),
    )
    ends = staged.write(ends, "ends")
    before = ends.join(joints, ends["head"] == joints["node"]).select("head", F.col("run").alias("before"), "size")
    after = ends.select("tail", "run")
    links = staged.write(
        after.join(before, after["tail"] == before["head"]).select("run", "before", F.col("size").alias("skip")), "links"
    )
    while True:
        state = links.select("run", F.col("before").alias("path"), "skip", F.least("run", "before").alias("low"))
        number = links.count()
        length = 1
        while True:
            state = staged.write(state, "state")
            far = state.select(
                F.col("run").alias("path"), F.col("path").alias("beyond"), F.col("skip").alias("more"), F.col("low").alias("lower")
            )
            moving = state.join(far, "path", "left_semi").count()
            if not moving:
                return state.select("run", "path", "skip")
            if length > number:
                break
            state = state.join(far, "path", "left").select(
                "run",
                F.coalesce("beyond", "path").alias("path"),
                (F.col("skip") + F.coalesce("more", F.lit(0))).alias("skip"),
                F.least("low", F.coalesce("lower", "low")).alias("low"),
            )
            length *= 2
        # what still moves after so many steps goes round in circles, all of whose runs it has seen
        turning = state.join(far, "path", "left_semi")
        lows = turning.groupBy("low").agg(F.lit(1).alias("one"))
        links = staged.write(links.join(lows, links["run"] == lows["low"], "left_anti"), "links")


def repeated_paths(texts: DataFrame, found: DataFrame, staged: Staged, length: int) -> DataFrame:
    """(core, phrase, i, n, doc, path, at): windows i .. i + n - 1 of a phrase are those of `path`
    from `at` on, and stand first in document `doc`."""
    first = F.min(F.struct("doc", "row", "lo", "n")).alias("first")
    known = found.where(F.col("kind") != LATE).groupBy("core", "phrase")
    known = known.agg(first, F.max("doc").alias("hi"), F.max("mixed").alias("mixed"), F.max(F.col("kind") == HOT).alias("hot"))
    known = known.where(F.col("mixed") | (F.col("first.doc") < F.col("hi")))
    known = known.select("core", "phrase", "hi", "mixed", "hot", "first.*")
    opened = staged.write(opened_phrases(texts, known, length), "opened")
    parts = staged.write(parts_of(opened), "parts")
    staged.drop(opened)
    pieces = parts.where("owner = phrase").select("core", "phrase", F.col("i").alias("begin"), "tail", "head", "doc", "row", "lo", "n")
    runs, joints = runs_of(pieces, staged)
    runs = staged.write(runs, "runs")
    paths = paths_of(runs, joints, staged)
    placed = runs.join(paths, "run", "left").select(
        "core",
        F.col("phrase").alias("owner"),
        "begin",
        F.col("n").alias("size"),
        "doc",
        F.coalesce("path", "run").alias("path"),
        (F.col("at") + F.coalesce("skip", F.lit(0))).alias("offset"),
    )
    held = parts.select("core", "phrase", "i", "n", "owner", F.col("at").alias("inner")).join(placed, ["core", "owner"])
    inside = (F.col("inner") >= F.col("begin")) & (F.col("inner") < F.col("begin") + F.col("size"))
    return held.where(inside).select(
        "core", "phrase", "i", "n", "doc", "path", (F.col("offset") + F.col("inner") - F.col("begin")).alias("at")
    )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce("doc_id", F.lit(int(LAST))).alias("doc"),
        F.xxhash64("doc_id", "text").alias("row"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"),
    )


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, row, spans): the windows of each text that start in a smaller document too, as
    structs (lo, n): n windows from word lo on. `row` is a hash of doc_id and text."""
    staged, texts = Tidy(docs.sparkSession), _texts(docs)
    found = staged.write(shared_places(places(texts, length, hot_cores(texts, length))), "places")
    parts = staged.write(repeated_paths(texts, found, staged, length), "spans")
    open_, late = found.where(F.col("kind") != LATE), found.where(F.col("kind") == LATE)
    mapped = open_.select("core", "phrase", F.col("doc").alias("own"), "row", "lo").join(
        parts.select("core", "phrase", "i", F.col("n").alias("size"), F.col("doc").alias("source")), ["core", "phrase"]
    )
    gone = mapped.where("source < own").select(
        F.col("own").alias("doc"), "row", (F.col("lo") + F.col("i")).alias("lo"), F.col("size").cast("int").alias("n")
    )
    spans = gone.unionAll(late.select("doc", "row", "lo", "n"))
    return spans.groupBy("doc", "row").agg(F.sort_array(F.collect_set(F.struct("lo", "n"))).alias("spans"))


def cut(data: bytes, lo: np.ndarray, n: np.ndarray, length: int) -> tuple[str, int, list[tuple[int, int]]]:
    """The words that no window covers, joined by blanks; how many words there were; and the
    stretches (start, words) that went."""
    ends = np.maximum.accumulate(lo + n + length - 1) if len(lo) else lo
    new = np.append(True, lo[1:] > ends[:-1]) if len(lo) else np.zeros(0, bool)
    starts = lo[new]
    ends = ends[np.append(np.flatnonzero(new)[1:], len(lo)) - 1] if len(lo) else ends
    kept, total = [], 0
    for first, words in word_chunks(data, 0):
        total = first + len(words)
        if len(starts):
            number = np.arange(first, total)
            open_ = np.searchsorted(starts, number, "right") == np.searchsorted(ends, number, "right")
            words = compress(words, open_.tolist())
        if part := b" ".join(words):
            kept.append(part)
    return b" ".join(kept).decode(), total, list(zip(starts.tolist(), (ends - starts).tolist(), strict=True))


SPANS = "array<struct<start: bigint, words: bigint>>"


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of every row of `docs` (doc_id, text).

    A word goes if a window of `length` words around it also starts in a row of smaller doc_id;
    windows are judged on the input and never cross rows. `spans` are the stretches of words
    that went, `kept` the other words joined by blanks. Null and blank texts have no words.
    Rows that share a doc_id are texts of one document and lose nothing to each other; rows
    without an id come after all others and lose nothing to each other either; equal rows fare
    alike. An empty table gives no rows. Other columns are not read. `docs` is read three
    times: write it first if it takes long to compute.
    """
    spans = repeated_spans(docs, length)
    rows = docs.select("doc_id", "text").withColumns(
        {"doc": F.coalesce("doc_id", F.lit(int(LAST))), "row": F.xxhash64("doc_id", "text")}
    )
    joined = rows.join(spans, ["doc", "row"], "left").select("doc_id", "text", "spans")
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())])), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, found in zip(batch.column("text"), batch.column("spans"), strict=True):
                marks = found.values
                lo, n = (np.empty(0, np.int64) if marks is None else marks.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("lo", "n"))
                kept, words, gone = cut((text.as_py() or "").encode(), lo, n, length)
                for column, value in zip(out, (words, sum(x for _, x in gone), [{"start": a, "words": b} for a, b in gone], kept), strict=True):
                    column.append(value)
            arrays = [pa.array(column, kind) for column, kind in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    return joined.mapInArrow(run, f"doc_id bigint, n_words bigint, n_removed bigint, spans {SPANS}, kept string")


def removal_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, from `deduplicate`."""
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
