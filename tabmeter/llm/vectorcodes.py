"""Vector codes from codebooks of vector parts, with distances looked up by value.

The vectors of a block have few distinct integers in each dimension. Each block keeps, for
every dimension, the sorted distinct integers (its value dictionary) and the place of each
vector's component in it. To compare the block with a codebook, the squared differences of
every distinct integer to the 16 entries are tabulated once; the distance of a part to an
entry is then a sum of table rows gathered by the components' places. The sums that move
the entries come from counts of (entry, distinct integer) in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabmeter.llm.common import Staged
from tabmeter.llm.quantize import SUMS, floored_means, integers, matrix, sums_batch

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK = 1 << 12  # vectors that share dictionaries; their places fit 16 bits
SALTS = 32


class Block:
    """Up to BLOCK vectors: distinct integers of each dimension, and places in them."""

    def __init__(self, values: list[np.ndarray], places: np.ndarray) -> None:
        self.values, self.places = values, places  # places: a row for each dimension

    @classmethod
    def of(cls, vectors: np.ndarray) -> Block:
        found = [np.unique(column, return_inverse=True) for column in vectors.T]
        return cls([v for v, _ in found], np.array([p for _, p in found], np.uint16))

    @classmethod
    def read(cls, sizes: list[int], values: bytes, places: bytes) -> Block:
        whole = np.frombuffer(values, "<i8")
        return cls(np.split(whole, np.cumsum(sizes)[:-1]), np.frombuffer(places, "<u2").reshape(len(sizes), -1))

    def written(self) -> tuple[list[int], bytes, bytes]:
        return [len(v) for v in self.values], np.concatenate(self.values).astype("<i8").tobytes(), self.places.astype("<u2").tobytes()

    def nearest(self, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, distance) of each part (rows) of each vector (columns); ties go to the lower
        entry. `codebooks`: parts, entries, components."""
        parts, entries, width = codebooks.shape
        n = self.places.shape[1]
        chosen, least = np.empty((parts, n), np.int64), np.empty((parts, n), np.int64)
        for part in range(parts):
            distance = np.zeros((n, entries), np.int64)
            for i in range(width):
                dimension = part * width + i
                table = (self.values[dimension][:, None] - codebooks[part, :, i][None, :]) ** 2
                distance += table[self.places[dimension]]
            chosen[part] = distance.argmin(axis=1)
            least[part] = distance.min(axis=1)
        return chosen, least

    def sums(self, chosen: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """(count, sum) of the parts of each entry, from counts of the distinct integers."""
        parts, width = len(chosen), len(self.values) // len(chosen)
        counts = np.array([np.bincount(own, minlength=entries) for own in chosen])
        sums = np.empty((parts, entries, width), np.int64)
        for part, own in enumerate(chosen):
            for i in range(width):
                values = self.values[part * width + i]
                cells = np.bincount(own * len(values) + self.places[part * width + i], minlength=entries * len(values))
                sums[part, :, i] = cells.reshape(entries, -1) @ values
        return counts, sums


def blocks(vectors: DataFrame, width: int) -> DataFrame:
    """(ids, labels, sizes, data, places): the blocks of a table (vec_id, label, ints)."""
    kind = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ids", "labels", "sizes", "data", "places"]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                sizes, values, places = Block.of(matrix(own.column("ints"), width)).written()
                ends = pa.array([0, own.num_rows], pa.int32())
                ids, labels = (pa.ListArray.from_arrays(ends, own.column(x)) for x in ("vec_id", "label"))
                arrays = [ids, labels, pa.array([sizes], pa.list_(pa.int32())), pa.array([values]), pa.array([places])]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return vectors.mapInArrow(
        run, f"ids array<bigint>, labels array<{kind}>, sizes array<int>, data binary, places binary"
    )


def _read(batch: pa.RecordBatch) -> Iterator[Block]:
    columns = (batch.column(x).to_pylist() for x in ("sizes", "data", "places"))
    return (Block.read(*row) for row in zip(*columns, strict=True))


def _sums(packed: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """SUMS of the parts nearest to each entry; entries are numbered over all parts."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for block in _read(batch):
                own = block.sums(block.nearest(codebooks)[0], entries)
                counts += own[0]
                sums += own[1]
        yield sums_batch(counts.ravel(), sums.reshape(parts * entries, width))

    return packed.select("sizes", "data", "places").mapInArrow(run, SUMS)


def _coded(packed: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    kind = packed.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in enumerate(_read(batch)):
                chosen, least = block.nearest(codebooks)
                codes = [bytes(row).hex() for row in chosen.T.astype(np.uint8)]
                ids, labels = (batch.column(x).slice(at, 1).flatten() for x in ("ids", "labels"))
                arrays = [ids, labels, pa.array(codes, pa.string()), pa.array(least.sum(axis=0))]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "label", "code", "error"])

    return packed.mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint")


def common_width(vectors: DataFrame, parts: int) -> int | None:
    """The length that most vectors have, of those that can be cut into the parts."""
    counted = vectors.groupBy(F.size("ints").alias("width")).count().where(F.col("width") % parts == 0)
    first = counted.orderBy(F.desc("count"), "width").first()
    return None if first is None else first["width"]


def compress(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """The table (vec_id, label, code, error) of `embeddings` (vec_id, embedding, label), and
    the codebooks that its codes refer to (parts, entries, components).

    Components become floor(scale * x). The codebooks start with the parts of the first vectors
    by vec_id; each round moves every entry that has parts to the floor of their mean, ties go
    to the lower entry. Rows go whose vector is null, holds null or non-finite components or
    ones beyond about 2^26 / scale (whose distances a long can't hold), or has another length
    than most (a multiple of `parts`). Rows that share a vec_id are vectors of their own, in the
    order of their components; rows without one come last. With fewer rows than `entries` there
    are as many entries as rows; entries are 256 at most, a code holds a byte a part. An empty
    table gives no rows and no codebooks. Other columns are not read.

    The driver holds the codebooks; a task holds one block of vectors at a time.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have a byte a part: 1 to 256 entries")
    spark = embeddings.sparkSession
    staged = Staged(spark)
    ints = integers(F.col("embedding"), scale).alias("ints")
    whole = embeddings.select(F.col("vec_id").cast("bigint"), "label", ints).where("ints IS NOT NULL")
    vectors = staged.write(whole, "vectors")
    width = common_width(vectors, parts)
    if width is None:
        kind = embeddings.schema["label"].dataType.simpleString()
        empty = spark.createDataFrame([], f"vec_id bigint, label {kind}, code string, error bigint")
        return empty, np.empty((parts, 0, 0), np.int64)
    vectors = vectors.where(F.size("ints") == width)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    start = np.array([row["ints"] for row in first], np.int64)
    codebooks = start.reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    packed = staged.write(blocks(vectors, width), "blocks")
    for _ in range(rounds):
        flat = codebooks.reshape(-1, width // parts)
        moved = floored_means(_sums(packed, codebooks), flat).reshape(codebooks.shape)
        if np.array_equal(moved, codebooks):
            break  # further rounds would change nothing
        codebooks = moved
    return staged.write(_coded(packed, codebooks), "coded"), codebooks


def compression_report(embeddings: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the rows that `compress` keeps.

    label_error adds up the errors of equal labels, nulls together; it is null beyond a long. A
    label may hold most rows: errors are added before the shuffle, and the sums are joined by
    label and salt, so such rows are spread over many tasks."""
    coded, codebooks = compress(embeddings)
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    same = rows["label"].eqNullSafe(salted["label"]) & (rows["salt"] == salted["salt"])
    return rows.join(salted, same, "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
