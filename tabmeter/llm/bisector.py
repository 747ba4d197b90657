"""Centroid clustering by bisector tournaments.

Of two centroids the nearer one to a vector follows from the side of their bisecting
hyperplane on which it lies: with normal 2 (b - a) and threshold |b|^2 - |a|^2, all of
them integers, b is nearer if normal . x - threshold is positive; at zero the smaller
number wins. Normals and thresholds of all pairs are worked out once a round. A vector's
candidates then meet in pairs until one is left, k - 1 tests in all, and only the winner's
distance is worked out, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabmeter.llm.common import Staged
from tabmeter.llm.quantize import SUMS, as_long, floored_means, integers, matrix, sums_batch

SCALE = 1024
DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SEED = 3
CELLS = 1 << 20  # numbers that a step of the tournament holds at a time


class Bisectors:
    """Normals and thresholds of all pairs of centroids: k * k * width integers."""

    def __init__(self, centroids: np.ndarray) -> None:
        size = (centroids * centroids).sum(axis=1)
        self.centroids = centroids
        self.normals = 2 * (centroids[None, :, :] - centroids[:, None, :])
        self.thresholds = size[None, :] - size[:, None]

    def winners(self, vectors: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each row; ties go to the smaller number."""
        if not len(vectors):
            return np.empty(0, np.int64)
        step = max(1, CELLS // (len(self.centroids) * vectors.shape[1]))
        return np.concatenate([self._tournament(vectors[at : at + step]) for at in range(0, len(vectors), step)])

    def _tournament(self, vectors: np.ndarray) -> np.ndarray:
        left = np.broadcast_to(np.arange(len(self.centroids)), (len(vectors), len(self.centroids)))
        while left.shape[1] > 1:
            # numbers grow from left to right, so the first of two is always the smaller
            pairs = left.shape[1] // 2
            low, high = left[:, 0 : 2 * pairs : 2], left[:, 1 : 2 * pairs : 2]
            side = np.einsum("nd,nmd->nm", vectors, self.normals[low, high]) - self.thresholds[low, high]
            left = np.concatenate([np.where(side > 0, high, low), left[:, 2 * pairs :]], axis=1)
        return left[:, 0]


def _sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """SUMS of the vectors nearest to each centroid, a few rows a task."""
    bisectors, (k, width) = Bisectors(centroids), centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            own = matrix(batch.column("ints"), width)
            nearest = bisectors.winners(own)
            counts += np.bincount(nearest, minlength=k)
            np.add.at(sums, nearest, own)
        yield sums_batch(counts, sums)

    return vectors.select("ints").mapInArrow(run, SUMS)


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    bisectors, width = Bisectors(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = matrix(batch.column("ints"), width)
            nearest = bisectors.winners(own)
            gap = own - bisectors.centroids[nearest]
            arrays = [batch.column("vec_id"), pa.array(nearest, pa.int32()), pa.array((gap * gap).sum(axis=1))]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "ints").mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def cluster_vectors(
    embeddings: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    width: int = DIMENSIONS,
    seed: int = SEED,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row
    of `embeddings` (vec_id, embedding).

    Components become floor(scale * x). Centroids start at the vectors with the smallest
    hashes of `seed:vec_id`; each round moves every centroid that has vectors to the floor of
    their mean. Rows go whose vector is null, has not exactly `width` components, holds null or
    non-finite ones, or ones beyond about 2^26 / scale, whose distances a long can't hold. Rows
    that share a vec_id are vectors of their own and start in the order of their components;
    rows without one start last. With fewer rows than `clusters` each starts a centroid.
    Inertias beyond a long are null. An empty table gives no rows. Other columns are not read.

    The driver holds clusters * width numbers, each task clusters^2 * width.
    """
    staged = Staged(embeddings.sparkSession)
    ints = integers(F.col("embedding"), scale).alias("ints")
    whole = embeddings.where(F.size("embedding") == width).select(F.col("vec_id").cast("bigint"), ints)
    vectors = staged.write(whole.where("ints IS NOT NULL"), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(key.asc_nulls_last(), "ints").limit(clusters).select("ints").collect()
    if not first:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    centroids = np.array([row["ints"] for row in first], np.int64)
    for _ in range(rounds):
        moved = floored_means(_sums(vectors, centroids), centroids)
        if np.array_equal(moved, centroids):
            break  # further rounds would change nothing
        centroids = moved
    assigned = staged.write(_assigned(vectors, centroids), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    inertia = {row["cluster"]: int(row["total"]) for row in sums.collect()}
    hashes = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    own = F.array(*[F.lit(as_long(inertia.get(i, 0))).cast("bigint") for i in range(len(centroids))])
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        F.get(own, F.col("cluster")).alias("cluster_inertia"),
        F.lit(as_long(sum(inertia.values()))).cast("bigint").alias("inertia"),
        F.get(F.array(*map(F.lit, hashes)), F.col("cluster")).alias("centroid_sha256"),
    )
