"""Integer vectors, and exact means of groups of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Squares and products of components stay this far from the ends of a long.
PRODUCTS = 1 << 58


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null for a vector that is null or empty, holds a
    null or non-finite component, or one so large that distances would not fit a long."""
    large = F.sqrt(F.lit(float(PRODUCTS)) / F.size(vector))
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    sound = F.forall(scaled, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < large), F.lit(False)))
    return F.when(F.coalesce(sound & (F.size(vector) > 0), F.lit(False)), F.transform(scaled, lambda x: F.floor(x)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of vectors of one width as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


SUMS = "entry int, n bigint, sums array<bigint>"


def sums_batch(counts: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """One task's part of the sums of each entry: its number of vectors and their total."""
    used = np.flatnonzero(counts)
    arrays = [
        pa.array(used, pa.int32()),
        pa.array(counts[used], pa.int64()),
        pa.array([sums[i].tolist() for i in used], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["entry", "n", "sums"])


def floored_means(partial: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The entries (a row each) with those that have vectors replaced by floor(sum / count).

    `partial` has the SUMS of every task. They are added by entry and place, so no task holds
    more than a number of each; the result has as many numbers as the entries have."""
    placed = partial.select("entry", "n", F.posexplode("sums").alias("place", "part"))
    added = placed.groupBy("entry", "place").agg(
        F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")
    )
    moved = entries.copy()
    for row in added.collect():  # one for each component of an entry
        moved[row["entry"], row["place"]] = int(row["total"]) // row["n"]
    return moved


def as_long(total: int | None) -> int | None:
    """A sum, or None where it does not fit a long."""
    return None if total is None or total >= 1 << 63 else int(total)
