"""Exact medians of many columns in bounded memory, and sketched ones.

An exact percentile keeps every distinct value of a column in one task. Here the search
is narrowed by counting instead. A double is read as the 64-bit integer of the same order;
the integers between two bounds are counted by the leading 12 bits in which the bounds
differ, the bucket that holds the wanted rank becomes the next range, and this repeats until
one value is left. A pass settles 12 bits or more, so six passes are enough for values of any
size or shape. Only counts, one for each bucket, are shuffled, and they are combined before.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tabmeter.table import Table

# Tasks receive these functions themselves and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 12
FIRST, LAST = -(1 << 63), (1 << 63) - 1
COUNTS_SCHEMA = "search int, bucket int, n bigint, low bigint, high bigint"
# Tasks whose sketches are merged before those of all groups are.
GROUP = 256
MIN_K, MAX_K = 8, 65535


def ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order; the bits of negative ones are flipped."""
    bits = np.ascontiguousarray(values, np.float64).view(np.int64)
    return bits ^ ((bits >> 63) & LAST)


def unordered(number: int) -> float:
    bits = np.array([number], np.int64)
    return float((bits ^ ((bits >> 63) & LAST)).view(np.float64)[0])


@dataclass(frozen=True)
class Range:
    """The values of a column from `low` to `high`, as ordered integers."""

    column: str
    low: int = FIRST
    high: int = LAST

    @property
    def shift(self) -> int:
        """Buckets are what is left of a value without so many low bits."""
        differing = ((self.low ^ self.high) & ((1 << 64) - 1)).bit_length()
        return max(0, differing - BITS)


def count_batches(batches: Iterator[pa.RecordBatch], ranges: list[Range]) -> Iterator[pa.RecordBatch]:
    """COUNTS_SCHEMA rows of one task: how many values of each range are in each of its buckets,
    the smallest and the largest of them."""
    size = (1 << BITS) + 1
    found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        values: dict[str, np.ndarray] = {}
        for number, own in enumerate(ranges):
            if own.column not in values:
                column = batch.column(own.column).to_numpy(zero_copy_only=False)
                values[own.column] = ordered(column[~np.isnan(column)])
            inside = values[own.column]
            if (own.low, own.high) != (FIRST, LAST):
                inside = inside[(inside >= own.low) & (inside <= own.high)]
            if not len(inside):
                continue
            if number not in found:
                found[number] = np.zeros(size, np.int64), np.full(size, LAST), np.full(size, FIRST)
            n, low, high = found[number]
            bucket = (inside >> own.shift) - (own.low >> own.shift)
            n += np.bincount(bucket, minlength=size)
            np.minimum.at(low, bucket, inside)
            np.maximum.at(high, bucket, inside)
    for number, (n, low, high) in found.items():
        used = np.flatnonzero(n)
        search = np.full(len(used), number)
        arrays = [pa.array(search, pa.int32()), pa.array(used, pa.int32()), *(pa.array(x[used]) for x in (n, low, high))]
        yield pa.RecordBatch.from_arrays(arrays, ["search", "bucket", "n", "low", "high"])


def count_ranges(values: DataFrame, ranges: list[Range]) -> list[list[tuple[int, int, int, int]]]:
    """One pass: (bucket, n, low, high) of every range, in order."""
    names = dict.fromkeys(r.column for r in ranges)
    partial = values.select(*names).mapInArrow(lambda batches: count_batches(batches, ranges), COUNTS_SCHEMA)
    counted = partial.groupBy("search", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in ranges]
    for row in counted.collect():  # as many rows as buckets at most
        found[row["search"]].append((row["bucket"], row["n"], row["low"], row["high"]))
    return [sorted(rows) for rows in found]


def medians(source: DataFrame | Table, columns: list[str]) -> dict:
    """Median by column; None for a column without values."""
    table = Table.of(source)
    names = {c: f"v{i}" for i, c in enumerate(columns)}
    values = table.df.select(*[table.number(c).alias(name) for c, name in names.items()])
    # of each column the wanted ranks, each with the range and the place in it where it is
    open_: dict[tuple[str, int], tuple[Range, int]] = {}
    for rows, name in zip(count_ranges(values, [Range(n) for n in names.values()]) if columns else [], names.values(), strict=True):
        n = sum(row[1] for row in rows)
        for rank in {(n - 1) // 2, n // 2} if n else ():
            open_[name, rank] = _narrowed(name, rows, rank)
    while wide := list(dict.fromkeys(r for r, _ in open_.values() if r.low < r.high)):
        counts = dict(zip(wide, count_ranges(values, wide), strict=True))
        for key, (own, place) in open_.items():
            if own in counts:
                open_[key] = _narrowed(own.column, counts[own], place)
    result: dict = {}
    for column, name in names.items():
        found = [unordered(own.low) for (c, _), (own, _) in open_.items() if c == name]
        result[column] = sum(found) / len(found) if found else None
    return result


def _narrowed(column: str, rows: list[tuple[int, int, int, int]], place: int) -> tuple[Range, int]:
    """The bucket that holds a place, and the place in it."""
    for _, n, low, high in rows:
        if place < n:
            return Range(column, low, high), place
        place -= n
    raise ValueError("the table changed between two passes")


def median_frame(
    source: DataFrame | Table, columns: list[str] | None = None, accuracy: int | None = None
) -> DataFrame:
    """(column, median) per numeric column; `accuracy` as for `sketched_medians`, which then
    replaces the exact search."""
    table = Table.of(source)
    columns = table.numeric if columns is None else columns
    if accuracy is not None:
        return sketched_medians(table, columns, accuracy)
    found = medians(table, columns)
    rows = [(c, None if found[c] is None else round(found[c], 4)) for c in columns]
    return table.spark.createDataFrame(rows, "column string, median double")


def sketched_medians(source: DataFrame | Table, columns: list[str], accuracy: int) -> DataFrame:
    """(column, median) from one pass of quantile sketches: a value of the column whose rank is
    off by about 2.3 / accuracy of all rows at most (99 times in 100). `accuracy` from 8 to
    65,535 is what a sketch remembers.

    The sketches of GROUP tasks are merged first, then those of the groups, so no task merges
    as many as there are tasks."""
    if not MIN_K <= accuracy <= MAX_K:
        raise ValueError(f"the accuracy of a sketch is from {MIN_K} to {MAX_K}")
    table = Table.of(source)
    names = {c: f"v{i}" for i, c in enumerate(columns)}
    values = table.df.select(
        F.floor(F.spark_partition_id() / GROUP).alias("group"),
        *[table.number(c).alias(name) for c, name in names.items()],
    )

    def merged(name: str) -> Column:
        return F.kll_merge_agg_double(name, accuracy).alias(name)

    groups = values.groupBy("group").agg(*[F.kll_sketch_agg_double(n, accuracy).alias(n) for n in names.values()])
    whole = groups.agg(*[merged(n) for n in names.values()])
    cells = []
    for column, name in names.items():
        middle = F.when(F.kll_sketch_get_n_double(name) > 0, F.kll_sketch_get_quantile_double(name, F.lit(0.5)))
        cells.append(F.struct(F.lit(column).alias("column"), middle.alias("median")))
    if not cells:
        return table.spark.createDataFrame([], "column string, median double")
    return whole.select(F.inline(F.array(*cells)))
