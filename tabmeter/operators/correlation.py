"""Pairwise-complete Pearson correlation.

Each pair needs six sums over the rows in which both values are present. The
values are centred by the column mean first, so the sums stay accurate. Coefficients are worked
out and filtered in Spark, whatever the number of columns.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tabmeter.operators.common import moments
from tabmeter.plans.statpass import Probe, run_probes
from tabmeter.table import Table

# Tasks receive these functions themselves and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Spread below this share of the raw squares is rounding error.
RELATIVE_ZERO = 1e-12
# Pairs in a batch that a task sends.
BATCH_PAIRS = 10_000

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
SUMS_SCHEMA = "i int, j int, " + ", ".join(f"{c} double" for c in SUMS)
R_SCHEMA = "i int, j int, r double"
MATRIX_SCHEMA = "row_column string, row_ordinal int, col_column string, col_ordinal int, r double"


def varying(columns: list[str], stats: dict) -> list[str]:
    """Columns which can correlate with anything: two values or more, some spread."""
    return [c for c in columns if (stats["std", c] or 0.0) > 0.0]


def batch_sums(
    batches: Iterator[pa.RecordBatch], means: np.ndarray, places: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Six sums per pair over the batches of one task, which holds four matrices."""
    width = len(means)
    i, j = np.triu_indices(width, k=1)
    n, s, q, p = (np.zeros((width, width)) for _ in range(4))
    for batch in batches:
        values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        seen = ~np.isnan(values)
        centred = np.where(seen, values - means, 0.0)
        mask = seen.astype("float64")
        n += mask.T @ mask
        s += centred.T @ mask
        q += (centred * centred).T @ mask
        p += centred.T @ centred
    sums = pa.RecordBatch.from_arrays(
        [
            pa.array(places[i], pa.int32()),
            pa.array(places[j], pa.int32()),
            *(pa.array(v) for v in (n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j])),
        ],
        names=["i", "j", *SUMS],
    )
    for start in range(0, sums.num_rows, BATCH_PAIRS):
        yield sums.slice(start, BATCH_PAIRS)


def pair_sums(table: Table, columns: list[str], stats: dict) -> DataFrame:
    """The sums of every pair of varying columns, by their places among the columns.

    Whole Arrow batches are multiplied as matrices where they are read; a task sends one row
    for each pair, and the rows are added up by pair, in the tasks of the shuffle."""
    live = varying(columns, stats)
    means = np.array([stats["mean", c] for c in live])
    places = np.array([columns.index(c) for c in live])
    values = table.df.select(*[table.number(c).alias(f"v{k}") for k, c in enumerate(live)])
    partial = values.mapInArrow(lambda batches: batch_sums(batches, means, places), SUMS_SCHEMA)
    return partial.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])


def pair_coefficients(table: Table, columns: list[str], stats: dict) -> DataFrame:
    """(i, j, r) of every pair of varying columns, by their places, i before j.

    r is NULL where it has no meaning: no common rows, or no spread among them."""
    if len(varying(columns, stats)) < 2:
        return table.spark.createDataFrame([], R_SCHEMA)
    n = F.nullif(F.col("n"), F.lit(0.0))
    sx, sy, sxx, syy, sxy = (F.col(c) for c in SUMS[1:])
    x_spread, y_spread = sxx - sx * sx / n, syy - sy * sy / n
    spread = F.nullif(x_spread * y_spread, F.lit(0.0))
    r = (sxy - sx * sy / n) / F.sqrt(spread)
    some = (x_spread > sxx * RELATIVE_ZERO) & (y_spread > syy * RELATIVE_ZERO)
    sound = F.when(some & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return pair_sums(table, columns, stats).select("i", "j", sound.alias("r"))


def coefficients(
    table: Table, columns: list[str], stats: dict
) -> dict[tuple[str, str], float | None]:
    """r by (earlier column, later column), for a report that lists every pair."""
    found = pair_coefficients(table, columns, stats).collect()
    return {(columns[i], columns[j]): r for i, j, r in found}


def strong_pairs(table: Table, columns: list[str], stats: dict, limit: float) -> DataFrame:
    """(j, i, r): the pairs with |r| at or above the limit, later column first."""
    found = pair_coefficients(table, columns, stats).where(F.abs("r") >= limit)
    return found.select("j", "i", F.abs("r").alias("r"))


def named(columns: list[str], place: str) -> Column:
    """The name of the column at a place."""
    return F.array(*[F.lit(c) for c in columns])[F.col(place)]


def correlation_matrix(source: DataFrame | Table, first: int | None = None) -> DataFrame:
    """(row_column, row_ordinal, col_column, col_ordinal, r) in long form.

    Every cell of the matrix is listed; r is NULL where a column does not vary.
    `first` keeps that many leading columns, as a display of the matrix does.
    """
    table = Table.of(source)
    columns = table.numeric[:first]
    if not columns:
        return table.spark.createDataFrame([], MATRIX_SCHEMA)
    wanted = [Probe("rows", F.count(F.lit(1))), *(p for c in columns for p in moments(table, c))]
    stats = run_probes(table.df, wanted)
    sides = [
        F.struct(F.col(a).alias("row_ordinal"), F.col(b).alias("col_ordinal")) for a, b in ("ij", "ji")
    ]
    found = pair_coefficients(table, columns, stats)
    found = found.select(F.explode(F.array(*sides)).alias("at"), "r").select("at.*", "r")
    varies = F.array(*[F.lit(c in varying(columns, stats)) for c in columns])[F.col("row_ordinal")]
    others = F.sequence(F.lit(0), F.lit(len(columns) - 1))
    cells = table.spark.range(len(columns)).select(
        F.col("id").cast("int").alias("row_ordinal"), F.explode(others).alias("col_ordinal")
    )
    own = F.col("row_ordinal") == F.col("col_ordinal")
    r = F.when(own, F.when(varies, 1.0)).otherwise(F.rint(F.col("r") * 1e4) / 1e4)
    return cells.join(found, ["row_ordinal", "col_ordinal"], "left").select(
        named(columns, "row_ordinal").alias("row_column"),
        "row_ordinal",
        named(columns, "col_ordinal").alias("col_column"),
        "col_ordinal",
        r.alias("r"),
    )
