"""Many named aggregates over one table, evaluated in one job.

Spark leaves whole-stage code generation once an operator has more than 100
fields, and a generated method that grows too big is never compiled by the JVM.
One huge `agg` is therefore many times slower than a few small ones over the
same columns. The probes are packed, column by column, into aggregates which
stay below that size; each reads only its own columns, and all of them run as
branches of a single job.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

FIELD_BUDGET = 48
# Rows of one shape per column repeat the same code, so more of them fit.
COLUMN_BUDGET = 90


@dataclass(frozen=True)
class Probe:
    """One aggregate: `fields` is the number of its aggregation buffers and
    `anchor` the ordinal of the column it reads (-1: several columns)."""

    key: Hashable
    expr: Column
    fields: int = 1
    anchor: int = -1
    text: bool = False


def pack(items: Sequence, size: Callable[[object], int], budget: int = FIELD_BUDGET) -> list[list]:
    """Split into runs whose sizes add up to no more than the budget."""
    runs: list[list] = []
    room = 0
    for item in items:
        need = size(item)
        if not runs or need > room:
            runs.append([])
            room = budget
        runs[-1].append(item)
        room -= need
    return runs


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def run_probes(df: DataFrame, probes: Iterable[Probe], budget: int = FIELD_BUDGET) -> dict:
    """Value of every probe by key. The result has one row per probe."""
    unique = {p.key: p for p in probes}
    ordered = sorted(unique.values(), key=lambda p: p.anchor)
    if not ordered:
        return {}
    numbers = {p.key: i for i, p in enumerate(ordered)}
    frames = []
    for run in pack(ordered, lambda p: p.fields, budget):
        rows = [
            F.struct(
                F.lit(numbers[p.key]).alias("id"),
                (F.lit(None) if p.text else p.expr).cast("double").alias("number"),
                (p.expr if p.text else F.lit(None)).cast("string").alias("text"),
            )
            for p in run
        ]
        frames.append(df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")))
    values = {}
    for row in union(frames).collect():
        probe = ordered[row["id"]]
        values[probe.key] = row["text"] if probe.text else row["number"]
    return values


def per_column(
    df: DataFrame,
    columns: Sequence[str],
    build: Callable[[str], list[Column]],
    fields: int,
    budget: int = COLUMN_BUDGET,
) -> DataFrame:
    """One row per column, from aggregates packed in the same way. Lazy."""
    frames = []
    for run in pack(columns, lambda _: fields, budget):
        rows = [F.struct(F.lit(c).alias("column"), *build(c)) for c in run]
        frames.append(df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")))
    return union(frames)
