"""Count of repeated rows without moving whole rows through a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabmeter.table import Table


def row_digest(table: Table) -> list[Column]:
    """128 bits that stand for a row: equal rows have the same, and among a million million
    different rows the chance that any two share them is below one in 10^14. Hashes skip
    NULLs, so where they are is hashed as well."""
    keys = table.keys()
    gaps = [key.isNull() for key in keys]
    return [F.xxhash64(F.lit(seed), *gaps, *keys).alias(f"__digest_{seed}") for seed in (1, 2)]


def row_groups(table: Table, *extra: Column) -> DataFrame:
    """(n, ...) of each different row; `extra` are aggregates that are equal for equal rows.

    Only digests are shuffled, and counted before, so a row that most others repeat costs
    one number a task."""
    digest = row_digest(table)
    names = [f"__digest_{seed}" for seed in (1, 2)]
    rows = table.df.select(*digest, *extra)
    added = [F.max(name).alias(name) for name in rows.columns if name not in names]
    return rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"), *added)


def duplicate_count(source: DataFrame | Table) -> int:
    """Rows which equal an earlier row; missing equals missing."""
    return duplicate_rows(source).first()["duplicate_rows"]


def duplicate_rows(source: DataFrame | Table) -> DataFrame:
    """One row (row_count, distinct_rows, duplicate_rows), as one lazy query."""
    return (
        row_groups(Table.of(source))
        .agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("distinct_rows"))
        .withColumn("duplicate_rows", F.col("row_count") - F.col("distinct_rows"))
    )
