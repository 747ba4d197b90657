"""Column statistics, dataset summary and missing-value map."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabmeter.functions.columns import count_true, finite, pct, ref, row_key, total
from tabmeter.functions.moments import kurtosis_g2, sample_std, skewness_g1
from tabmeter.operators.common import moments
from tabmeter.operators.completeness import column_nulls
from tabmeter.operators.correlation import coefficients, varying
from tabmeter.operators.duplicates import duplicate_count, row_groups
from tabmeter.operators.median import medians
from tabmeter.operators.values import distinct_counts, top_values, value_summary
from tabmeter.plans.staging import staged
from tabmeter.plans.statpass import Probe, per_column, run_probes
from tabmeter.result import share
from tabmeter.table import Table

MB = 1024**2
# Bytes per value of the fixed-width types.
WIDTHS = {
    "boolean": 1,
    "tinyint": 1,
    "smallint": 2,
    "int": 4,
    "bigint": 8,
    "float": 4,
    "double": 8,
    "date": 4,
    "timestamp": 8,
    "timestamp_ntz": 8,
}


def _measured(table: Table) -> list[str]:
    """Columns with numeric statistics; unlike elsewhere booleans are included."""
    kinds = (T.NumericType, T.BooleanType)
    return [c for c, t in table.types.items() if isinstance(t, kinds)]


def _number(table: Table, column: str) -> Column:
    if isinstance(table.types[column], T.BooleanType):
        return ref(column).cast("int").cast("double")
    return table.number(column)


def numeric_stats(source: DataFrame | Table, columns: list[str] | None = None) -> DataFrame:
    """(column, mean, std, min, max, skewness, kurtosis, zeros_count, zeros_pct)."""
    table = Table.of(source)
    columns = _measured(table) if columns is None else columns

    def build(name: str) -> list[Column]:
        value = _number(table, name)
        return [
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("mean"),
            sample_std(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            skewness_g1(value).alias("skewness"),
            kurtosis_g2(value).alias("kurtosis"),
            F.count_if(value == 0).alias("zeros_count"),
        ]

    found = per_column(table.df, columns, build, fields=19)
    shape = ("mean", "std", "min", "max", "skewness", "kurtosis")
    return found.select(
        "column",
        *[finite(F.col(c)).alias(c) for c in shape],
        "zeros_count",
        pct(F.col("zeros_count"), F.col("n")).alias("zeros_pct"),
    )


def missing_map(source: DataFrame | Table) -> DataFrame:
    """(column, ordinal, null_pct), most missing first."""
    nulls = column_nulls(source).select("column", "ordinal", "null_pct")
    return nulls.orderBy(F.desc("null_pct"), "ordinal")


def top_missing(source: DataFrame | Table, most: int = 30) -> DataFrame:
    """(column, null_count, null_pct, status) of the columns most often missing."""
    status = (
        F.when(F.col("null_pct") >= 50, "Critical")
        .when(F.col("null_pct") >= 20, "Warning")
        .otherwise("OK")
    )
    gaps = column_nulls(source).where("null_pct > 0").orderBy(F.desc("null_pct"), "ordinal")
    return gaps.limit(most).select("column", "null_count", "null_pct", status.alias("status"))


def payload_bytes(table: Table) -> Column:
    """Bytes of the values themselves, as an aggregate."""
    fixed, variable = 0, []
    for name, dtype in table.types.items():
        width = WIDTHS.get(dtype.simpleString())
        if isinstance(dtype, T.DecimalType):
            width = 16
        if width is not None:
            fixed += width
            continue
        text = row_key(ref(name), dtype)
        if not isinstance(dtype, T.BinaryType):
            text = text.cast("string")
        variable.append(F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"))
    return F.sum(total([F.lit(fixed).cast("bigint"), *variable]))


def dataset_summary(source: DataFrame | Table) -> dict[str, Any]:
    """Size, repeated rows and missing cells of a table."""
    table = Table.of(source)
    stats = run_probes(table.df, _summary_probes(table))
    rows, width = int(stats["rows"]), len(table.columns)
    gaps = sum(int(stats["nulls", c]) for c in table.columns)
    return {
        "row_count": rows,
        "column_count": width,
        "memory_usage_mb": round((stats["bytes"] or 0) / MB, 2),
        "duplicate_row_count": duplicate_count(table),
        "total_missing_cells": gaps,
        "missing_cell_pct": share(gaps, rows * width),
        "columns": table.columns,
    }


def summary_frame(source: DataFrame | Table) -> DataFrame:
    """The dataset summary as one row, without the size estimate.

    All of it comes from one grouping of row digests: a group of n equal rows
    counts n rows, n - 1 duplicates, and n times its missing cells.
    """
    table = Table.of(source)
    width = len(table.columns)
    gaps = count_true([ref(c).isNull() for c in table.columns]).cast("bigint")
    totals = row_groups(table, gaps.alias("__gaps")).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"),
        F.lit(width).cast("bigint").alias("column_count"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_row_count"),
        F.coalesce(F.sum(F.col("__n") * F.col("__gaps")), F.lit(0)).alias("total_missing_cells"),
    )
    return totals.withColumn(
        "missing_cell_pct", pct(F.col("total_missing_cells"), F.col("row_count") * width)
    )


def type_counts(source: DataFrame | Table) -> dict[str, int]:
    table = Table.of(source)
    return {
        "numeric_col_count": len(table.numeric),
        "categorical_col_count": len(table.texts),
        "datetime_col_count": len(table.datetimes),
    }


def _summary_probes(table: Table) -> list[Probe]:
    return [
        Probe("rows", F.count(F.lit(1))),
        *(Probe(("nulls", c), F.count_if(ref(c).isNull())) for c in table.columns),
        Probe("bytes", payload_bytes(table), 1),
    ]


def profile(
    source: DataFrame | Table, rsd: float | None = None, *, materialize: bool = False
) -> dict[str, Any]:
    """Statistics of every column and of the table as nested dictionaries.

    What is collected grows with the number of columns only. `rsd` accepts
    approximate distinct counts of that relative deviation. `materialize` first
    writes the table to the shared folder: use it where the table is costly to
    compute, as the passes read it several times.
    """
    table = Table.of(source)
    if materialize:
        with staged(table.df) as df:
            return profile(Table.of(df, **table.date_options), rsd)
    stats = run_probes(
        table.df,
        [
            *_summary_probes(table),
            *(p for c in table.numeric for p in moments(table, c)),
        ],
    )
    rows, width = int(stats["rows"]), len(table.columns)
    unique, tops = _values(table, rsd)
    measured = _measured(table)
    shapes = {r["column"]: r.asDict() for r in numeric_stats(table).collect()} if measured else {}
    middles = medians_of(table, measured)
    columns = {}
    for name in table.columns:
        gaps = int(stats["nulls", name])
        info: dict[str, Any] = {
            "null_count": gaps,
            "null_pct": share(gaps, rows),
            "unique_count": unique[name],
            "cardinality_ratio": round(unique[name] / rows, 4) if rows else 0.0,
        }
        if name in shapes:
            shape = shapes[name]
            info |= {k: shape[k] for k in ("mean", "std", "min", "max")}
            info["median"] = middles[name]
            info |= {k: shape[k] for k in ("skewness", "kurtosis", "zeros_count", "zeros_pct")}
        else:
            info["top_values"] = tops.get(name, {})
        columns[name] = info

    repeats = duplicate_count(table)
    cells = rows * width
    gaps = sum(info["null_count"] for info in columns.values())
    by_gaps = sorted(columns, key=lambda c: -columns[c]["null_count"])
    return {
        "row_count": rows,
        "column_count": width,
        "total_cells": cells,
        "total_missing_cells": gaps,
        "overall_missing_pct": share(gaps, cells),
        "duplicate_rows": repeats,
        "duplicate_pct": share(repeats, rows),
        "memory_mb": round((stats["bytes"] or 0) / MB, 2),
        "columns": columns,
        "missing_map": {c: columns[c]["null_pct"] for c in by_gaps},
        "correlation_matrix": _matrix(table, stats),
        **type_counts(table),
    }


def _values(table: Table, rsd: float | None) -> tuple[dict[str, int], dict[str, dict[str, int]]]:
    """The number of distinct values and the most frequent values by column."""
    if rsd is None:
        rows = value_summary(table).collect()
    else:
        rows = [*distinct_counts(table, rsd=rsd).collect(), *top_values(table).collect()]
    unique, tops = {}, {}
    for r in sorted(rows, key=lambda r: r.asDict().get("rank") or 0):
        if r.asDict().get("rank"):
            tops.setdefault(r["column"], {})[r["value"]] = r["n"]
        else:
            unique[r["column"]] = r["unique_count"]
    return unique, tops


def medians_of(table: Table, measured: list[str]) -> dict:
    """Medians of numbers, and of booleans as 0 and 1."""
    as_numbers = table.df.select(*[_number(table, c).alias(c) for c in measured])
    if not measured:
        return {}
    found = medians(as_numbers, measured)
    safe = {c: v for c, v in found.items() if v is not None and abs(v) != float("inf")}
    return {c: round(safe[c], 4) if c in safe else None for c in measured}


def _matrix(table: Table, stats: dict) -> dict[str, dict[str, float | None]]:
    """r by column and row; empty for fewer than two numeric columns."""
    names = table.numeric
    if len(names) < 2:
        return {}
    found, live = coefficients(table, names, stats), varying(names, stats)

    def cell(a: int, b: int) -> float | None:
        if a == b:
            return 1.0 if names[a] in live else None
        r = found.get((names[min(a, b)], names[max(a, b)]))
        return None if r is None else round(r, 4)

    span = range(len(names))
    return {names[b]: {names[a]: cell(a, b) for a in span} for b in span}

