"""Semantic type of every column from its name, type and values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabmeter.functions.columns import pct, ratio, ref
from tabmeter.functions.dates import is_datetime
from tabmeter.operators.values import SAMPLE, distinct_counts, value_summary
from tabmeter.plans.staging import staged
from tabmeter.plans.statpass import per_column
from tabmeter.table import Table

# Patterns of lower-case column names, and the limits.
DATE_NAME = r"(date|time|timestamp|created|updated|shipped|order_date|ship)"
ID_NAME = r"(\bid\b|_id$|^id_)"
TEXT_NAME = r"email|phone|mobile|tel"
PARSE_RATE = 0.8
ID_CARDINALITY = 0.8
TEXT_CARDINALITY = 0.5
TEXT_VALUES = 100
SEMANTIC_TYPES = ("numeric", "categorical", "datetime", "boolean", "text", "id")


def classify_columns(source: DataFrame | Table, unique: DataFrame | None = None) -> DataFrame:
    """(column, ordinal, semantic_type, spark_type, null_count, null_pct,
    unique_count, cardinality_ratio) per column.

    Dates are recognised by the share of all values that parse. `unique` has the distinct
    counts (ordinal, unique_count), where they are known.
    """
    table = Table.of(source)

    def build(name: str) -> list[Column]:
        dtype, value = table.types[name], ref(name)
        numeric = isinstance(dtype, (T.NumericType, T.BooleanType))
        # Values other than 0 and 1; text is neither.
        other = ~value.cast("double").isin(0.0, 1.0) if numeric else value.isNotNull()
        return [
            F.lit(table.ordinal(name)).alias("ordinal"),
            F.lit(dtype.simpleString()).alias("spark_type"),
            F.lit(_kind(dtype)).alias("kind"),
            F.count(F.lit(1)).alias("n"),
            F.count(value).alias("present"),
            F.count(table.instant(name)).alias("parsed"),
            F.count_if(other).alias("not_binary"),
        ]

    counted = per_column(table.df, table.columns, build, fields=4)
    if unique is None:
        unique = distinct_counts(table).select("ordinal", "unique_count")
    # Both sides have one row per column.
    joined = counted.join(unique, "ordinal").withColumn(
        "cardinality_ratio", ratio(F.col("unique_count"), F.col("n"))
    )
    nulls = F.col("n") - F.col("present")
    return joined.select(
        "column",
        "ordinal",
        _semantic_type().alias("semantic_type"),
        "spark_type",
        nulls.alias("null_count"),
        pct(nulls, F.col("n")).alias("null_pct"),
        "unique_count",
        "cardinality_ratio",
    )


def _kind(dtype: T.DataType) -> str:
    if is_datetime(dtype):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "number"
    return "string" if isinstance(dtype, T.StringType) else "other"


def _semantic_type() -> Column:
    """The first rule that applies decides."""
    name, kind = F.lower("column"), F.col("kind")
    parse_rate = F.try_divide(F.col("parsed"), F.col("present"))
    parses = F.coalesce(parse_rate >= PARSE_RATE, F.lit(False)) & (kind != "boolean")
    binary = (F.col("unique_count") <= 2) & (F.col("not_binary") == 0)
    key = name.rlike(ID_NAME) & (F.col("cardinality_ratio") > ID_CARDINALITY)
    wordy = (F.col("cardinality_ratio") > TEXT_CARDINALITY) & (F.col("unique_count") > TEXT_VALUES)
    return (
        F.when(name.rlike(DATE_NAME) & parses, "datetime")
        .when(kind == "datetime", "datetime")
        .when((kind == "boolean") | binary, "boolean")
        .when((kind == "number") & key, "id")
        .when(kind == "number", "numeric")
        .when(kind == "other", "categorical")
        .when(key, "id")
        .when(name.rlike(TEXT_NAME), "text")
        .when(parses, "datetime")
        .when(wordy, "text")
        .otherwise("categorical")
    )


def detect_schema(source: DataFrame | Table, *, materialize: bool = False) -> dict[str, Any]:
    """Descriptor per column, and the columns of each semantic type; `materialize` as for
    `profile`."""
    table = Table.of(source)
    if materialize:
        with staged(table.df) as df:
            return detect_schema(Table.of(df, **table.date_options))
    if not table.columns:
        return {"columns": {}} | {f"{kind}_cols": [] for kind in SEMANTIC_TYPES}
    samples: dict[str, list[str]] = {}
    # a few rows a column
    rows = value_summary(table, SAMPLE, by_count=False).collect()
    for r in sorted((r for r in rows if r["rank"]), key=lambda r: (r["ordinal"], r["rank"])):
        samples.setdefault(r["column"], []).append(r["value"])
    counts = [(r["ordinal"], r["unique_count"]) for r in rows if not r["rank"]]
    unique = table.spark.createDataFrame(counts, "ordinal int, unique_count bigint")
    columns: dict[str, dict] = {}
    for r in sorted(classify_columns(table, unique).collect(), key=lambda r: r["ordinal"]):
        columns[r["column"]] = {
            "dtype": r["semantic_type"],
            "spark_type": r["spark_type"],
            "null_count": r["null_count"],
            "null_pct": r["null_pct"],
            "unique_count": r["unique_count"],
            "cardinality_ratio": r["cardinality_ratio"],
            "sample_values": samples.get(r["column"], []),
        }
    found: dict[str, Any] = {"columns": columns}
    for kind in SEMANTIC_TYPES:
        found[f"{kind}_cols"] = [c for c, info in columns.items() if info["dtype"] == kind]
    return found
