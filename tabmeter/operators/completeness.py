"""Pillar 1: how much of each column and row is filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabmeter.config import Rules
from tabmeter.functions.columns import count_true, pct, quoted, ref
from tabmeter.operators.common import missing, present, row_count
from tabmeter.plans.statpass import Probe, per_column
from tabmeter.result import Outcome, Tally, no_rows, share
from tabmeter.table import Table

# Wording of the findings, and the share of a column that passes.
COLUMN_ISSUE = "{n} column(s) have >{limit}% missing values: {names}{more}"
ROW_ISSUE = "{n} rows ({pct}%) have >50% of their fields missing"
PASSING = 80
# Spark generates no code for a whole stage beyond so many fields.
STAGE_FIELDS = 100


def gap_number(names: list[str]) -> Column:
    """How many of many columns are missing: a tree of sums, which Spark compiles in small
    methods. They are doubles, which need no test for overflow; one text plans it at once."""
    plain = [f"CAST({quoted(c)} IS NULL AS DOUBLE)" for c in names if "$" not in c]
    # The parser puts settings in the place of ${...}, so such names stay out of texts.
    others = [ref(c).isNull().cast("double") for c in names if "$" in c]
    while len(plain) > 1:
        plain = ["(" + " + ".join(plain[i : i + 2]) + ")" for i in range(0, len(plain), 2)]
    sums = [F.expr(text) for text in plain] + others
    while len(sums) > 1:
        sums = [a + b for a, b in zip(sums[::2], sums[1::2])] + sums[len(sums) // 2 * 2 :]
    return sums[0]


def mostly_missing(table: Table) -> Column:
    """Number of rows of which more than half the fields are missing, as an aggregate."""
    names = table.columns
    if len(names) <= STAGE_FIELDS:
        return F.count_if(count_true([ref(c).isNull() for c in names]) * 2 > len(names))
    # count_if would put the test into a projection of its own, compiled as one huge method.
    return F.count(F.when(gap_number(names) * 2 > len(names), 1))


def probes(table: Table, rules: Rules) -> list[Probe]:
    return [
        row_count(),
        *(present(table, c) for c in table.columns),
        Probe("mostly_missing", mostly_missing(table)),
    ]


def assess(table: Table, rules: Rules, stats: dict) -> Outcome:
    rows = stats["rows"]
    if not rows:
        return no_rows()
    critical_at = rules.threshold("completeness", "critical_null_pct")
    warning_at = rules.threshold("completeness", "warning_null_pct")
    sparse = set(rules.column_rules("known_sparse_columns"))

    columns, counted = {}, []
    critical, warning = [], []
    for name in table.columns:
        gaps = missing(stats, name)
        gap_pct = share(gaps, rows)
        filled = max(0.0, 100.0 - gap_pct)
        columns[name] = {"null_count": gaps, "null_pct": gap_pct, "score": round(filled, 2)}
        if name in sparse:
            filled = 100.0
        elif gap_pct >= critical_at:
            critical.append(name)
        elif gap_pct >= warning_at:
            warning.append(name)
        counted.append(filled)

    bad_rows = int(stats["mostly_missing"])
    bad_pct = share(bad_rows, rows)
    mean = sum(counted) / len(counted)

    tally = Tally(sum(s >= PASSING for s in counted), len(counted))
    for names, limit in ((critical, critical_at), (warning, warning_at)):
        if names:
            more = "…" if len(names) > 5 else ""
            tally.issues.append(
                COLUMN_ISSUE.format(n=len(names), limit=limit, names=names[:5], more=more)
            )
    if bad_rows:
        tally.issues.append(ROW_ISSUE.format(n=bad_rows, pct=bad_pct))
    return tally.outcome(
        max(0.0, mean - bad_pct * 0.5),
        {
            "columns": columns,
            "critical_columns": critical,
            "warning_columns": warning,
            "bad_row_count": bad_rows,
            "bad_row_pct": bad_pct,
            "avg_column_score": round(mean, 2),
        },
    )


def column_nulls(source: DataFrame | Table, config: dict | None = None) -> DataFrame:
    """(column, ordinal, null_count, null_pct, score, severity) per column."""
    table, rules = Table.of(source), Rules.of(config)
    critical_at = rules.threshold("completeness", "critical_null_pct")
    warning_at = rules.threshold("completeness", "warning_null_pct")
    sparse = F.col("column").isin(list(rules.column_rules("known_sparse_columns")))
    counts = per_column(
        table.df,
        table.columns,
        lambda c: [
            F.lit(table.ordinal(c)).alias("ordinal"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(ref(c).isNull()).alias("null_count"),
        ],
        fields=2,
    )
    severity = (
        F.when(sparse, "known sparse")
        .when(F.col("null_pct") >= critical_at, "critical")
        .when(F.col("null_pct") >= warning_at, "warning")
        .otherwise("ok")
    )
    return counts.withColumn("null_pct", pct(F.col("null_count"), F.col("n"))).select(
        "column",
        "ordinal",
        "null_count",
        "null_pct",
        F.round(100.0 - F.col("null_pct"), 2).alias("score"),
        severity.alias("severity"),
    )


def bad_rows(source: DataFrame | Table) -> DataFrame:
    """One row: how many rows lack more than half of their fields."""
    table = Table.of(source)
    counts = table.df.agg(
        F.count(F.lit(1)).alias("row_count"),
        mostly_missing(table).alias("bad_row_count"),
    )
    return counts.withColumn("bad_row_pct", pct(F.col("bad_row_count"), F.col("row_count")))
