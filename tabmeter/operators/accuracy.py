"""Pillar 6: outliers per column and over all numeric columns together."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tabmeter.config import Rules
from tabmeter.functions.columns import finite, pct
from tabmeter.operators.common import moments, row_count
from tabmeter.operators.forest import SKIPPED, complete_probe, isolation_forest
from tabmeter.plans.statpass import Probe, run_probes
from tabmeter.result import Outcome, Tally, no_rows, share
from tabmeter.table import Table

# Limits of the checks and wording of the findings.
MIN_VALUES = 10
MAX_OUTLIER_PCT = 5.0
FOREST_SLACK = 1.5
POINTS_PER_OUTLIER_PCT = 5
NO_NUMBERS_TEXT = "No numeric columns found"
COLUMN_ISSUE = "Column '{column}': {n} outliers ({pct}%) detected via Z-score"
FOREST_ISSUE = "Isolation Forest: {n} multi-variate outliers ({pct}%) detected"


def probes(table: Table, rules: Rules) -> list[Probe]:
    if not table.numeric:
        return [row_count()]
    return [
        row_count(),
        *(p for c in table.numeric for p in moments(table, c)),
        complete_probe(table),
    ]


def is_degenerate(stats: dict, column: str) -> bool:
    """Too few values, or no spread to measure a distance in."""
    return stats["present", column] < MIN_VALUES or stats["std", column] in (None, 0.0)


def follow_up(table: Table, rules: Rules, stats: dict) -> list[Probe]:
    """Counts that need the mean and deviation of the first pass."""
    limit = rules.threshold("accuracy", "zscore_threshold")
    wanted = []
    for name in table.numeric:
        mean, std = stats["mean", name], stats["std", name]
        if is_degenerate(stats, name) or not (math.isfinite(mean) and math.isfinite(std)):
            continue
        z = (table.number(name) - mean) / std
        far = F.count_if(F.abs(z) > limit)
        wanted.append(Probe(("outliers", name), far, 1, table.ordinal(name)))
    return wanted


def assess(table: Table, rules: Rules, stats: dict) -> Outcome:
    rows = stats["rows"]
    if not rows:
        return no_rows()
    if not table.numeric:
        return Outcome(100.0, 1, 1, [], {"message": NO_NUMBERS_TEXT})
    limit = rules.threshold("accuracy", "zscore_threshold")
    contamination = rules.threshold("accuracy", "isolation_contamination")
    tally, columns, flagged = Tally(), {}, 0
    for name in table.numeric:
        if is_degenerate(stats, name):
            columns[name] = {"skipped": True}
            tally.check(True)
            continue
        n = int(stats.get(("outliers", name), 0))
        n_pct = share(n, rows)
        flagged += n
        columns[name] = {
            "outlier_count": n,
            "outlier_pct": n_pct,
            "mean": round(stats["mean", name], 4),
            "std": round(stats["std", name], 4),
            "zscore_threshold": limit,
        }
        tally.check(n_pct <= MAX_OUTLIER_PCT, COLUMN_ISSUE.format(column=name, n=n, pct=n_pct))

    complete = int(stats["complete rows"])
    found = isolation_forest(table, contamination, complete)
    forest = {"skipped": True, "reason": SKIPPED} if found is None else found.first().asDict()
    forest_pct = forest.get("outlier_pct", 0)
    tally.check(
        forest_pct <= contamination * 100 * FOREST_SLACK,
        FOREST_ISSUE.format(n=forest.get("outlier_count", 0), pct=forest_pct),
    )
    flagged_pct = share(flagged, rows * len(table.numeric))
    details = {"column_outliers": columns, "isolation_forest": forest}
    return tally.outcome(max(0.0, 100.0 - flagged_pct * POINTS_PER_OUTLIER_PCT), details)


def zscore_outliers(source: DataFrame | Table, config: dict | None = None) -> DataFrame:
    """(column, mean, std, outlier_count, outlier_pct) per numeric column.

    Means and deviations come from a first pass and enter the second as
    literals. Columns too short or without spread have no outlier count.
    """
    table, rules = Table.of(source), Rules.of(config)
    stats = run_probes(table.df, probes(table, rules))
    counted = {p.key[1]: p.expr for p in follow_up(table, rules, stats)}
    found = [
        F.struct(
            F.lit(name).alias("column"),
            finite(F.lit(stats["mean", name]).cast("double")).alias("mean"),
            finite(F.lit(stats["std", name]).cast("double")).alias("std"),
            counted.get(name, F.max(F.lit(None).cast("bigint"))).alias("outlier_count"),
            F.count(F.lit(1)).alias("n"),
        )
        for name in table.numeric
    ]
    result = table.df.agg(F.array(*found).alias("rows")).select(F.inline("rows"))
    share_of_rows = F.when(
        F.col("outlier_count").isNotNull(), pct(F.col("outlier_count"), F.col("n"))
    )
    return result.withColumn("outlier_pct", share_of_rows).drop("n")

