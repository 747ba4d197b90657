"""Pillar 7: is the table fit to train a model on?"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tabmeter.config import Rules
from tabmeter.functions.columns import ratio, ref
from tabmeter.functions.moments import sample_std, skewness_from_sums, skewness_g1
from tabmeter.operators.common import moments, row_count
from tabmeter.operators.correlation import named, strong_pairs
from tabmeter.plans.statpass import Probe, per_column, run_probes
from tabmeter.result import Outcome, Tally, no_rows
from tabmeter.table import Table

# Limits of the checks, what the details list, and wording of the findings.
MIN_FEATURES = 5
MIN_VALUES = 10
PAIRS_LISTED = 10
FEATURE_ISSUE = "Only {n} numeric feature columns available for ML (minimum: 5)"
VARIANCE_ISSUE = "{n} zero-variance columns (useless for ML): {names}"
PAIR_ISSUE = (
    "{n} feature pairs with correlation ≥ {limit} (multicollinearity risk). Top: {top}"
)
SKEW_ISSUE = (
    "{n} column(s) with extreme skewness (>{limit}): {names} — recommend log/power transform"
)
LEAKAGE_ISSUE = (
    "Potential data leakage: columns {names} may directly encode the target. "
    "Review before training."
)
BALANCE_ISSUE = (
    "Target '{target}' is imbalanced — minority class ratio: {ratio:.1%} "
    "(threshold: {limit:.1%}). Consider SMOTE or class weighting."
)
ONE_CLASS_NOTE = "Only one class present — target may be a regression variable"


def features(table: Table, rules: Rules) -> list[str]:
    """Numeric columns that are neither an ID nor the target."""
    return [c for c in table.numeric if c not in rules.id_columns and c != rules.target]


def probes(table: Table, rules: Rules) -> list[Probe]:
    return [row_count(), *(p for c in features(table, rules) for p in moments(table, c))]


def follow_up(table: Table, rules: Rules, stats: dict) -> list[Probe]:
    """Centred cubes for the skewness."""
    wanted = []
    for name in features(table, rules):
        mean = stats["mean", name]
        if stats["present", name] < MIN_VALUES or not math.isfinite(mean):
            continue
        centred = table.number(name) - mean
        cubes = F.sum(centred * centred * centred)
        wanted.append(Probe(("cubes", name), cubes, 1, table.ordinal(name)))
    return wanted


def skewness(stats: dict, column: str) -> float | None:
    n, cubes = stats["present", column], stats.get(("cubes", column))
    if cubes is None or not math.isfinite(cubes):
        return None
    return skewness_from_sums(n, (n - 1) * stats["std", column] ** 2, cubes)


def high_pairs(
    table: Table, names: list[str], stats: dict, limit: float
) -> tuple[int, list[tuple[str, str, float]]]:
    """How many pairs are strong, and the first of them in column order: (later column,
    earlier column, |r|)."""
    listed = F.slice(F.array_sort(F.collect_list(F.struct("j", "i", "r"))), 1, PAIRS_LISTED)
    n, top = strong_pairs(table, names, stats, limit).agg(F.count(F.lit(1)), listed).first()
    return n, [(names[j], names[i], round(r, 3)) for j, i, r in top]


def class_counts(source: DataFrame | Table, target: str) -> DataFrame:
    """(value, n) of each present class."""
    table = Table.of(source)
    counted = table.df.where(ref(target).isNotNull()).groupBy(ref(target).alias("value"))
    return counted.agg(F.count(F.lit(1)).alias("n"))


def class_balance(source: DataFrame | Table, target: str) -> DataFrame:
    """One row (class_count, minority_count, row_count, minority_class_ratio)."""
    totals = class_counts(source, target).agg(
        F.count(F.lit(1)).alias("class_count"),
        F.min("n").alias("minority_count"),
        F.sum("n").alias("row_count"),
    )
    return totals.withColumn(
        "minority_class_ratio", ratio(F.col("minority_count"), F.col("row_count"))
    )


def assess(table: Table, rules: Rules, stats: dict) -> Outcome:
    if not stats["rows"]:
        return no_rows()
    names = features(table, rules)
    tally = Tally()
    tally.check(len(names) >= MIN_FEATURES, FEATURE_ISSUE.format(n=len(names)))

    flat = [c for c in names if stats["std", c] == 0.0]
    tally.check(not flat, VARIANCE_ISSUE.format(n=len(flat), names=flat))

    limit = rules.threshold("ai_readiness", "max_correlation")
    strong, pairs = high_pairs(table, names, stats, limit)
    tally.check(not strong, PAIR_ISSUE.format(n=strong, limit=limit, top=pairs[:3]))

    limit = rules.threshold("ai_readiness", "max_skewness")
    values = {c: skewness(stats, c) for c in names}
    skewed = {c: round(v, 2) for c, v in values.items() if v is not None and abs(v) > limit}
    tally.check(
        not skewed, SKEW_ISSUE.format(n=len(skewed), limit=limit, names=list(skewed)[:5])
    )

    leaks = [c for c in rules.leakage_columns if c in table]
    tally.check(not leaks, LEAKAGE_ISSUE.format(names=leaks))

    details = {
        "feature_count": len(names),
        "zero_variance_columns": flat,
        "high_correlation_pairs": pairs,
        "highly_skewed_columns": skewed,
        "leakage_risk_columns": leaks,
    }
    if rules.target and rules.target in table:
        details["class_balance"] = _balance(table, rules, tally)
    return tally.outcome(tally.score(), details)


def _balance(table: Table, rules: Rules, tally: Tally) -> dict:
    target = rules.target
    limit = rules.threshold("ai_readiness", "min_class_ratio")
    classes, smallest, total = class_balance(table, target).first()[:3]
    if classes < 2:
        tally.check(True)
        return {"target_column": target, "note": ONE_CLASS_NOTE}
    minority = round(smallest / total, 4)
    issue = BALANCE_ISSUE.format(target=target, ratio=minority, limit=limit)
    tally.check(minority >= limit, issue)
    # A continuous target has a class per value, so the counts themselves stay a table:
    # class_counts().
    return {
        "target_column": target,
        "class_count": classes,
        "minority_count": smallest,
        "minority_class_ratio": minority,
    }


def correlated_pairs(source: DataFrame | Table, config: dict | None = None) -> DataFrame:
    """(column, other, r): feature pairs at or above the correlation limit."""
    table, rules = Table.of(source), Rules.of(config)
    names = features(table, rules)
    stats = run_probes(table.df, probes(table, rules))
    found = strong_pairs(table, names, stats, rules.threshold("ai_readiness", "max_correlation"))
    return found.select(
        named(names, "j").alias("column"), named(names, "i").alias("other"), F.round("r", 3).alias("r")
    )


def feature_spread(source: DataFrame | Table, config: dict | None = None) -> DataFrame:
    """(column, zero_variance, skewness, extreme_skew) per feature."""
    table, rules = Table.of(source), Rules.of(config)
    limit = rules.threshold("ai_readiness", "max_skewness")
    counted = per_column(
        table.df,
        features(table, rules),
        lambda c: [
            F.count(ref(c)).alias("n"),
            sample_std(table.number(c)).alias("std"),
            skewness_g1(table.number(c)).alias("g1"),
        ],
        fields=11,
    )
    return counted.select(
        "column",
        F.coalesce(F.col("std") == 0, F.lit(False)).alias("zero_variance"),
        F.round("g1", 4).alias("skewness"),
        F.coalesce((F.col("n") >= MIN_VALUES) & (F.abs("g1") > limit), F.lit(False)).alias(
            "extreme_skew"
        ),
    )
