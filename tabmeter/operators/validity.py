"""Pillar 2: ranges, allowed values, readable dates, filled keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabmeter.config import Rules
from tabmeter.functions.columns import as_number, pct, ref, strip, text_form
from tabmeter.functions.dates import is_datetime
from tabmeter.operators.common import missing, parse_failures, present, row_count
from tabmeter.plans.statpass import Probe, union
from tabmeter.result import Outcome, Tally, no_rows, share
from tabmeter.table import Table

# Wording of the findings.
RANGE_ISSUE = "Column '{column}': {n} values ({pct}%) out of range [{low}, {high}]"
ENUM_ISSUE = "Column '{column}': {n} invalid values ({pct}%) not in allowed set. Sample: {sample}"
DATE_ISSUE = "DateTime column '{column}': {n} values ({pct}%) could not be parsed"
ID_ISSUE = "Required ID column '{column}' has {n} null values"

SAMPLE_SIZE = 5


def range_rules(table: Table, rules: Rules) -> list[dict]:
    return [r for r in rules.column_rules("numeric_ranges") if r.get("column") in table]


def enum_rules(table: Table, rules: Rules) -> list[dict]:
    """Rules on present columns which allow at least one value."""
    listed = rules.column_rules("categorical_enums")
    return [r for r in listed if r.get("column") in table and r.get("allowed_values")]


def date_columns(table: Table, rules: Rules) -> list[str]:
    return [c for c in rules.column_rules("datetime_columns") if c in table]


def required_ids(table: Table, rules: Rules) -> list[str]:
    return [c for c in rules.column_rules("required_id_columns") if c in table]


def out_of_range(table: Table, rule: dict) -> list[Column]:
    """One condition per bound the rule sets."""
    value = as_number(ref(rule["column"]), table.types[rule["column"]])
    sides = []
    if rule.get("min") is not None:
        sides.append(value < rule["min"])
    if rule.get("max") is not None:
        sides.append(value > rule["max"])
    return sides


def violations(table: Table, rule: dict) -> Column:
    return sum((F.count_if(side) for side in out_of_range(table, rule)), F.lit(0))


def enum_text(table: Table, column: str) -> Column:
    return strip(text_form(ref(column), table.types[column]))


def not_allowed(table: Table, rule: dict) -> Column:
    """True for a present value which is none of the allowed ones."""
    allowed = sorted({str(v) for v in rule["allowed_values"]})
    text = text_form(ref(rule["column"]), table.types[rule["column"]])
    # Only what is not allowed as it stands needs stripping.
    return ~(text.isin(allowed) | strip(text).isin(allowed))


def probes(table: Table, rules: Rules) -> list[Probe]:
    wanted = [row_count()]
    for i, rule in enumerate(range_rules(table, rules)):
        at = table.ordinal(rule["column"])
        wanted.append(Probe(("range", i), violations(table, rule), 2, at))
    for i, rule in enumerate(enum_rules(table, rules)):
        at = table.ordinal(rule["column"])
        wanted.append(Probe(("enum", i), F.count_if(not_allowed(table, rule)), 1, at))
    wanted += [
        parse_failures(table, c)
        for c in date_columns(table, rules)
        if not is_datetime(table.types[c])
    ]
    wanted += [present(table, c) for c in required_ids(table, rules)]
    return wanted


def invalid_samples(table: Table, rules: list[dict], size: int = SAMPLE_SIZE) -> DataFrame:
    """(column, value): the first distinct invalid values of each rule, by value."""
    frames = [
        table.df.where(not_allowed(table, rule))
        .select(F.lit(rule["column"]).alias("column"), enum_text(table, rule["column"]).alias("value"))
        .distinct()
        .orderBy("value")
        .limit(size)
        for rule in rules
    ]
    return union(frames)


def assess(table: Table, rules: Rules, stats: dict) -> Outcome:
    rows = stats["rows"]
    if not rows:
        return no_rows()
    tally = Tally()
    ranges, enums, types = {}, {}, {}

    for i, rule in enumerate(range_rules(table, rules)):
        name, low, high = rule["column"], rule.get("min"), rule.get("max")
        n = int(stats["range", i])
        n_pct = share(n, rows)
        ranges[name] = {"violations": n, "violation_pct": n_pct, "min": low, "max": high}
        tally.check(n == 0, RANGE_ISSUE.format(column=name, n=n, pct=n_pct, low=low, high=high))

    listed = enum_rules(table, rules)
    failing = [r for i, r in enumerate(listed) if stats["enum", i]]
    samples: dict[str, list[str]] = {}
    if failing:
        for row in invalid_samples(table, failing).collect():
            samples.setdefault(row["column"], []).append(row["value"])
    for i, rule in enumerate(listed):
        name = rule["column"]
        n = int(stats["enum", i])
        n_pct = share(n, rows)
        sample = sorted(samples.get(name, []))[:SAMPLE_SIZE]
        enums[name] = {
            "invalid_count": n,
            "invalid_pct": n_pct,
            "sample_invalid_values": sample,
            "allowed_values": list(rule["allowed_values"]),
        }
        tally.check(n == 0, ENUM_ISSUE.format(column=name, n=n, pct=n_pct, sample=sample))

    for name in date_columns(table, rules):
        if is_datetime(table.types[name]):
            types[name] = {"parseable": True}
            tally.check(True)
            continue
        n = int(stats["unparsed", name])
        n_pct = share(n, rows)
        types[name] = {"parseable": n == 0, "parse_fail_count": n, "parse_fail_pct": n_pct}
        tally.check(n == 0, DATE_ISSUE.format(column=name, n=n, pct=n_pct))

    for name in required_ids(table, rules):
        n = missing(stats, name)
        tally.check(n == 0, ID_ISSUE.format(column=name, n=n))

    details = {"range_checks": ranges, "enum_checks": enums, "type_checks": types}
    return tally.outcome(tally.score(), details)


def _counts(table: Table, named: list[tuple[str, Column]]) -> DataFrame:
    rows = [
        F.struct(F.lit(name).alias("column"), value.cast("bigint").alias("violations"), rows_count())
        for name, value in named
    ]
    counted = table.df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return counted.select(
        "column", "violations", pct(F.col("violations"), F.col("n")).alias("violation_pct")
    )


def rows_count() -> Column:
    return F.count(F.lit(1)).alias("n")


def range_violations(source: DataFrame | Table, config: dict) -> DataFrame:
    """(column, violations, violation_pct) per range rule."""
    table, rules = Table.of(source), Rules.of(config)
    return _counts(
        table, [(r["column"], violations(table, r)) for r in range_rules(table, rules)]
    )


def enum_violations(source: DataFrame | Table, config: dict) -> DataFrame:
    """(column, violations, violation_pct) per allowed-values rule."""
    table, rules = Table.of(source), Rules.of(config)
    return _counts(
        table,
        [(r["column"], F.count_if(not_allowed(table, r))) for r in enum_rules(table, rules)],
    )


def enum_samples(source: DataFrame | Table, config: dict) -> DataFrame:
    """(column, value): up to five distinct invalid values per rule."""
    table, rules = Table.of(source), Rules.of(config)
    return invalid_samples(table, enum_rules(table, rules))


def parse_failure_counts(source: DataFrame | Table, config: dict) -> DataFrame:
    """(column, violations, violation_pct) per date column of the rules."""
    table, rules = Table.of(source), Rules.of(config)
    return _counts(
        table, [(c, parse_failures(table, c).expr) for c in date_columns(table, rules)]
    )


def id_nulls(source: DataFrame | Table, config: dict) -> DataFrame:
    """(column, violations, violation_pct): missing values per required ID."""
    table, rules = Table.of(source), Rules.of(config)
    return _counts(
        table, [(c, F.count_if(ref(c).isNull())) for c in required_ids(table, rules)]
    )
