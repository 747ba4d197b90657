"""Pillar 3: repeated rows and missing keys."""

from __future__ import annotations

from tabmeter.config import Rules
from tabmeter.operators.common import missing, present, row_count
from tabmeter.operators.duplicates import duplicate_count
from tabmeter.operators.validity import required_ids
from tabmeter.plans.statpass import Probe
from tabmeter.result import Outcome, Tally, no_rows, share
from tabmeter.table import Table

# Wording of the findings and points lost per percent.
DUPLICATE_ISSUE = "{n} duplicate rows found ({pct}%) — exceeds threshold of {limit}%"
ID_ISSUE = "ID column '{column}' has {n} null values ({pct}%)"
POINTS_PER_DUPLICATE_PCT = 5
POINTS_PER_NULL_PCT = 0.5


def probes(table: Table, rules: Rules) -> list[Probe]:
    return [row_count(), *(present(table, c) for c in required_ids(table, rules))]


def assess(table: Table, rules: Rules, stats: dict) -> Outcome:
    rows = stats["rows"]
    if not rows:
        return no_rows()
    tally = Tally()
    limit = rules.threshold("uniqueness", "max_duplicate_pct")
    repeats = duplicate_count(table)
    repeats_pct = share(repeats, rows)
    tally.check(
        repeats_pct <= limit, DUPLICATE_ISSUE.format(n=repeats, pct=repeats_pct, limit=limit)
    )
    nulls = {}
    for name in required_ids(table, rules):
        n = missing(stats, name)
        nulls[name] = {"null_count": n, "null_pct": share(n, rows)}
        tally.check(n == 0, ID_ISSUE.format(column=name, n=n, pct=nulls[name]["null_pct"]))

    score = max(0.0, 100.0 - repeats_pct * POINTS_PER_DUPLICATE_PCT)
    score -= sum(entry["null_pct"] * POINTS_PER_NULL_PCT for entry in nulls.values())
    details = {"duplicate_rows": repeats, "duplicate_pct": repeats_pct, "id_column_nulls": nulls}
    return tally.outcome(max(0.0, score), details)
