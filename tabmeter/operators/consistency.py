"""Pillar 4: rules across the fields of one row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tabmeter.config import Rules
from tabmeter.functions.columns import as_number, equals_literal, pct, ref, strip, text_form
from tabmeter.operators.common import row_count
from tabmeter.plans.statpass import Probe
from tabmeter.result import Outcome, Tally, no_rows, share
from tabmeter.table import Table

# Names of the rules, words in column names, wording of the findings.
STATUS_RULE = "late_delivery_risk_vs_status"
DEFAULT_RISK = 1
DEFAULT_STATUS = "Late delivery"
SALES_WORDS = ("sales",)
QUANTITY_WORDS = ("quantity",)
RATE_WORDS = ("discount rate", "discountrate")
ORDER_ISSUE = "Rule '{name}': {n} rows ({pct}%) violate '{left}' >= '{right}'"
STATUS_ISSUE = "Rule '{name}': {n} rows have {risk}={value} but '{status}' != '{expected}'"
SALES_ISSUE = "Check '{name}': {n} rows ({pct}%) have quantity > 0 but sales <= 0"
RATE_ISSUE = "Check '{name}': {n} rows ({pct}%) have discount rate outside [0, 1]"
SALES_TEXT = "Sales should be > 0 when quantity > 0"
RATE_TEXT = "Discount rate must be 0-1"
ABSENT = "Columns not in dataset"
UNKNOWN = "Rule '{name}' not implemented"


@dataclass(frozen=True)
class RowRule:
    """A compiled rule. `scope` marks the rows it speaks about where that is
    part of the finding; a rule without `broken` is skipped and passes."""

    name: str
    issue: str = ""
    description: str = ""
    broken: Column | None = None
    scope: Column | None = None
    skipped: str | None = None
    words: dict = field(default_factory=dict)


def compile_rules(table: Table, rules: Rules) -> list[RowRule]:
    return [_configured(table, r) for r in rules.consistency] + _built_in(table)


def _configured(table: Table, rule: dict) -> RowRule:
    name, text = rule.get("name", ""), rule.get("description", "")
    left, right = rule.get("left_column"), rule.get("right_column")
    label = rule.get("name", "unnamed")
    if rule.get("operator") == ">=" and left and right:
        if left not in table or right not in table:
            return RowRule(label, skipped=ABSENT)
        broken = table.instant(left) < table.instant(right)
        return RowRule(label, ORDER_ISSUE, text, broken, words={"left": left, "right": right})
    if name == STATUS_RULE:
        risk, status = rule.get("risk_column"), rule.get("status_column")
        if risk not in table or status not in table:
            return RowRule(label, skipped=ABSENT)
        value = rule.get("risk_value", DEFAULT_RISK)
        expected = rule.get("expected_status", DEFAULT_STATUS)
        words = {"risk": risk, "value": value, "status": status, "expected": expected}
        at_risk = equals_literal(ref(risk), table.types[risk], value)
        text = text_form(ref(status), table.types[status])
        same = text.eqNullSafe(F.lit(expected)) | strip(text).eqNullSafe(F.lit(expected))
        return RowRule(label, STATUS_ISSUE, text, at_risk & ~same, at_risk, words=words)
    return RowRule(label, skipped=UNKNOWN.format(name=name))


def _built_in(table: Table) -> list[RowRule]:
    found = []
    sales, quantity = _first(table, SALES_WORDS), _first(table, QUANTITY_WORDS)
    if sales and quantity:
        amount = as_number(ref(sales), table.types[sales])
        count = as_number(ref(quantity), table.types[quantity])
        broken = (count > 0) & (amount <= 0)
        found.append(RowRule("sales_qty_consistency", SALES_ISSUE, SALES_TEXT, broken))
    rate = _first(table, RATE_WORDS)
    if rate:
        value = as_number(ref(rate), table.types[rate])
        broken = (value < 0) | (value > 1)
        found.append(RowRule("discount_rate_range", RATE_ISSUE, RATE_TEXT, broken))
    return found


def _first(table: Table, words: tuple[str, ...]) -> str | None:
    """First column whose lower-case name holds one of the words."""
    return next((c for c in table.columns if any(w in c.lower() for w in words)), None)


def probes(table: Table, rules: Rules) -> list[Probe]:
    wanted = [row_count()]
    for i, rule in enumerate(compile_rules(table, rules)):
        if rule.broken is not None:
            wanted.append(Probe(("broken", i), F.count_if(rule.broken)))
        if rule.scope is not None:
            wanted.append(Probe(("scope", i), F.count_if(rule.scope)))
    return wanted


def assess(table: Table, rules: Rules, stats: dict) -> Outcome:
    rows = stats["rows"]
    if not rows:
        return no_rows()
    tally, details = Tally(), {}
    for i, rule in enumerate(compile_rules(table, rules)):
        if rule.skipped:
            tally.check(True)
            details[rule.name] = {"passed": True, "skipped": True, "reason": rule.skipped}
            continue
        n = int(stats["broken", i])
        issue = None
        if n:
            issue = rule.issue.format(name=rule.name, n=n, pct=share(n, rows), **rule.words)
        entry = {"passed": n == 0, "description": rule.description, "issue": issue}
        if rule.scope is None:
            entry |= {"violations": n, "violation_pct": share(n, rows)}
        else:
            scope = int(stats["scope", i])
            entry |= {
                "risk_value_rows": scope,
                "inconsistencies": n,
                "consistency_rate_pct": share(scope - n, scope) if scope else 100.0,
            }
        details[rule.name] = entry
        tally.check(n == 0, issue)
    return tally.outcome(tally.score(), details)


def rule_violations(source: DataFrame | Table, config: dict | None = None) -> DataFrame:
    """(rule, skipped, scope_rows, violations, violation_pct) per rule."""
    table, rules = Table.of(source), Rules.of(config)
    rows = []
    for rule in compile_rules(table, rules):
        broken = F.lit(False) if rule.broken is None else rule.broken
        scope = F.lit(True) if rule.scope is None else rule.scope
        rows.append(
            F.struct(
                F.lit(rule.name).alias("rule"),
                F.lit(rule.skipped is not None).alias("skipped"),
                F.count_if(scope).alias("scope_rows"),
                F.count_if(broken).alias("violations"),
                F.count(F.lit(1)).alias("n"),
            )
        )
    counted = table.df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return counted.withColumn("violation_pct", pct(F.col("violations"), F.col("n"))).drop("n")
