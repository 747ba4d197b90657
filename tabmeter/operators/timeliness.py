"""Pillar 5: readable dates, the expected window, gaps between days."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabmeter.config import Rules
from tabmeter.functions.columns import ref
from tabmeter.functions.dates import is_datetime
from tabmeter.operators.common import parse_failures, present, row_count
from tabmeter.operators.validity import date_columns
from tabmeter.plans.statpass import Probe
from tabmeter.result import Outcome, Tally, no_rows
from tabmeter.table import Table

# Words in the name of a date column, the share of values which
# must parse, the score without dates, and the wording of the findings.
DATE_WORDS = ("date", "time", "timestamp")
PARSE_RATE = 0.8
NO_DATES_SCORE = 70.0
NO_DATES_TEXT = "No datetime columns detected"
NO_DATES_ISSUE = "No datetime columns found — timeliness checks skipped"
FEW_DATES_TEXT = "Too few valid dates for temporal checks"
PARSE_ISSUE = "Column '{column}': {n} values could not be parsed as datetime"
EARLY_ISSUE = "Column '{column}': earliest date {day} is before expected start {bound}"
LATE_ISSUE = "Column '{column}': latest date {day} is after expected end {bound}"
GAP_ISSUE = "Column '{column}': maximum temporal gap is {gap} days (threshold: {limit})"


def candidates(table: Table, rules: Rules) -> list[str]:
    """Configured date columns; else those with a date type or a date-like name."""
    configured = date_columns(table, rules)
    if configured:
        return configured
    named = [c for c in table.columns if any(w in c.lower() for w in DATE_WORDS)]
    return table.datetimes + [c for c in named if not is_datetime(table.types[c])]


def probes(table: Table, rules: Rules) -> list[Probe]:
    wanted = [row_count()]
    for name in candidates(table, rules):
        at, instant = table.ordinal(name), table.instant(name)
        wanted += [
            present(table, name),
            parse_failures(table, name),
            Probe(("first date", name), F.min(instant).cast("date"), 1, at, text=True),
            Probe(("last date", name), F.max(instant).cast("date"), 1, at, text=True),
            Probe(("days", name), F.timestamp_diff("DAY", F.min(instant), F.max(instant)), 2, at),
            *(
                Probe((kind, name), beyond.cast("int"), 1, at)
                for kind, beyond in _beyond(instant, rules.date_window).items()
            ),
        ]
    return wanted


def chosen(table: Table, rules: Rules, stats: dict) -> list[str]:
    """The candidates that hold dates, judged by all of their values."""
    if date_columns(table, rules):
        return date_columns(table, rules)
    return [
        c
        for c in candidates(table, rules)
        if is_datetime(table.types[c])
        or (stats["present", c] and _parsed(stats, c) / stats["present", c] >= PARSE_RATE)
    ]


def day_gaps(source: DataFrame | Table, columns: list[str]) -> DataFrame:
    """(column, day, gap_days): days since the previous day with data.

    The distinct runs on the map side first, so what is shuffled and sorted per
    column is no more than the calendar days it spans.
    """
    table = Table.of(source).with_dates(columns)
    days = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), table.instant(c).cast("date").alias("day"))
                for c in columns
            ]
        )
    )
    distinct = table.df.select(days.alias("d")).select("d.*").where("day IS NOT NULL").distinct()
    previous = F.lag("day").over(Window.partitionBy("column").orderBy("day"))
    return distinct.withColumn("gap_days", F.datediff("day", previous))


def max_gaps(source: DataFrame | Table, columns: list[str]) -> DataFrame:
    """(column, max_gap_days) per date column that has a date at all."""
    gaps = day_gaps(source, columns).groupBy("column")
    return gaps.agg(F.coalesce(F.max("gap_days"), F.lit(0)).alias("max_gap_days"))


def date_ranges(source: DataFrame | Table, columns: list[str]) -> DataFrame:
    """(column, min_date, max_date, date_range_days) in whole elapsed days."""
    table = Table.of(source).with_dates(columns)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.min(table.instant(c)).alias("lo"),
            F.max(table.instant(c)).alias("hi"),
        )
        for c in columns
    ]
    found = table.df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return found.select(
        "column",
        F.col("lo").cast("date").alias("min_date"),
        F.col("hi").cast("date").alias("max_date"),
        F.timestamp_diff("DAY", F.col("lo"), F.col("hi")).alias("date_range_days"),
    )


def assess(table: Table, rules: Rules, stats: dict) -> Outcome:
    if not stats["rows"]:
        return no_rows()
    columns = chosen(table, rules, stats)
    if not columns:
        return Outcome(NO_DATES_SCORE, 0, 1, [NO_DATES_ISSUE], {"message": NO_DATES_TEXT})
    limit = rules.threshold("timeliness", "max_gap_days")
    spanned = [c for c in columns if _parsed(stats, c) >= 2]
    gaps = {}
    if spanned:
        gaps = {r["column"]: r["max_gap_days"] for r in max_gaps(table, spanned).collect()}

    tally, details = Tally(), {}
    for name in columns:
        failed = int(stats["unparsed", name])
        tally.check(failed == 0, PARSE_ISSUE.format(column=name, n=failed))
        if name not in spanned:
            details[name] = {"message": FEW_DATES_TEXT}
            continue
        first, last = stats["first date", name], stats["last date", name]
        outside = _outside(name, stats, rules.date_window)
        tally.check(not outside)
        tally.issues += outside
        gap = gaps[name]
        tally.check(gap <= limit, GAP_ISSUE.format(column=name, gap=gap, limit=limit))
        details[name] = {
            "min_date": first,
            "max_date": last,
            "date_range_days": int(stats["days", name]),
            "max_gap_days": gap,
        }
    return tally.outcome(tally.score(), {"columns": details})


def _parsed(stats: dict, column: str) -> int:
    return int(stats["present", column] - stats["unparsed", column])


def _beyond(instant: Column, window: tuple) -> dict[str, Column]:
    """Whether the earliest and the latest date lie outside the expected window. Spark
    compares, as its years go beyond Python's."""
    start, end = (F.lit(datetime.fromisoformat(str(x)).isoformat()).cast("timestamp_ntz") if x else None for x in window)
    return ({"early": F.min(instant) < start} if start is not None else {}) | (
        {"late": F.max(instant) > end} if end is not None else {}
    )


def _outside(column: str, stats: dict, window: tuple) -> list[str]:
    start, end = window
    found = []
    if start and stats["early", column]:
        found.append(EARLY_ISSUE.format(column=column, day=stats["first date", column], bound=start))
    if end and stats["late", column]:
        found.append(LATE_ISSUE.format(column=column, day=stats["last date", column], bound=end))
    return found
