"""Probes that several pillars ask for."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabmeter.functions.columns import ref
from tabmeter.functions.moments import sample_std
from tabmeter.plans.statpass import Probe
from tabmeter.table import Table

def row_count() -> Probe:
    return Probe("rows", F.count(F.lit(1)))


def present(table: Table, column: str) -> Probe:
    return Probe(("present", column), F.count(ref(column)), 1, table.ordinal(column))


def missing(stats: dict, column: str) -> int:
    return int(stats["rows"] - stats["present", column])


def parse_failures(table: Table, column: str) -> Probe:
    bad = ref(column).isNotNull() & table.instant(column).isNull()
    return Probe(("unparsed", column), F.count_if(bad), 1, table.ordinal(column))


def moments(table: Table, column: str) -> list[Probe]:
    """Mean and sample deviation of a numeric column."""
    at, value = table.ordinal(column), table.number(column)
    return [
        present(table, column),
        Probe(("mean", column), F.avg(value), 2, at),
        Probe(("std", column), sample_std(value), 6, at),
    ]
