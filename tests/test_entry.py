"""The driver contract on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF_DIR = entry.SMOKE_DIR
QUICK = (
    "column_nulls",
    "completeness_score",
    "skew_kurtosis",
    "correlated_pairs",
    "top_values",
    "duplicate_count",
    "enum_samples",
    "rule_violations",
    "date_gaps",
    "class_balance",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_its_oracle(spark, name):
    con, sql = duck(SF_DIR), entry.oracle_sql()
    assert compare(spark, con, name, entry.queries()[name], sql[name], SF_DIR) is None


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert [r["pillar"] for r in rows][0] == "completeness" and len(rows) == 7


def test_null_counts_read_the_needed_columns_once(spark):
    frame = entry.column_nulls(entry.table(spark, SF_DIR, "lineitem").select("l_tax", "l_shipdate"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "ReadSchema: struct<l_tax:double,l_shipdate:timestamp_ntz>" in plan
