"""Scores of tank logs, worked out from the formula: the mean share filled, less half the
share of rows that are mostly empty."""

import pytest

from tabmeter import check_completeness

LIMITS = {"pillars": {"completeness": {"thresholds": {"critical_null_pct": 60.0, "warning_null_pct": 25.0}}}}
TANKS = "tank string, litres double, sealed boolean"


def checked(spark, rows, schema=TANKS, **columns):
    return check_completeness(spark.createDataFrame(rows, schema), LIMITS | {"columns": columns})


def gaps(spark, flags):
    """A row for each set of flags: T, L and S say which of the three fields are filled."""
    full = {"T": "north", "L": 12.5, "S": True}
    return checked(spark, [tuple(full[x] if x in own else None for x in "TLS") for own in flags])


@pytest.mark.parametrize(
    ("flags", "score", "bad", "passed"),
    [
        (["TLS"] * 6, 100.0, 0, 3),
        ([""] * 7, 0.0, 7, 0),
        (["TS"] * 3 + ["TLS"] * 5, 87.5, 0, 2),
        (["T", "TL", "TLS", "TLS"], round((100 + 75 + 50) / 3 - 25 / 2, 2), 1, 1),
        (["S", "L", "", "TLS"], round((25 + 50 + 50) / 3 - 75 / 2, 2), 3, 0),
    ],
)
def test_scores(spark, flags, score, bad, passed):
    found = gaps(spark, flags)
    assert found.score == pytest.approx(score, abs=0.005)
    assert found.details["bad_row_count"] == bad
    assert (found.passed_checks, found.total_checks) == (passed, 3)


def test_wording(spark):
    assert gaps(spark, ["TLS"] * 6).issues == []
    issues = gaps(spark, ["T", "T", "TS", "TS", "TS", "TS", "TS", "TLS"]).issues
    assert issues == [
        "1 column(s) have >60.0% missing values: ['litres']",
        "1 column(s) have >25.0% missing values: ['sealed']",
        "2 rows (25.0%) have >50% of their fields missing",
    ]


def test_sparse_columns_are_not_held_against_a_table(spark):
    rows = [(f"t{i}", float(i), None) for i in range(9)]
    plain, told = checked(spark, rows), checked(spark, rows, known_sparse_columns=["sealed"])
    assert (plain.score, told.score) == (pytest.approx(66.67, abs=0.005), 100.0)
    assert told.details["columns"]["sealed"]["null_count"] == 9 and told.details["critical_columns"] == []


def test_nan_counts_as_missing_infinity_does_not(spark):
    rows = [("a", float("-inf"), True), ("b", float("nan"), True), ("c", 0.0, True)]
    assert checked(spark, rows).details["columns"]["litres"]["null_count"] == 1


def test_a_table_without_rows(spark):
    found = checked(spark, [])
    assert (found.score, found.passed_checks, found.total_checks) == (0.0, 0, 1)
    assert found.issues == ["Dataset has no rows"]


def test_names_and_types_of_all_kinds(spark):
    rows = [(None, [1], "x"), (7, None, "y")]
    found = checked(spark, rows, "`flow.rate (l/s)` int, `list of ``ports` array<int>, plain string")
    nulls = {name: own["null_count"] for name, own in found.details["columns"].items()}
    assert nulls == {"flow.rate (l/s)": 1, "list of `ports": 1, "plain": 0}
