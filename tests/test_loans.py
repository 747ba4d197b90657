"""End to end on a CSV of library loans with planted defects."""

import pytest

from tabmeter import load_table, profile, score, write_csv

LOANS = 1800
LENT = "TIMESTAMP'2021-03-01' + make_interval(0, 0, 0, 0, 3 * id)"
COLUMNS = {
    "loan": "IF(id % 30 = 0, NULL, 5000 + id)",
    "lent on": f"date_format({LENT}, 'yyyy/MM/dd HH:mm:ss')",
    "back on": f"date_format({LENT} + make_interval(0, 0, 0, IF(id % 45 = 0, -2, 1 + id % 20)), 'yyyy/MM/dd HH:mm:ss')",
    "desk": "CASE id % 90 WHEN 11 THEN 'N/A' WHEN 12 THEN 'roof' ELSE 'hall' END",
    "reminded": "IF(id % 4 = 0, 1, 0)",
    "state": "IF(id % 4 = 0 AND id % 36 != 0, 'overdue', 'in time')",
    "quantity of books": "IF(id % 60 = 5, -4, 1 + id % 12)",
    "sales of bags": "IF(id % 300 = 6, 0.0, 0.5 + id % 7)",
    "shelf mark": "IF(id % 10 < 7, NULL, concat('S', id % 40))",
}
RULES = {
    "dataset": {"expected_date_range": {"start": "2020-01-01", "end": "2023-01-01"}},
    "columns": {
        "numeric_ranges": [{"column": "quantity of books", "min": 1, "max": 12}],
        "categorical_enums": [{"column": "desk", "allowed_values": ["hall", "door"]}],
        "datetime_columns": ["lent on", "back on"],
        "required_id_columns": ["loan"],
        "known_sparse_columns": ["shelf mark"],
    },
    "consistency_rules": [
        {"name": "back_after_lent", "left_column": "back on", "right_column": "lent on", "operator": ">="},
        # this name selects the check of a flag against a status
        {
            "name": "late_delivery_risk_vs_status",
            "risk_column": "reminded",
            "status_column": "state",
            "risk_value": 1,
            "expected_status": "overdue",
        },
    ],
    "ai_readiness": {"target_column": "reminded", "id_columns": ["loan"], "leakage_risk_columns": ["state"]},
}


@pytest.fixture(scope="module")
def loans(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("loans") / "loans.csv")
    once = spark.range(LOANS).selectExpr(*[f"{e} AS `{n}`" for n, e in COLUMNS.items()])
    again = once.where("loan % 9 = 0")
    write_csv(once.unionAll(again), path)
    return load_table(spark, path), again.count()


@pytest.fixture(scope="module")
def details(loans):
    found = score(loans[0].dropDuplicates(), None, RULES, materialize=True)
    return {name: pillar.details for name, pillar in found.pillars.items()}


def planted(every, at=0):
    return len(range(at, LOANS, every))


def test_gaps(details):
    gaps = {name: own["null_count"] for name, own in details["completeness"]["columns"].items()}
    # "N/A" is a gap in a CSV, not a wrong value
    assert gaps["desk"] == planted(90, 11) and gaps["shelf mark"] == LOANS * 7 // 10
    assert details["completeness"]["critical_columns"] == []
    assert details["uniqueness"]["id_column_nulls"]["loan"]["null_count"] == planted(30)


def test_wrong_values(details):
    assert details["validity"]["enum_checks"]["desk"]["sample_invalid_values"] == ["roof"]
    assert details["validity"]["range_checks"]["quantity of books"]["violations"] == planted(60, 5)
    assert all(own["parseable"] for own in details["validity"]["type_checks"].values())


def test_fields_against_each_other(details):
    found = details["consistency"]
    assert found["back_after_lent"]["violations"] == planted(45)
    assert found["late_delivery_risk_vs_status"]["inconsistencies"] == planted(36)
    assert found["sales_qty_consistency"]["violations"] == planted(300, 6)


def test_dates_and_leaks(details):
    assert details["timeliness"]["columns"]["lent on"]["max_gap_days"] == 1
    assert details["ai_readiness"]["leakage_risk_columns"] == ["state"]


def test_rows_that_come_twice(loans):
    frame, again = loans
    stats = profile(frame)
    assert stats["duplicate_rows"] == again > 0
    assert stats["duplicate_pct"] == round(100 * again / (LOANS + again), 2)
