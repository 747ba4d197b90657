from tabmeter import check_consistency, check_uniqueness
from tabmeter.operators.duplicates import duplicate_count, duplicate_rows

NAN = float("nan")


def test_duplicates_treat_missing_as_equal(spark):
    rows = [(1.0, "a"), (1.0, "a"), (None, "a"), (NAN, "a"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "x double, y string")
    assert duplicate_count(df) == 3
    assert duplicate_rows(df).first()["duplicate_rows"] == 3


def test_missing_values_are_not_confused_by_position(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert duplicate_count(df) == 0


def test_every_way_of_counting_duplicates_agrees(spark):
    df = spark.range(3000).selectExpr(
        "CAST(id % 700 AS STRING) a", "IF(id % 3 = 0, NULL, id % 5) b", "array(id % 2) c", "id % 11 d"
    )
    expected = df.count() - df.selectExpr("a", "b", "to_json(c) c", "d").distinct().count()
    assert duplicate_count(df) == expected
    assert duplicate_rows(df).first()["duplicate_rows"] == expected


def test_uniqueness_score(spark):
    config = {"columns": {"required_id_columns": ["id", "absent"]}}
    rows = [(i, "x") for i in range(97)] + [(0, "x"), (None, "x"), (None, "y")]
    found = check_uniqueness(spark.createDataFrame(rows, "id int, v string"), config)
    # 1 % duplicates cost 5 points, 2 % missing ids cost 1.
    assert found.score == 94.0
    assert (found.passed_checks, found.total_checks) == (1, 2)
    assert found.issues == ["ID column 'id' has 2 null values (2.0%)"]


def test_too_many_duplicates(spark):
    found = check_uniqueness(spark.createDataFrame([(1,)] * 4, "id int"), {})
    assert found.score == 0.0
    assert found.issues == ["3 duplicate rows found (75.0%) — exceeds threshold of 5.0%"]


RULES = {
    "consistency_rules": [
        {"name": "order", "left_column": "ship", "right_column": "ordered", "operator": ">="},
        {"name": "gone", "left_column": "ship", "right_column": "absent", "operator": ">="},
        {"name": "other", "tolerance_days": 2},
        {
            "name": "late_delivery_risk_vs_status",
            "risk_column": "risk",
            "status_column": "status",
            "risk_value": 1,
            "expected_status": "Late delivery",
        },
    ]
}
SCHEMA = (
    "ship string, ordered string, risk int, status string, "
    "`Sales` string, `Order Item Quantity` int, `Discount Rate` double"
)


def test_consistency_rules(spark):
    rows = [
        ("2020-01-02", "2020-01-01", 1, " Late delivery ", "10", 1, 0.5),
        ("2020-01-01", "2020-01-02", 1, None, "0", 1, 1.5),
        ("nonsense", "2020-01-02", 0, "On time", "x", 1, None),
        (None, None, None, None, None, None, -0.5),
    ]
    found = check_consistency(spark.createDataFrame(rows, SCHEMA), RULES)
    details = found.details
    assert details["order"]["violations"] == 1
    assert details["gone"]["skipped"] and details["other"]["skipped"]
    late = details["late_delivery_risk_vs_status"]
    assert (late["risk_value_rows"], late["inconsistencies"]) == (2, 1)
    assert late["consistency_rate_pct"] == 50.0
    assert details["sales_qty_consistency"]["violations"] == 1
    assert details["discount_rate_range"]["violations"] == 2
    assert (found.passed_checks, found.total_checks) == (2, 6)
    assert found.score == 33.33
    assert (
        "Rule 'late_delivery_risk_vs_status': 1 rows have risk=1 but 'status' != 'Late delivery'"
        in found.issues
    )


def test_no_rules_score_full(spark):
    found = check_consistency(spark.createDataFrame([(1,)], "a int"), {})
    assert (found.score, found.total_checks) == (100.0, 0)


def test_risk_of_another_type_never_matches(spark):
    df = spark.createDataFrame([("1", "x")], "risk string, status string")
    found = check_consistency(df, RULES)
    assert found.details["late_delivery_risk_vs_status"]["risk_value_rows"] == 0
