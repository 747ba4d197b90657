import datetime as dt

import pytest

from tabmeter import check_validity

RULES = {
    "columns": {
        "numeric_ranges": [
            {"column": "celsius", "min": -40, "max": 60},
            {"column": "humidity", "min": 0.0, "max": 1.0},
        ],
        "categorical_enums": [{"column": "state", "allowed_values": ["on", "off", "idle"]}],
        "datetime_columns": ["taken_at"],
        "required_id_columns": ["sensor"],
    }
}
SCHEMA = "sensor string, celsius double, humidity double, state string, taken_at string"


def readings(spark, **changes):
    """Four good readings, with the values of some columns changed."""
    columns = {
        "sensor": ["s-1", "s-1", "s-2", "s-9"],
        "celsius": [-40.0, 21.5, 60.0, None],
        "humidity": [0.0, 0.45, 1.0, 0.3],
        "state": ["on", " idle ", "off", None],
        "taken_at": ["2023-07-01", "2023-07-01 06:30:00", "7/2/2023", None],
    } | changes
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), SCHEMA)


def test_good_readings(spark):
    found = check_validity(readings(spark), RULES)
    assert (found.score, found.passed_checks, found.total_checks) == (100.0, 5, 5)


@pytest.mark.parametrize(
    "changes, issue",
    [
        ({"celsius": [-41.0, 61.0, 0.0, 5.0]}, "Column 'celsius': 2 values (50.0%) out of range [-40, 60]"),
        ({"humidity": [1.5, 0.1, 0.2, None]}, "Column 'humidity': 1 values (25.0%) out of range [0.0, 1.0]"),
        (
            {"state": ["on", "broken", "ON", "broken"]},
            "Column 'state': 3 invalid values (75.0%) not in allowed set. Sample: ['ON', 'broken']",
        ),
    ],
)
def test_each_fault_costs_one_check(spark, changes, issue):
    found = check_validity(readings(spark, **changes), RULES)
    assert (found.score, found.passed_checks, found.issues) == (80.0, 4, [issue])


def test_missing_ids(spark):
    found = check_validity(readings(spark, sensor=["s-1", None, "s-3", None]), RULES)
    assert (found.score, found.passed_checks) == (80.0, 4)


def test_unreadable_dates(spark):
    found = check_validity(readings(spark, taken_at=["soon", "2023-02-30", "2023-07-03", None]), RULES)
    assert found.details["type_checks"]["taken_at"]["parse_fail_count"] == 2


def test_rules_for_absent_columns_do_not_count(spark):
    found = check_validity(spark.range(3).withColumnRenamed("id", "other"), RULES)
    assert (found.score, found.total_checks) == (100.0, 0)


def test_text_numbers_and_slash_dates(spark):
    config = {
        "columns": {
            "numeric_ranges": [{"column": "n", "min": 0, "max": 10}],
            "datetime_columns": ["d", "t"],
        }
    }
    rows = [
        (" 5 ", "01/31/2018 22:56", dt.datetime(2020, 1, 1)),
        ("abc", "1/5/2018", None),
        ("5f", "13/45/2018", None),
        ("1e3", "2018-02-30", None),
    ]
    df = spark.createDataFrame(rows, "n string, d string, t timestamp_ntz")
    found = check_validity(df, config)
    assert found.details["range_checks"]["n"]["violations"] == 1
    assert found.details["type_checks"]["d"]["parse_fail_count"] == 2
    assert found.details["type_checks"]["t"] == {"parseable": True}


@pytest.mark.parametrize(
    "text, read",
    [
        ("1/31/2018 22:56:07", "2018-01-31 22:56:07"),
        ("1/31/2018 2:56", "2018-01-31 02:56:00"),
        ("2018/01/31", "2018-01-31 00:00:00"),
        ("2018/1/31 08:09:10", "2018-01-31 08:09:10"),
        ("31-Jan-2018", "2018-01-31 00:00:00"),
        ("20240105", "2024-01-05 00:00:00"),
        ("3/10/2024 2:30", "2024-03-10 02:30:00"),  # an hour that New York skips
        ("2024-03-10 02:30:00", "2024-03-10 02:30:00"),
        ("11/3/2024 1:30", "2024-11-03 01:30:00"),  # an hour that it has twice
        ("11/3/2024 6:30", "2024-11-03 06:30:00"),
        ("31/1/2018", None),
        ("20241399", None),
    ],
)
def test_date_forms_in_any_time_zone(spark, text, read):
    from tabmeter.table import Table

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        table = Table.of(spark.createDataFrame([(text,)], "d string"))
        found = table.df.select(table.instant("d").cast("string")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == read


def test_numeric_and_boolean_enums(spark):
    config = {
        "columns": {
            "categorical_enums": [
                {"column": "flag", "allowed_values": [0, 1]},
                {"column": "truth", "allowed_values": [True]},
            ]
        }
    }
    rows = [(0, True), (1, False), (2, None), (None, True)]
    found = check_validity(spark.createDataFrame(rows, "flag int, truth boolean"), config)
    assert found.details["enum_checks"]["flag"]["invalid_count"] == 1
    assert found.details["enum_checks"]["truth"]["sample_invalid_values"] == ["False"]
