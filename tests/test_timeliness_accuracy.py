import datetime as dt

import numpy as np
import pandas as pd

from tabmeter import check_accuracy, check_timeliness
from tabmeter.operators.forest import isolation_forest, scored_rows
from tabmeter.operators.timeliness import max_gaps

WINDOW = {"dataset": {"expected_date_range": {"start": "2020-01-01", "end": "2020-12-31"}}}


def dated(spark, *values, kind="timestamp_ntz"):
    return spark.createDataFrame([(v,) for v in values], f"order_date {kind}")


def test_no_date_column_is_neutral(spark):
    found = check_timeliness(spark.createDataFrame([(1, "x")], "a int, b string"), {})
    assert (found.score, found.passed_checks, found.total_checks) == (70.0, 0, 1)


def test_gap_and_window(spark):
    df = dated(
        spark,
        dt.datetime(2019, 12, 31, 23),
        dt.datetime(2020, 1, 1),
        dt.datetime(2020, 6, 1, 1),
        dt.datetime(2021, 1, 1),
    )
    found = check_timeliness(df, WINDOW)
    assert found.details["columns"]["order_date"] == {
        "min_date": "2019-12-31",
        "max_date": "2021-01-01",
        "date_range_days": 366,
        "max_gap_days": 214,
    }
    assert found.issues == [
        "Column 'order_date': earliest date 2019-12-31 is before expected start 2020-01-01",
        "Column 'order_date': latest date 2021-01-01 is after expected end 2020-12-31",
        "Column 'order_date': maximum temporal gap is 214 days (threshold: 90)",
    ]
    assert found.score == 33.33


def test_end_bound_is_midnight(spark):
    df = dated(spark, dt.datetime(2020, 12, 30), dt.datetime(2020, 12, 31, 12))
    assert check_timeliness(df, WINDOW).passed_checks == 2


def test_too_few_dates(spark):
    found = check_timeliness(dated(spark, "2020-01-01", None, kind="string"), {})
    assert (found.score, found.total_checks) == (100.0, 1)
    assert "message" in found.details["columns"]["order_date"]


def test_detection_by_name_needs_most_values_to_parse(spark):
    good = dated(spark, *["2020-01-01"] * 8, "x", "y", kind="string")
    bad = dated(spark, *["2020-01-01"] * 7, "x", "y", "z", kind="string")
    assert check_timeliness(good, {}).details["columns"]["order_date"]["max_gap_days"] == 0
    assert check_timeliness(bad, {}).score == 70.0


def test_numbers_as_dates(spark):
    df = spark.createDataFrame([(86_400_000_000_000 * d,) for d in (0, 1, 5)], "event_time bigint")
    found = check_timeliness(df, {}).details["columns"]["event_time"]
    assert (found["min_date"], found["max_date"], found["max_gap_days"]) == (
        "1970-01-01",
        "1970-01-06",
        4,
    )


def test_numbers_too_large_for_a_date(spark):
    rows = [(float(v),) for v in (0, -1, 86_400e9, 1e300, "inf", "-inf")]
    found = check_timeliness(spark.createDataFrame(rows, "event_time double"), {})
    # Half of the values are no dates, so the column is not one of dates.
    assert found.score == 70.0
    configured = {"columns": {"datetime_columns": ["event_time"]}}
    found = check_timeliness(spark.createDataFrame(rows, "event_time double"), configured)
    assert found.details["columns"]["event_time"]["min_date"] == "1969-12-31"
    assert found.issues[0].startswith("Column 'event_time': 3 values could not be parsed")


def test_years_of_more_than_four_digits_do_not_parse(spark):
    df = dated(spark, "2020-01-01", "2020-01-02", "+12020-01-01", "0000-01-01", "202", kind="string")
    found = check_timeliness(df, {"columns": {"datetime_columns": ["order_date"]}})
    assert found.issues == ["Column 'order_date': 3 values could not be parsed as datetime"]


def test_gaps_do_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("date_add(DATE'2020-01-01', CAST(id * id % 977 AS INT)) AS d")
    gaps = {max_gaps(df.repartition(n), ["d"]).first()["max_gap_days"] for n in (1, 3, 8)}
    days = pd.Series(sorted({int(i * i % 977) for i in range(1000)}))
    assert gaps == {int(days.diff().max())}


def test_zscore(spark):
    rows = [(float(i % 10), 7, None) for i in range(99)] + [(1000.0, 7, 1.0)]
    found = check_accuracy(spark.createDataFrame(rows, "v double, flat int, few double"), {})
    columns = found.details["column_outliers"]
    assert columns["v"]["outlier_count"] == 1
    assert columns["flat"] == {"skipped": True} and columns["few"] == {"skipped": True}
    # One flag among 300 cells is 0.33 %.
    assert found.score == 98.35
    assert found.details["isolation_forest"]["skipped"]


def test_infinity_flags_nothing(spark):
    rows = [(float(i),) for i in range(50)] + [(float("inf"),)]
    found = check_accuracy(spark.createDataFrame(rows, "v double"), {})
    assert found.details["column_outliers"]["v"]["outlier_count"] == 0


def test_no_numbers(spark):
    found = check_accuracy(spark.createDataFrame([("x",)], "a string"), {})
    assert (found.score, found.passed_checks, found.total_checks) == (100.0, 1, 1)


def cloud(spark, n=600):
    rng = np.random.default_rng(1)
    inner = rng.normal(size=(n - 6, 3))
    outer = rng.normal(size=(6, 3)) + 25 * np.sign(rng.normal(size=(6, 3)))
    return spark.createDataFrame(pd.DataFrame(np.vstack([inner, outer]), columns=list("abc")))


def test_forest_isolates_planted_outliers(spark):
    scored = scored_rows(cloud(spark)).toPandas()
    top = scored.sort_values("score", ascending=False).head(6)
    assert (top[["a", "b", "c"]].abs().max(axis=1) > 15).all()
    assert scored["score"].between(0, 1).all()


def test_forest_flags_the_expected_share(spark):
    found = isolation_forest(cloud(spark), 0.05).first()
    assert found["sample_size"] == 600
    assert 0 < found["outlier_count"] <= 30
    assert found["outlier_pct"] <= 5.0


def test_forest_survives_a_third_of_equal_rows_and_infinities(spark):
    df = cloud(spark).union(spark.createDataFrame([(0.0, 0.0, 0.0)] * 300, "a double, b double, c double"))
    df = df.union(spark.createDataFrame([(float("inf"), 0.0, 0.0)], "a double, b double, c double"))
    found = isolation_forest(df, 0.05).first()
    assert found["sample_size"] == 901
    assert found["outlier_count"] <= 45


def test_forest_on_many_rows_draws_a_row_per_tree_at_most(spark):
    df = spark.range(60_000).selectExpr("id % 1009 AS a", "id * 31 % 977 AS b")
    found = isolation_forest(df, 0.05).first()
    assert found["sample_size"] == 60_000
    assert 1000 < found["outlier_count"] <= 3000


def test_forest_needs_enough_data(spark):
    few = spark.range(49).selectExpr("id a", "id * 2 b")
    assert isolation_forest(few) is None
    assert isolation_forest(spark.range(500)) is None


def test_date_options_and_prepared_tables(spark):
    from tabmeter.table import Table

    df = spark.createDataFrame([("2020.01.05",), ("2020.01.09",)], "sent_date string")
    rules = {"columns": {"datetime_columns": ["sent_date"]}}
    assert check_timeliness(df, rules).details["columns"]["sent_date"]["message"]
    for source in (df, Table.of(df)):
        for stage in (False, True):
            found = check_timeliness(source, rules, formats=["yyyy.MM.dd"], materialize=stage)
            assert found.details["columns"]["sent_date"]["max_gap_days"] == 4


def test_years_beyond_pythons(spark):
    df = spark.sql("SELECT timestamp_ntz'+12000-01-01' AS d UNION ALL SELECT timestamp_ntz'2020-01-01'")
    rules = {"dataset": {"expected_date_range": {"start": "2019-01-01", "end": "2030-12-31"}}}
    found = check_timeliness(df.withColumnRenamed("d", "sent_date"), rules)
    assert found.details["columns"]["sent_date"]["max_date"] == "+12000-01-01"
    assert any("after expected end 2030-12-31" in issue for issue in found.issues)
