import pytest

from tabmeter import check_ai_readiness
from tabmeter.operators.ai_readiness import class_counts

RULES = {
    "pillars": {
        "ai_readiness": {
            "thresholds": {"max_correlation": 0.9, "min_class_ratio": 0.2, "max_skewness": 8.0}
        }
    },
    "ai_readiness": {"target_column": "alarm", "id_columns": ["reading"], "leakage_risk_columns": ["siren"]},
}
#: Sensor readings by fixed expressions: five features that have little to do with each other.
READINGS = {
    "reading": "id",
    "level": "id % 37",
    "drift": "sin(id * 2.7) * 40",
    "load": "(id * 7919) % 1009 / 1009.0D",
    "pressure": "cos(id * id)",
    "flow": "log(2 + (id * 613) % 997)",
    "alarm": "CAST(id % 8 < 3 AS INT)",
}


def readings(spark, rows=320, **changes):
    return spark.range(rows).selectExpr(*[f"{expr} AS {name}" for name, expr in (READINGS | changes).items()])


def check(spark, **changes):
    return check_ai_readiness(readings(spark, **changes), RULES)


def test_sound_readings(spark):
    found = check(spark)
    assert (found.score, found.passed_checks, found.total_checks) == (100.0, 6, 6)


@pytest.mark.parametrize("classes", [2, 1000, 1001, 2000])
def test_details_look_alike_for_few_and_many_classes(spark, classes):
    frame = readings(spark, rows=2 * classes, alarm=f"id % {classes}")
    found = check_ai_readiness(frame, RULES).details["class_balance"]
    assert found == {
        "target_column": "alarm",
        "class_count": classes,
        "minority_count": 2,
        "minority_class_ratio": round(1 / classes, 4),
    }
    assert class_counts(frame, "alarm").count() == classes


def test_a_copy_of_the_target_leaks(spark):
    found = check(spark, siren="CAST(id % 8 < 3 AS STRING)")
    assert found.score == 83.33
    assert found.issues == [
        "Potential data leakage: columns ['siren'] may directly encode the target. "
        "Review before training."
    ]


def test_a_rare_class(spark):
    found = check(spark, alarm="CAST(id % 16 = 0 AS INT)")
    assert found.score == 83.33
    assert found.details["class_balance"]["minority_class_ratio"] == 0.0625
    assert "minority class ratio: 6.2% (threshold: 20.0%)" in found.issues[0]


def test_one_class_passes(spark):
    found = check(spark, alarm="1")
    assert found.score == 100.0
    assert "note" in found.details["class_balance"]


def test_a_scaled_copy_correlates(spark):
    found = check(spark, flow="3 - 2.5 * sin(id * 2.7)")
    assert found.score == 83.33
    assert found.details["high_correlation_pairs"] == [("flow", "drift", 1.0)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_constant_columns(spark, partitions):
    frame = readings(spark, full="7", tenth="0.1D").repartition(partitions)
    found = check_ai_readiness(frame, RULES)
    assert found.score == 83.33
    assert found.details["zero_variance_columns"] == ["full", "tenth"]


@pytest.mark.parametrize("scale", ["1", "1e-9"])
def test_extreme_skew_at_any_scale(spark, scale):
    found = check(spark, load=f"IF(id = 11, 500D, 0D) * {scale}")
    assert found.details["highly_skewed_columns"] == {"load": 17.89}


def test_few_features(spark):
    found = check_ai_readiness(readings(spark).select("reading", "drift", "alarm"), RULES)
    assert found.issues == ["Only 1 numeric feature columns available for ML (minimum: 5)"]


def test_no_rows(spark):
    assert check_ai_readiness(readings(spark, rows=0), RULES).score == 0.0
