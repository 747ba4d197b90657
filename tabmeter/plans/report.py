"""Result tables and the JSON sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabmeter.config import PILLARS
from tabmeter.plans.scoring import ScoreResult

# Labels of the pillars, and status by score.
LABELS = {
    "completeness": "Completeness",
    "validity": "Validity",
    "uniqueness": "Uniqueness",
    "consistency": "Consistency",
    "timeliness": "Timeliness",
    "accuracy": "Accuracy",
    "ai_readiness": "AI Readiness",
}
TOTAL_LABEL = "**OVERALL**"
STATUS = ((85, "Excellent"), (70, "Good"), (50, "At Risk"))
LOWEST_STATUS = "Not Ready"

PILLAR_SCHEMA = (
    "pillar string, score double, weight double, weighted_score double, "
    "issues array<string>, passed_checks int, total_checks int"
)


def pillar_frame(spark: SparkSession, result: ScoreResult) -> DataFrame:
    """One row per pillar, in order."""
    rows = [
        (p.name, p.score, p.weight, p.weighted_score, p.issues, p.passed_checks, p.total_checks)
        for p in result.pillars.values()
    ]
    return spark.createDataFrame(rows, PILLAR_SCHEMA)


def status_of(score: float) -> str:
    return next((word for limit, word in STATUS if score >= limit), LOWEST_STATUS)


def score_table(spark: SparkSession, result: ScoreResult) -> DataFrame:
    """The scorecard: formatted pillars and a total row."""
    rows = [
        (
            LABELS.get(p.name, p.name),
            f"{p.weight * 100:.0f}%",
            f"{p.score:.1f}",
            f"{p.weighted_score:.2f}",
            f"{p.passed_checks}/{p.total_checks}",
            status_of(p.score),
        )
        for p in result.pillars.values()
    ]
    total = result.overall_score
    rows.append((TOTAL_LABEL, "100%", f"{total:.1f}", f"{total:.2f}", "", status_of(total)))
    names = ("Pillar", "Weight", "Score", "Weighted", "Checks Passed", "Status")
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def issue_frame(spark: SparkSession, result: ScoreResult) -> DataFrame:
    """(pillar, seq, issue) of every finding, in order of the pillars."""
    rows = [
        (name, seq, issue)
        for name in PILLARS
        for seq, issue in enumerate(result.pillars[name].issues)
    ]
    return spark.createDataFrame(rows, "pillar string, seq int, issue string")


def recommendation_frame(spark: SparkSession, result: ScoreResult) -> DataFrame:
    """(seq, recommendation), most urgent first."""
    rows = list(enumerate(result.recommendations, 1))
    return spark.createDataFrame(rows, "seq int, recommendation string")


def column_table(spark: SparkSession, stats: dict) -> DataFrame:
    """Column statistics of a profile, in order of the columns."""
    rows = [
        (
            name,
            info["null_pct"],
            info["unique_count"],
            info["cardinality_ratio"],
            info.get("mean"),
            info.get("std"),
            info.get("skewness"),
        )
        for name, info in stats["columns"].items()
    ]
    names = ("Column", "Null %", "Unique", "Cardinality", "Mean", "Std", "Skewness")
    kinds = ("string", "double", "bigint", "double", "double", "double", "double")
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def result_to_json(result: ScoreResult) -> str:
    return result.to_json()


def write_result(spark: SparkSession, result: ScoreResult, path: str, mode: str = "error") -> None:
    """Write the result as one JSON record."""
    rows = spark.createDataFrame([(result.to_json(),)], "value string")
    rows.coalesce(1).write.mode(mode).text(path, lineSep="\n")
