"""Data-quality scoring of tables for machine learning, on Spark."""

from tabmeter.config import DEFAULT_SCORING, Rules
from tabmeter.operators.profile import dataset_summary, profile
from tabmeter.operators.schema import classify_columns, detect_schema
from tabmeter.plans.advice import recommend
from tabmeter.plans.report import (
    column_table,
    issue_frame,
    pillar_frame,
    recommendation_frame,
    result_to_json,
    score_table,
    write_result,
)
from tabmeter.plans.scoring import (
    PillarResult,
    ScoreResult,
    check_accuracy,
    check_ai_readiness,
    check_completeness,
    check_consistency,
    check_timeliness,
    check_uniqueness,
    check_validity,
    determine_band,
    score,
)
from tabmeter.sources.files import load_table, write_csv
from tabmeter.table import Table

__all__ = [
    "DEFAULT_SCORING",
    "PillarResult",
    "Rules",
    "ScoreResult",
    "Table",
    "check_accuracy",
    "check_ai_readiness",
    "check_completeness",
    "check_consistency",
    "check_timeliness",
    "check_uniqueness",
    "check_validity",
    "classify_columns",
    "column_table",
    "dataset_summary",
    "detect_schema",
    "determine_band",
    "issue_frame",
    "load_table",
    "pillar_frame",
    "profile",
    "recommend",
    "recommendation_frame",
    "result_to_json",
    "score",
    "score_table",
    "write_csv",
    "write_result",
]
