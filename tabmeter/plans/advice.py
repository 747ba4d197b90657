"""Prioritised remediation advice from the findings of the pillars."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

# Score limits, and the wording by priority (1 is most urgent).
CRITICAL = 60.0
ATTENTION = 80.0
EXCELLENT = 85
MAX_ADVICE = 10

EXCELLENT_TIP = (
    "Data is in excellent shape. Consider setting up automated monitoring "
    "with Evidently AI or Great Expectations CI/CD integration."
)

TEMPORAL_GAPS = (
    3,
    "Temporal gaps detected in date columns. "
    "Check for data pipeline failures during gap periods. "
    "Consider imputing or flagging gap records for time-series models.",
)

# Advice by pillar for a score below CRITICAL and below ATTENTION.
BY_SCORE = {
    "completeness": (
        (
            1,
            "CRITICAL: High missing data detected. Drop columns with >80% null values; "
            "impute remaining using median (numeric) or mode (categorical).",
        ),
        (
            2,
            "Impute missing values: use median/mean for numeric fields, "
            "mode or 'Unknown' for categoricals.",
        ),
    ),
    "validity": (
        (
            1,
            "CRITICAL: Many values fail schema/range validation. "
            "Enforce data contracts at ingestion time with Great Expectations.",
        ),
        (
            2,
            "Apply value range clipping or filtering to remove invalid records "
            "before model training.",
        ),
    ),
    "consistency": (
        (
            1,
            "CRITICAL: Cross-field logic violations detected. "
            "Review date ordering and derived field calculations in ETL pipeline.",
        ),
        (
            2,
            "Fix inconsistent records: shipping dates before order dates, "
            "mismatched delivery status/risk flags.",
        ),
    ),
    "timeliness": (TEMPORAL_GAPS, TEMPORAL_GAPS),
    "accuracy": (
        (
            1,
            "CRITICAL: High outlier rate. Apply IQR capping or "
            "log-transform heavily skewed numeric features before training.",
        ),
        (
            2,
            "Apply outlier treatment: Winsorize (clip to 1st/99th percentile) "
            "or use robust scalers (RobustScaler) for ML pipelines.",
        ),
    ),
}

# Advice that names what was found.
NULL_COLUMNS = "Drop or investigate these high-null columns: {names}. They add noise to ML models."
NULL_ROWS = (
    "{pct}% of rows have >50% missing fields. "
    "Consider removing these records from training data."
)
ENUM_VALUES = (
    "Standardise categorical values in '{column}': found {n} unexpected values. "
    "Map or discard outlier categories."
)
MANY_DUPLICATES = (
    "CRITICAL: {pct}% duplicate rows. "
    "Deduplicate using df.drop_duplicates() before analysis."
)
SOME_DUPLICATES = (
    "{pct}% duplicate rows detected. "
    "Remove duplicates — they inflate training samples and bias models."
)
OUTLIER_COLUMNS = (
    "Columns with >5% outliers: {names}. "
    "Investigate business logic — outliers may be valid edge cases or data errors."
)
LEAKAGE = (
    "CRITICAL DATA LEAKAGE RISK: Remove or isolate columns {names} "
    "before training — they directly encode the target variable."
)
COLLINEAR = (
    "Multicollinearity detected in features: {names}. "
    "Use VIF analysis and drop one from each highly correlated pair, "
    "or apply PCA for dimensionality reduction."
)
ZERO_VARIANCE = "Drop zero-variance columns (no predictive value): {names}"
IMBALANCE = (
    "Target class imbalance detected. Apply SMOTE, ADASYN, "
    "or class_weight='balanced' in your ML model."
)
SKEWED = "Apply log or Box-Cox transform to highly skewed columns: {names}"
FEW_FEATURES = (
    "Very few numeric features available. "
    "Consider feature engineering from existing columns "
    "(date components, ratios, interaction terms)."
)


@dataclass(frozen=True)
class Finding:
    """Advice for what a pillar's details show: `read` yields the words to fill
    in, once per message."""

    pillar: str
    priority: int
    message: str
    read: Callable[[dict], Iterator[dict]]


def _when(key: str, test: Callable[[float], bool]) -> Callable[[dict], Iterator[dict]]:
    """A number among the details which passes the test."""

    def read(details: dict) -> Iterator[dict]:
        if key in details and test(details[key]):
            yield {"pct": details[key]}

    return read


def _names(key: str, most: int | None = None) -> Callable[[dict], Iterator[dict]]:
    """Columns listed among the details."""

    def read(details: dict) -> Iterator[dict]:
        if details.get(key):
            yield {"names": list(details[key])[:most]}

    return read


def _enums(details: dict) -> Iterator[dict]:
    for column, info in details.get("enum_checks", {}).items():
        if info["invalid_count"]:
            yield {"column": column, "n": info["invalid_count"]}


def _outliers(details: dict) -> Iterator[dict]:
    columns = details.get("column_outliers", {})
    far = [c for c, info in columns.items() if info.get("outlier_pct", 0) > 5]
    if far:
        yield {"names": far[:5]}


def _pairs(details: dict) -> Iterator[dict]:
    pairs = details.get("high_correlation_pairs")
    if pairs:
        yield {"names": list(dict.fromkeys(c for pair in pairs for c in pair[:2]))[:6]}


def _imbalance(details: dict) -> Iterator[dict]:
    if details.get("class_balance", {}).get("minority_class_ratio", 1.0) < 0.15:
        yield {}


FINDINGS = (
    Finding("completeness", 1, NULL_COLUMNS, _names("critical_columns", 5)),
    Finding("completeness", 2, NULL_ROWS, _when("bad_row_pct", lambda p: p > 10)),
    Finding("validity", 3, ENUM_VALUES, _enums),
    Finding("uniqueness", 1, MANY_DUPLICATES, _when("duplicate_pct", lambda p: p > 10)),
    Finding("uniqueness", 2, SOME_DUPLICATES, _when("duplicate_pct", lambda p: 2 < p <= 10)),
    Finding("accuracy", 2, OUTLIER_COLUMNS, _outliers),
    Finding("ai_readiness", 1, LEAKAGE, _names("leakage_risk_columns")),
    Finding("ai_readiness", 2, COLLINEAR, _pairs),
    Finding("ai_readiness", 2, ZERO_VARIANCE, _names("zero_variance_columns")),
    Finding("ai_readiness", 2, IMBALANCE, _imbalance),
    Finding("ai_readiness", 3, SKEWED, _names("highly_skewed_columns", 5)),
    Finding("ai_readiness", 2, FEW_FEATURES, _when("feature_count", lambda n: n < 5)),
)


def prioritized(pillars: dict) -> list[tuple[int, str]]:
    """(priority, message) in order of urgency, then of pillars."""
    advice = []
    for name, result in pillars.items():
        if name in BY_SCORE and result.score < ATTENTION:
            advice.append(BY_SCORE[name][0 if result.score < CRITICAL else 1])
        for finding in FINDINGS:
            if finding.pillar == name:
                for words in finding.read(result.details):
                    advice.append((finding.priority, finding.message.format(**words)))
    return sorted(advice, key=lambda entry: entry[0])


def recommend(pillars: dict, overall: float, most: int = MAX_ADVICE) -> list[str]:
    """Distinct messages, most urgent first, no more than `most`."""
    messages = list(dict.fromkeys(message for _, message in prioritized(pillars)))
    if overall >= EXCELLENT:
        messages.append(EXCELLENT_TIP)
    return messages[:most]
