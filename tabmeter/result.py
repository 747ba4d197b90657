"""What a check returns."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

NO_ROWS = "Dataset has no rows"

OUTCOME_SCHEMA = (
    "pillar string, score double, passed_checks int, total_checks int, issues array<string>"
)


@dataclass
class Outcome:
    """Score and findings of one pillar."""

    score: float
    passed_checks: int
    total_checks: int
    issues: list[str] = field(default_factory=list)
    details: dict[str, Any] = field(default_factory=dict)

    def to_dict(self) -> dict[str, Any]:
        return {
            "score": self.score,
            "details": self.details,
            "issues": self.issues,
            "passed_checks": self.passed_checks,
            "total_checks": self.total_checks,
        }

    def to_frame(self, spark: SparkSession, pillar: str) -> DataFrame:
        row = (pillar, float(self.score), self.passed_checks, self.total_checks, self.issues)
        return spark.createDataFrame([row], OUTCOME_SCHEMA)


def no_rows() -> Outcome:
    return Outcome(0.0, 0, 1, [NO_ROWS], {"reason": NO_ROWS})


@dataclass
class Tally:
    """Counts checks while they are evaluated."""

    passed: int = 0
    total: int = 0
    issues: list[str] = field(default_factory=list)

    def check(self, ok: bool, issue: str | None = None) -> None:
        self.total += 1
        if ok:
            self.passed += 1
        elif issue is not None:
            self.issues.append(issue)

    def score(self, if_none: float = 100.0) -> float:
        return round(self.passed / self.total * 100, 2) if self.total else if_none

    def outcome(self, score: float, details: dict) -> Outcome:
        return Outcome(round(score, 2), self.passed, self.total, self.issues, details)


def share(part: float, whole: float, digits: int = 2) -> float:
    """Percentage rounded the way Python rounds; 0.0 for an empty whole."""
    return round(part / whole * 100, digits) if whole else 0.0
