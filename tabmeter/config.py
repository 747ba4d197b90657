"""Default weights and thresholds, and the accessors for a rule dictionary.

A configuration is a plain dictionary, so one read from YAML can be passed as
it is. Scoring and validation settings are merged by their top-level keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Pillars in order of evaluation.
PILLARS = (
    "completeness",
    "validity",
    "uniqueness",
    "consistency",
    "timeliness",
    "accuracy",
    "ai_readiness",
)

# Weights, thresholds and quality bands.
DEFAULT_SCORING = {
    "pillars": {
        "completeness": {
            "weight": 0.20,
            "thresholds": {"critical_null_pct": 50.0, "warning_null_pct": 20.0},
        },
        "validity": {"weight": 0.15},
        "uniqueness": {"weight": 0.10, "thresholds": {"max_duplicate_pct": 5.0}},
        "consistency": {"weight": 0.15},
        "timeliness": {"weight": 0.10, "thresholds": {"max_gap_days": 90}},
        "accuracy": {
            "weight": 0.15,
            "thresholds": {"zscore_threshold": 3.0, "isolation_contamination": 0.05},
        },
        "ai_readiness": {
            "weight": 0.15,
            "thresholds": {
                "max_correlation": 0.95,
                "min_class_ratio": 0.15,
                "max_skewness": 10.0,
            },
        },
    },
    "bands": {
        "excellent": {"min": 85, "label": "Excellent — Ready for ML", "color": "#2ecc71"},
        "good": {"min": 70, "label": "Good — Minor fixes needed", "color": "#f39c12"},
        "at_risk": {
            "min": 50,
            "label": "At Risk — Significant remediation required",
            "color": "#e67e22",
        },
        "not_ready": {
            "min": 0,
            "label": "Not Ready — Not suitable for AI",
            "color": "#e74c3c",
        },
    },
}


@dataclass(frozen=True)
class Rules:
    """Typed view of a rule dictionary; absent settings take their defaults."""

    config: dict = field(default_factory=dict)

    @classmethod
    def of(cls, config: "dict | Rules | None") -> "Rules":
        return config if isinstance(config, Rules) else cls(config or {})

    def threshold(self, pillar: str, name: str):
        default = DEFAULT_SCORING["pillars"][pillar]["thresholds"][name]
        pillars = self.config.get("pillars") or {}
        return ((pillars.get(pillar) or {}).get("thresholds") or {}).get(name, default)

    def column_rules(self, name: str) -> list:
        return (self.config.get("columns") or {}).get(name) or []

    @property
    def consistency(self) -> list[dict]:
        return self.config.get("consistency_rules") or []

    @property
    def date_window(self) -> tuple[str | None, str | None]:
        window = (self.config.get("dataset") or {}).get("expected_date_range") or {}
        return window.get("start"), window.get("end")

    @property
    def target(self) -> str | None:
        return (self.config.get("ai_readiness") or {}).get("target_column")

    @property
    def id_columns(self) -> list[str]:
        return (self.config.get("ai_readiness") or {}).get("id_columns") or []

    @property
    def leakage_columns(self) -> list[str]:
        return (self.config.get("ai_readiness") or {}).get("leakage_risk_columns") or []
