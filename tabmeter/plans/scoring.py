"""The whole assessment: seven pillars, one weighted score.

All pillars state the aggregates they need; two fused passes over the table
answer them. What needs a shuffle of its own (repeated rows, day gaps, classes,
invalid samples, the forest) then runs side by side, as independent jobs.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from dataclasses import dataclass, field
from datetime import datetime
from functools import partial
from types import ModuleType

from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.errors import PythonException, QueryExecutionException, UnknownException
from pyspark.sql import DataFrame

from tabmeter.config import DEFAULT_SCORING, PILLARS, Rules
from tabmeter.operators import (
    accuracy,
    ai_readiness,
    completeness,
    consistency,
    timeliness,
    uniqueness,
    validity,
)
from tabmeter.plans.advice import recommend
from tabmeter.plans.staging import staged
from tabmeter.plans.statpass import run_probes
from tabmeter.result import Outcome, no_rows
from tabmeter.table import Table

logger = logging.getLogger(__name__)

MODULES: dict[str, ModuleType] = {
    "completeness": completeness,
    "validity": validity,
    "uniqueness": uniqueness,
    "consistency": consistency,
    "timeliness": timeliness,
    "accuracy": accuracy,
    "ai_readiness": ai_readiness,
}

# Errors of the engine and its workers. They say nothing of the rules or the data.
ENGINE_ERRORS = (Py4JError, PythonException, QueryExecutionException, UnknownException, MemoryError)

# Wording for a pillar that cannot run, colours without a band.
FAILED_ISSUE = "Pillar failed: {error}"
PLAIN_COLOR = "#666666"
LAST_BAND = ("not_ready", "Not Ready", "#e74c3c")
BANDS = ("excellent", "good", "at_risk", "not_ready")


@dataclass
class PillarResult:
    name: str
    score: float
    weight: float
    weighted_score: float
    issues: list[str]
    details: dict
    passed_checks: int
    total_checks: int


@dataclass
class ScoreResult:
    overall_score: float
    band: str
    band_label: str
    band_color: str
    pillars: dict[str, PillarResult]
    all_issues: list[str]
    recommendations: list[str]
    dataset_stats: dict
    timestamp: str = field(default_factory=lambda: datetime.now().isoformat())

    def to_dict(self) -> dict:
        shown = ("score", "weight", "issues", "passed_checks", "total_checks")
        return {
            "overall_score": self.overall_score,
            "band": self.band,
            "band_label": self.band_label,
            "timestamp": self.timestamp,
            "dataset_stats": self.dataset_stats,
            "pillars": {n: {k: getattr(p, k) for k in shown} for n, p in self.pillars.items()},
            "recommendations": self.recommendations,
            "all_issues": self.all_issues,
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, default=str)


def determine_band(score: float, config: dict | None) -> tuple[str, str, str]:
    """(key, label, colour) of the first band the score reaches."""
    bands = (config or {}).get("bands") or {}
    for key in BANDS:
        band = bands.get(key) or {}
        if score >= band.get("min", 0):
            label = band.get("label", key.replace("_", " ").title())
            return key, label, band.get("color", PLAIN_COLOR)
    return LAST_BAND


def _date_columns(table: Table, rules: Rules) -> list[str]:
    """Columns that some pillar reads as dates."""
    compared = [r.get(side) for r in rules.consistency for side in ("left_column", "right_column")]
    return [*timeliness.candidates(table, rules), *(c for c in compared if c in table)]


def check(
    pillar: str,
    source: DataFrame | Table,
    config: dict | None = None,
    *,
    materialize: bool = False,
    **date_options,
) -> Outcome:
    """One pillar alone; `materialize` and the date options as for `score`."""
    if materialize:
        prepared = isinstance(source, Table)
        options = (source.date_options if prepared else {}) | date_options
        with staged(source.df if prepared else source) as df:
            return check(pillar, df, config, **options)
    table, rules = Table.of(source, **date_options), Rules.of(config)
    table = table.with_dates(_date_columns(table, rules))
    module = MODULES[pillar]
    stats = run_probes(table.df, module.probes(table, rules))
    if not stats["rows"]:
        return no_rows()
    if hasattr(module, "follow_up"):
        stats |= run_probes(table.df, module.follow_up(table, rules, stats))
    return module.assess(table, rules, stats)


check_completeness: Callable[..., Outcome] = partial(check, "completeness")
check_validity: Callable[..., Outcome] = partial(check, "validity")
check_uniqueness: Callable[..., Outcome] = partial(check, "uniqueness")
check_consistency: Callable[..., Outcome] = partial(check, "consistency")
check_timeliness: Callable[..., Outcome] = partial(check, "timeliness")
check_accuracy: Callable[..., Outcome] = partial(check, "accuracy")
check_ai_readiness: Callable[..., Outcome] = partial(check, "ai_readiness")


def score(
    source: DataFrame,
    scoring_config: dict | None = None,
    validation_config: dict | None = None,
    profile_stats: dict | None = None,
    *,
    materialize: bool = False,
    **date_options,
) -> ScoreResult:
    """Assess a table by all seven pillars.

    `materialize` first writes the table to the shared scratch folder, as
    columns. Use it where the table is costly to compute or not columnar (a
    join, CSV, JSON): the passes then read only what they need of it.
    """
    scoring = DEFAULT_SCORING if scoring_config is None else scoring_config
    rules = Rules.of({**scoring, **(validation_config or {})})
    with ExitStack() as stack:
        df = stack.enter_context(staged(source)) if materialize else source
        table = Table.of(df, **date_options)
        table = table.with_dates(_date_columns(table, rules))
        rows, outcomes = _run_pillars(table, rules)

    pillars = {}
    for name in PILLARS:
        found = outcomes[name]
        weight = ((scoring.get("pillars") or {}).get(name) or {}).get("weight", 1 / 7)
        value = float(found.score)
        pillars[name] = PillarResult(
            name,
            value,
            weight,
            round(value * weight, 4),
            found.issues,
            found.details,
            found.passed_checks,
            found.total_checks,
        )
    overall = round(sum(p.weighted_score for p in pillars.values()), 2)
    band, label, color = determine_band(overall, scoring)
    dataset = {"row_count": rows, "column_count": len(table.columns)}
    if profile_stats:
        empty = {
            "duplicate_rows": 0,
            "duplicate_pct": 0.0,
            "overall_missing_pct": 0.0,
            "memory_mb": 0.0,
        }
        dataset |= {k: profile_stats.get(k, v) for k, v in empty.items()}
    return ScoreResult(
        overall_score=overall,
        band=band,
        band_label=label,
        band_color=color,
        pillars=pillars,
        all_issues=[issue for p in pillars.values() for issue in p.issues],
        recommendations=recommend(pillars, overall),
        dataset_stats=dataset,
    )


def _run_pillars(table: Table, rules: Rules) -> tuple[int, dict[str, Outcome]]:
    failed: dict[str, Outcome] = {}

    def gather(ask: Callable[[ModuleType], list]) -> list:
        """What the pillars ask for; one whose rules cannot be planned fails alone.
        ENGINE_ERRORS are raised."""
        wanted = []
        for name, module in MODULES.items():
            if name in failed:
                continue
            try:
                asked = ask(module)
                if asked:
                    # Resolves the expressions without running anything.
                    table.df.agg(*[p.expr for p in asked])
                wanted += asked
            except ENGINE_ERRORS:
                raise
            except Exception as error:
                failed[name] = _failure(name, error)
        return wanted

    stats = run_probes(table.df, [*gather(lambda m: m.probes(table, rules))])
    rows = int(stats.get("rows", 0))
    if rows:
        second = gather(
            lambda m: m.follow_up(table, rules, stats) if hasattr(m, "follow_up") else []
        )
        stats |= run_probes(table.df, second)

    def assess(name: str) -> Outcome:
        try:
            return MODULES[name].assess(table, rules, stats)
        except ENGINE_ERRORS:
            raise
        except Exception as error:
            return _failure(name, error)

    pending = [n for n in MODULES if n not in failed]
    with ThreadPoolExecutor(len(MODULES)) as pool:
        tasks = {
            n: pool.submit(inheritable_thread_target(table.spark)(assess), n) for n in pending
        }
        outcomes = {n: t.result() for n, t in tasks.items()}
    return rows, outcomes | failed


def _failure(name: str, error: Exception) -> Outcome:
    logger.error("Pillar '%s' failed with error: %s", name, error)
    return Outcome(0.0, 0, 1, [FAILED_ISSUE.format(error=error)], {})
