"""Row schemas and the small typed configuration that is compiled into columns."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column

#: The fact row: one scored answer.
RESULT = "task_id string, success boolean, score double, metrics map<string,double>, details string, error string, execution_time double, cost double, latency double"
#: What is persisted of a result: all but the latency.
SAVED_RESULT = "task_id string, success boolean, score double, metrics map<string,double>, details string, error string, execution_time double, cost double"
TASK = "task_id string, instruction string, expected_output string, metadata map<string,string>"
METRIC_TYPES = ("numeric", "binary", "llm_judge")
#: What the ``evaluation`` part of a task may hold besides method, metrics and criteria.
SETTINGS = ("threshold", "weight_rouge_1", "weight_rouge_2", "weight_rouge_l")
OPERATORS = (">=", "<=", ">", "<", "==", "!=")


@dataclass(frozen=True)
class Metric:
    """A metric to read from an answer's JSON object."""

    name: str
    type: str = "numeric"


@dataclass(frozen=True)
class Criterion:
    """A condition on a metric; a boolean target compares truth and ignores the operator."""

    metric: str
    operator: str
    value: float | bool

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS and not isinstance(self.value, bool):
            raise ValueError(f"unknown operator {self.operator!r}")


@dataclass(frozen=True)
class ScorerConfig:
    """What a scorer needs: method, metrics, criteria, and method-specific settings.

    Metrics and criteria may be columns instead, arrays of structs in the row that is scored, and so may single settings: then rows of many tasks are scored as one table.
    """

    method: str = "metric_based"
    metrics: tuple[Metric, ...] | Column = ()
    criteria: tuple[Criterion, ...] | Column = ()
    settings: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, config: dict[str, Any]) -> ScorerConfig:
        """From the ``evaluation`` part of a task configuration; a criterion without operator means at least. Unknown keys are kept with a warning."""
        settings = {k: v for k, v in config.items() if k not in ("scoring_method", "metrics", "success_criteria")}
        for k in settings.keys() - set(SETTINGS):
            warnings.warn(f"unknown key {k!r} in the evaluation of a task", stacklevel=2)
        return cls(
            config.get("scoring_method", "metric_based"),
            tuple(Metric(m["name"], m.get("type", "numeric")) for m in config.get("metrics") or ()),
            tuple(Criterion(c["metric"], c.get("operator", ">="), c["value"]) for c in config.get("success_criteria") or ()),
            settings,
        )
