"""An evaluation run: tasks joined with stored answers, scored, aggregated, saved."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..model import ScorerConfig
from ..operators import aggregate, retrieval, scorers
from ..sources.config import TaskConfig
from ..sources.jsonl import save_aggregate, save_results

assert retrieval.citation  # registers itself among the scorers


def run(tasks: DataFrame, answers: DataFrame, config: TaskConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """Result rows of ``tasks`` (task_id, expected_output) with ``answers`` (task_id, predicted_output, and execution_time, cost, latency if known).

    A task without an answer is a failed row. Errors of rows are values in them; none stops the run. Columns of ``tasks`` named in ``keep`` stay.
    """
    have = answers.columns
    measures = {c: (F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0)).cast("double") for c in ("execution_time", "cost", "latency")}
    # an empty expectation is none
    paired = tasks.select("task_id", *keep, F.nullif("expected_output", F.lit("")).alias("expected_output")).join(answers, "task_id", "left").withColumns(measures)
    scored = scorers.score(paired, ScorerConfig.of(config.evaluation))
    missing = F.col("predicted_output").isNull()
    return scored.select("task_id", *keep, (F.col("success") & ~missing).alias("success"), F.when(missing, F.lit(0.0)).otherwise(F.col("score")).alias("score"), "metrics", "details", F.when(missing, F.lit("no answer")).otherwise(F.col("error")).alias("error"), *measures)


def aggregate_row(results: DataFrame, config: TaskConfig) -> dict[str, Any]:
    """Totals and metric summary of a run as one mapping; fails for a run without rows."""
    row = aggregate.totals(results).first().asDict()
    if not row["total_tasks"]:
        raise ValueError("the dataset has no tasks")
    names = [m.name for m in ScorerConfig.of(config.evaluation).metrics]
    summary = aggregate.metric_summary(results, names).collect() if names else []  # one row a configured metric
    return row | {"metrics_summary": {r["metric"]: {k: r[k] for k in ("mean", "min", "max", "std")} for r in summary}}


def evaluate(tasks: DataFrame, answers: DataFrame, config: TaskConfig, output: str, run_id: str, agent: str = "unknown", model: str = "unknown") -> dict[str, Any]:
    """Score, append the rows to ``output`` and write the aggregate beside it; returns the aggregate. Tasks that know their ``line_num`` are saved in that order."""
    scored = run(tasks, answers, config, ("line_num",)).orderBy("line_num") if "line_num" in tasks.columns else run(tasks, answers, config)
    save_results(scored, output, run_id)
    saved = tasks.sparkSession.read.schema("task_id string, success boolean, score double, metrics map<string,double>, execution_time double, cost double, run_id string").json(output).where(F.col("run_id") == run_id)
    row = {"timestamp": datetime.now().isoformat(), "task_id": config.name, "agent_name": agent, "model": model, **aggregate_row(saved, config)}
    save_aggregate(row, output.rstrip("/").removesuffix(".jsonl") + ".json")
    return row


def exit_code(row: dict[str, Any]) -> int:
    """0 if at least half of the tasks succeeded."""
    return int(row["success_rate"] < 0.5)
