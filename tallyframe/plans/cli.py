"""Command line: score stored answers of one or all tasks, and render reports.

    python -m tallyframe.plans.cli evaluate --tasks-dir configs/tasks [--task NAME] [--data DIR] --answers PATH --output out.jsonl
                                                  [--together]  all tasks as one plan: rows in a folder for each run and task, aggregates in one file
    python -m tallyframe.plans.cli report out.jsonl [--format html|markdown|both] [-o DIR]
"""

from __future__ import annotations

import argparse
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators import aggregate
from ..sources import config
from ..sources.jsonl import save_aggregate, scan_report, scan_tasks
from . import engine, report, suite


def load(spark: SparkSession, path: str) -> tuple[DataFrame | None, dict[str, Any]]:
    """Saved result rows (None if there is only an aggregate) and their aggregate: the one saved beside them over the one computed from the rows."""
    rows, saved = scan_report(spark, path)
    if rows is None:
        return None, saved
    names = [r[0] for r in rows.selectExpr("explode(map_keys(metrics)) as name").distinct().orderBy("name").collect()]  # names, not rows
    found = aggregate.metric_summary(rows, names).collect() if names else []
    own = aggregate.totals(rows).first().asDict() | {"metrics_summary": {r["metric"]: {k: r[k] for k in ("mean", "min", "max", "std")} for r in found}}
    return rows, own | saved


def evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Tasks come from ``--data`` or from where their configuration says, as many as that says unless ``--max-samples`` is given. Each task's rows go to ``{output}_{task}``; the last exit code that is not 0 counts."""
    code = 0
    files = config.task_files(args.tasks_dir, args.task)
    for path in files:
        task = config.TaskConfig.of(config.read(path))
        where = f"{args.data}/{task.name}.jsonl" if args.data else task.path
        tasks = scan_tasks(spark, where, task.fields, args.max_samples or task.max_samples, args.seed if task.shuffle else None)
        answers = spark.read.schema("task_id string, predicted_output string, execution_time double, cost double, latency double").json(f"{args.answers}/{task.name}.jsonl")
        out = Path(args.output)
        output = str(out if len(files) == 1 else out.with_name(f"{out.stem}_{task.name}{out.suffix}"))
        row = engine.evaluate(tasks, answers, task, output, args.run_id, args.agent, args.model)
        print(report.plain(report.of_aggregate(row)))
        code = engine.exit_code(row) or code
    return code


def evaluate_together(spark: SparkSession, args: argparse.Namespace) -> int:
    """All tasks as one plan. The rows are written by one job to ``{output}/run_id=.../task=...``, the aggregates, read from there, to one file beside it; the last exit code that is not 0 counts."""
    tasks = [config.TaskConfig.of(config.read(p)) for p in config.task_files(args.tasks_dir, args.task)]
    paths = {t.name: f"{args.data}/{t.name}.jsonl" for t in tasks} if args.data else {}
    table = suite.scan_suite(spark, tasks, paths, args.max_samples, args.seed)
    answers = suite.scan_answers(spark, {t.name: f"{args.answers}/{t.name}.jsonl" for t in tasks})
    suite.save_suite(suite.run_suite(table, answers, suite.suite_of(spark, tasks)), args.output, args.run_id)
    rows = suite.suite_totals(suite.scan_suite_results(spark, args.output, args.run_id)).orderBy("task").collect()  # a row a task
    found = [{"task_id": r["task"], "agent_name": args.agent, "model": args.model} | {k: v for k, v in r.asDict(True).items() if k != "task"} for r in rows]
    save_aggregate({"run_id": args.run_id, "tasks": found}, args.output.rstrip("/").removesuffix(".jsonl") + ".json")
    code = 0
    for row in found:
        print(report.plain(report.of_aggregate(row)))
        code = engine.exit_code(row) or code
    return code


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyframe")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("evaluate")
    for name, default in (("--tasks-dir", None), ("--data", ""), ("--answers", None), ("--output", None), ("--task", ""), ("--run-id", "run"), ("--agent", ""), ("--model", "")):
        run.add_argument(name, required=default is None, default=default or None)
    run.add_argument("--max-samples", type=int)
    run.add_argument("--seed", type=int, default=0, help="of the order in which tasks are read that their configuration wants shuffled")
    run.add_argument("--together", action="store_true", help="score all tasks as one plan")
    run.add_argument("--agent-config", help="a file that names agent and model")
    render = commands.add_parser("report")
    render.add_argument("results")
    render.add_argument("--format", choices=("html", "markdown", "both"), default="both")
    render.add_argument("-o", "--output", default=".")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "evaluate":
        if args.agent_config:
            agent = config.AgentConfig.of(config.read(args.agent_config, expanded=False))
            args.agent, args.model = args.agent or agent.name, args.model or agent.model
        args.agent, args.model = args.agent or "unknown", args.model or "unknown"
        return (evaluate_together if args.together else evaluate)(spark, args)
    rows, saved = load(spark, args.results)
    parts = report.of_aggregate(saved)
    if rows is not None:
        parts += report.sections(report.gather(rows), saved.get("model", "Unknown"), saved.get("task_id", "Unknown"))[1:]
    for path in report.write(parts, args.output, Path(args.results).stem, args.format):
        print(path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
