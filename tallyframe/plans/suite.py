"""Runs over many tasks as one plan: what tasks ask for are rows, joined to their answers and evaluated as data."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import SAVED_RESULT, SETTINGS, ScorerConfig
from ..operators import aggregate, retrieval, scorers
from ..sources.config import TaskConfig
from ..sources.jsonl import scan_tasks

assert retrieval.citation  # registers itself among the scorers

SUITE = "task string, method string, asked array<struct<name:string,type:string>>, criteria array<struct<metric:string,operator:string,value:double,flag:boolean>>, settings map<string,double>"
#: Tasks of a suite: their configurations are read by the driver and broadcast.
MOST_TASKS = 10_000
MEASURES = ("execution_time", "cost", "latency")
RESULT_COLUMNS = ("success", "score", "metrics", "details", "error", *MEASURES)
_SUITE_COLUMNS = ("__method", "__asked", "__criteria", "__settings")


def suite_of(spark: SparkSession, configs: Iterable[TaskConfig]) -> DataFrame:
    """A row for each task: ``task``, ``method``, the metrics ``asked`` for, ``criteria`` and ``settings``. Names must differ and methods be known."""
    rows, names = [], set()
    for task in configs:
        config = ScorerConfig.of(task.evaluation)
        if config.method not in scorers.SCORERS:
            raise ValueError(f"unknown scoring method {config.method!r} of task {task.name!r}")
        if task.name in names:
            raise ValueError(f"two tasks are named {task.name!r}")
        names.add(task.name)
        criteria = [(c.metric, c.operator, None if isinstance(c.value, bool) else float(c.value), c.value if isinstance(c.value, bool) else None) for c in config.criteria]
        settings = {k: float(config.settings[k]) for k in SETTINGS if k in config.settings}
        rows.append((task.name, config.method, [(m.name, m.type) for m in config.metrics], criteria, settings))
    if len(rows) > MOST_TASKS:
        raise ValueError(f"{len(rows)} tasks; at most {MOST_TASKS} go into a suite")
    return spark.createDataFrame(rows, SUITE)


def scan_suite(spark: SparkSession, configs: Iterable[TaskConfig], paths: dict[str, str], limit: int | None = None, seed: int = 0) -> DataFrame:
    """The tasks of all files as one table: ``task`` and what ``scan_tasks`` gives. ``paths`` says where a task's file is, else its configuration does."""
    found = [scan_tasks(spark, paths.get(t.name) or t.path, t.fields, limit or t.max_samples, seed if t.shuffle else None).withColumn("task", F.lit(t.name)) for t in configs]
    return reduce(DataFrame.unionByName, found)


def scan_answers(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Saved answers of all tasks as one table, by task: ``task``, ``task_id``, ``predicted_output`` and measures."""
    schema = "task_id string, predicted_output string, execution_time double, cost double, latency double"
    return reduce(DataFrame.unionByName, [spark.read.schema(schema).json(p).withColumn("task", F.lit(t)) for t, p in paths.items()])


def run_suite(tasks: DataFrame, answers: DataFrame, suite: DataFrame) -> DataFrame:
    """Result rows of all tasks: ``task``, ``task_id``, what scorers add, and the measures of the answers.

    ``tasks`` has ``task``, ``task_id``, ``expected_output``, ``answers`` the same keys, ``predicted_output`` and measures if known. The two meet once, by their keys. A row then gets its task's configuration
    (at most MOST_TASKS rows, broadcast), and rows of one method are scored together, whichever tasks they are of: how many tasks there are does not change
    the plan, and a large task is as many splits as it has. Rows of a task that is not in the suite fail with an error, as do tasks without an answer.
    """
    return score_pairs(paired(tasks, answers), suite)


def paired(tasks: DataFrame, answers: DataFrame, how: str = "left") -> DataFrame:
    """Tasks with their answers and measures."""
    have = answers.columns
    measures = {c: (F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0)).cast("double") for c in MEASURES}
    own = answers.select("task", "task_id", "predicted_output", *[c for c in MEASURES if c in have])
    return tasks.select("task", "task_id", F.nullif("expected_output", F.lit("")).alias("expected_output")).join(own, ["task", "task_id"], how).withColumns(measures)


def score_pairs(pairs: DataFrame, suite: DataFrame) -> DataFrame:
    """Result rows of ``paired`` tasks. They are read once for each method, so they should be a stored table if they are many."""
    configured = pairs.join(F.broadcast(suite.select("task", *[F.col(c.removeprefix("__")).alias(c) for c in _SUITE_COLUMNS])), "task", "left")
    methods = [r[0] for r in suite.select("method").distinct().orderBy("method").collect()]  # as many as there are scorers, at most
    parts = [_scored(configured.where(F.col("__method") == m), m) for m in methods]
    none = {"success": F.lit(False), "score": F.lit(0.0), "metrics": F.create_map().cast("map<string,double>"), "details": F.lit(None).cast("string"), "error": F.lit("no such task")}
    parts.append(configured.where("__method is null").withColumns(none).select("task", "task_id", *RESULT_COLUMNS))
    return reduce(DataFrame.unionByName, parts)


def _scored(rows: DataFrame, method: str) -> DataFrame:
    config = ScorerConfig(method, F.col("__asked"), F.col("__criteria"), {k: F.try_element_at("__settings", F.lit(k)) for k in SETTINGS})
    done = scorers.score(rows, config)
    missing = F.col("predicted_output").isNull()
    answered = {"success": F.col("success") & ~missing, "score": F.when(missing, F.lit(0.0)).otherwise(F.col("score")), "error": F.when(missing, F.lit("no answer")).otherwise(F.col("error"))}
    return done.withColumns(answered).select("task", "task_id", *RESULT_COLUMNS)


def suite_totals(results: DataFrame) -> DataFrame:
    """Totals and the summary of metrics of each task: ``task``, the totals, and ``metrics_summary`` by metric. ``results`` is read three times, so it should be a saved table."""
    totals = aggregate.totals(results, "task")
    found = aggregate.found_metrics(results, "task").groupBy("task").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("metric"), F.struct("mean", "min", "max", "std"))))).alias("metrics_summary"))
    return totals.join(found, "task", "left")


def save_suite(results: DataFrame, path: str, run_id: str) -> None:
    """Append the rows as JSON lines in a folder for each run and task: one job writes all tasks. Rows are dealt by task, a large task over several writers."""
    results.hint("rebalance", "task").withColumn("run_id", F.lit(run_id)).write.partitionBy("run_id", "task").mode("append").option("ignoreNullFields", False).json(path)


def scan_suite_results(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Saved rows of one run, or of all, with ``run_id`` and ``task``; only the folders asked for are read."""
    rows = spark.read.schema(SAVED_RESULT + ", run_id string, task string").json(path)
    return rows if run_id is None else rows.where(F.col("run_id") == run_id)
