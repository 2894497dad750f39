"""Runs that go on where they stopped: answers are scored once for each run and task, however often they come."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.suite import MEASURES, paired, save_suite, scan_suite_results, score_pairs
from ..sources.shared import discard, stored

KEYS = ["task", "task_id"]
ANSWER = "task string, task_id string, predicted_output string, execution_time double, cost double, latency double"


def one_answer(answers: DataFrame) -> DataFrame:
    """One answer for each task and id: of several the least by text and measures, so that a repeated step takes the same."""
    rest = [c for c in ("predicted_output", *MEASURES) if c in answers.columns]
    return answers.groupBy(*KEYS).agg(F.min(F.struct(*rest)).alias("_least")).select(*KEYS, "_least.*")


def unfinished(rows: DataFrame, output: str, run_id: str) -> DataFrame:
    """Rows of ``rows`` whose task and id have no saved result of the run: an anti-join that reads two columns of the run's folder. Null keys never count as finished."""
    try:
        done = scan_suite_results(rows.sparkSession, output, run_id).select(*KEYS)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return rows
    return rows.join(done, KEYS, "left_anti")


def _score(pairs: DataFrame, suite: DataFrame, output: str, run_id: str) -> None:
    """Score and append pairs: they are made once and stored, as each method reads them."""
    pairs = stored(pairs, "resume-pairs")
    save_suite(score_pairs(pairs, suite), output, run_id)
    discard(pairs)


def resume_suite(tasks: DataFrame, answers: DataFrame, suite: DataFrame, output: str, run_id: str) -> None:
    """Score the tasks that the run has no result of, and append them. A run that was stopped goes on; one that is complete writes nothing."""
    _score(paired(unfinished(tasks, output, run_id), one_answer(answers)), suite, output, run_id)


def score_stream(answers: DataFrame, tasks: DataFrame, suite: DataFrame, output: str, run_id: str, checkpoint: str) -> StreamingQuery:
    """Score answers as they arrive and append the results of tasks that the run has none of yet.

    A micro-batch that is repeated after a failure finds what it has written and writes only what is missing; so does a stream that starts anew without its checkpoint, or an answer that comes
    again. One stream writes a run at a time. ``tasks`` is a table: an answer to a task that is not in it is left out.
    """

    def step(batch: DataFrame, _: int) -> None:
        new = unfinished(one_answer(batch), output, run_id)
        _score(paired(tasks, new, "inner"), suite, output, run_id)

    return answers.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
