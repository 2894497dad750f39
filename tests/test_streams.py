"""Windows with late rows and restarts, and runs that are resumed, against plain loops."""

import json
from collections import Counter
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException

from tallyframe.plans import suite
from tallyframe.sources.config import TaskConfig
from tallyframe.streaming import resume, results as streams

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def finals(batches, window, late):
    """Windows (start, number of rows) that a stream of these batches of minutes emits."""
    mark, open_, out = None, Counter(), {}
    for batch in batches:
        for minute in batch:
            start = minute // window * window
            if mark is None or start + window > mark:
                open_[start] += 1
        mark = max([*batch, *([] if mark is None else [mark + late])]) - late
        for start in [s for s in open_ if s + window <= mark]:
            assert start not in out
            out[start] = open_.pop(start)
    return out


def test_late_rows_and_restarts(spark, tmp_path):
    batches = [[1, 3, 7, 12], [14, 2, 22], [4, 11, 23, 13], [1, 12, 60], [61, 20, 59, 58], [30, 100]]
    (tmp_path / "in").mkdir()
    for k, batch in enumerate(batches):
        rows = [json.dumps({"task_id": f"t{m}", "model": "m", "success": m % 2 == 0, "score": 0.5, "cost": 1.0, "finished": (START + timedelta(minutes=m)).isoformat()}) for m in batch]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(rows))
        for _ in range(2):  # the second time there is nothing new
            streams.append_windows(streams.read_results(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check", "5 minutes", "10 minutes").awaitTermination()
    got = {int((r.start.astimezone(timezone.utc) - START).total_seconds() // 60): r.total_tasks for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = finals(batches, 5, 10)
    assert got == want and sum(want.values()) < sum(map(len, batches)) - 2  # some were late, some are not final


CONFIGS = [TaskConfig(t, evaluation={"metrics": [{"name": "x"}], "success_criteria": [{"metric": "x", "value": v}]}) for t, v in (("a", 1), ("b", 5))]


@pytest.fixture
def run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    tasks = spark.createDataFrame([(t, str(k), "") for t in "ab" for k in range(6)], "task string, task_id string, expected_output string")

    def put(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"task": t, "task_id": k, "predicted_output": json.dumps({"x": x})}) for t, k, x in rows))

    def go(check="check", asked=None):
        stream = spark.readStream.schema(resume.ANSWER).json(f"{tmp_path}/in")
        resume.score_stream(stream, tasks if asked is None else asked, suite.suite_of(spark, CONFIGS), f"{tmp_path}/out", "r", f"{tmp_path}/{check}").awaitTermination()

    def saved():
        return sorted((x.task, x.task_id, x.success, x.metrics["x"]) for x in suite.scan_suite_results(spark, f"{tmp_path}/out", "r").collect())

    return tasks, put, go, saved


def test_a_stream_scores_each_task_once(spark, run, tmp_path):
    tasks, put, go, saved = run
    put("1", [("a", "0", 3), ("a", "1", 0), ("b", "0", 3), ("b", "0", 2), ("z", "0", 1), ("a", "99", 1)])
    go()
    first = [("a", "0", True, 3.0), ("a", "1", False, 0.0), ("b", "0", False, 2.0)]
    assert saved() == first
    put("2", [("a", "0", 9), ("b", "5", 7)])  # one comes again
    go()
    after = sorted([*first, ("b", "5", True, 7.0)])
    assert saved() == after
    go("other")  # anew, without what the first stream knew
    assert saved() == after


def test_a_step_that_fails_half_way_is_repeated(spark, run, tmp_path, monkeypatch):
    """The rows are written, then the step fails before the stream has noted it: the restart writes nothing twice."""
    tasks, put, go, saved = run
    put("1", [("a", "0", 3), ("b", "1", 6)])
    real = resume.save_suite

    def failing(*args):
        real(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(resume, "save_suite", failing)
    with pytest.raises(StreamingQueryException):
        go()
    monkeypatch.undo()
    put("2", [("a", "2", 3)])
    go()
    assert saved() == [("a", "0", True, 3.0), ("a", "2", True, 3.0), ("b", "1", True, 6.0)]


def test_a_batch_run_is_resumed(spark, run, tmp_path):
    tasks, _, _, saved = run
    asked = suite.suite_of(spark, CONFIGS)
    answers = spark.createDataFrame([(t, str(k), json.dumps({"x": k})) for t in "ab" for k in range(5)], "task string, task_id string, predicted_output string")
    out = f"{tmp_path}/out"
    resume.resume_suite(tasks.where("task = 'a'"), answers, asked, out, "r")
    for _ in range(2):
        resume.resume_suite(tasks, answers.unionByName(answers), asked, out, "r")
    rows = suite.scan_suite_results(spark, out, "r").collect()
    assert Counter((x.task, x.task_id) for x in rows) == Counter((t, str(k)) for t in "ab" for k in range(6))
    assert {x.task_id for x in rows if x.error == "no answer"} == {"5"}
    resume.resume_suite(tasks, answers, asked, out, "another")
    assert suite.scan_suite_results(spark, out).count() == 24


def test_pairs_are_made_once_and_nothing_is_scored_twice(run, monkeypatch):
    """Each method reads stored pairs, not the joins behind them; a step without new answers has none; no pairs are left behind."""
    _, put, go, saved = run
    steps = []
    real = resume.score_pairs
    monkeypatch.setattr(resume, "score_pairs", lambda pairs, suite: steps.append((pairs.inputFiles(), pairs.count())) or real(pairs, suite))
    put("1", [("a", "0", 3), ("b", "0", 2)])
    go()
    go("other")
    assert [n for _, n in steps] == [2, 0]
    for files, _ in steps:
        assert files and all("resume-pairs" in f and not Path(f.removeprefix("file://")).exists() for f in files)
    assert saved() == [("a", "0", True, 3.0), ("b", "0", False, 2.0)]
