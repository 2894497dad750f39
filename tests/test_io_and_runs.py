"""Scans, sinks, configuration, runs, reports and streams on temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from tallyframe.model import Criterion, Metric, ScorerConfig
from tallyframe.plans import engine, report
from tallyframe.sources import config, jsonl, optics_text
from tallyframe.streaming import results as streams


@pytest.fixture
def tasks_file(tmp_path):
    path = tmp_path / "tasks.jsonl"
    path.write_text('{"task_id": "a", "question": "Q?", "expected_output": {"mtf": 1}, "level": 3, "extra": 1}\n\n{ broken\n{"question": "R?"}\n', encoding="utf-8")
    return str(path)


def test_task_scan(spark, tasks_file):
    got = jsonl.scan_tasks(spark, tasks_file, {"input_field": "question", "metadata_fields": ["level", "none"]}).orderBy("line_num").collect()
    assert [(r.line_num, r.task_id, r.instruction, r.expected_output, r.metadata) for r in got] == [(1, "a", "Q?", '{"mtf":1}', {"level": "3"}), (4, "task_4", "R?", "", {})]
    assert jsonl.scan_jsonl(spark, tasks_file, limit=3).count() == 1 and jsonl.scan_jsonl(spark, tasks_file, limit=0).count() == 2
    assert [r.task_id for r in jsonl.scan_tasks(spark, tasks_file, limit=1).collect()] == ["a"]
    assert jsonl.scan_tasks(spark, tasks_file, seed=3).count() == 2
    texts = jsonl.scan_tasks(spark, tasks_file, {"input_field": "question", "metadata_fields": ["task_id", "level"]}).select("line_num", jsonl.prompt(F.col("instruction")).alias("p")).orderBy("line_num").collect()
    assert [r.p for r in texts] == ["Q?\n\n- level: 3", "R?"]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name, n in (("a", 4000), ("b", 3)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{k}\n" if k % 7 else "\n" for k in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        rows = jsonl.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 4003 and all(r.line in ("", f"a{r.line_num}", f"b{r.line_num}") for r in rows) and sum(r.line == "" for r in rows) == 571


def test_results_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("é", True, 0.5, {"m": 1.0}, "{}", None, 1.0, 0.1)], "task_id string, success boolean, score double, metrics map<string,double>, details string, error string, execution_time double, cost double")
    path = f"{tmp_path}/results.jsonl"
    jsonl.save_results(rows, path, "r1")
    jsonl.save_results(rows, path, "r2")
    assert jsonl.scan_results(spark, path).count() == 2 and jsonl.scan_results(spark, path).first().metrics == {"m": 1.0}
    broken = tmp_path / "broken.jsonl"
    broken.write_text('{"task_id": "a"}\n{ no\n')
    assert jsonl.scan_results(spark, str(broken)).count() == 1
    with pytest.raises(Exception):
        jsonl.scan_results(spark, str(broken), strict=True).collect()


def test_optics_exports(spark):
    text = "Freq Tan Sag\n0 1.0 0.9\n10 0.5 x\n20 0.25 0.2 extra\n1.5 2\n"
    row = spark.range(1).select(optics_text.parse_mtf(F.lit(text)).alias("m"), optics_text.parse_spot(F.lit(text)).alias("s"), optics_text.parse_mtf(F.lit("")).alias("e")).first()
    assert row.m.spatial_frequency == [0, 20] and row.m.mtf_sagittal == [0.9, 0.2] and [r.x for r in row.s.rays] == [0, 10, 20, 1.5] and row.e.spatial_frequency == []


def test_config(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("KEY", "v")
    assert config.expand({"a": ["x${KEY}y${NONE}", 1], "b": "${KEY}"}) == {"a": ["xvy", 1], "b": "v"} and config.expand("x${KEY}", whole=True) == "x${KEY}"
    (tmp_path / "t.json").write_text('{"task": {"id": "lens", "name": "Lens"}, "dataset": {"format": {"input_field": "q"}}, "evaluation": {"metrics": [{"name": "m"}], "success_criteria": [{"metric": "m", "operator": ">=", "value": 1}]}}')
    task = config.TaskConfig.of(config.read(tmp_path / "t.json"))
    assert (task.name, task.title, task.fields) == ("lens", "Lens", {"input_field": "q"}) and config.TaskConfig.of({}).title == "Unknown Task"
    assert ScorerConfig.of(task.evaluation).criteria == (Criterion("m", ">=", 1),)
    with pytest.raises(ValueError):
        config.read(tmp_path / "x.toml")
    assert config.task_files(tmp_path, "t") == [tmp_path / "t.json"] == config.task_files(tmp_path)
    with pytest.raises(FileNotFoundError):
        config.task_files(tmp_path, "none")
    assert config.AgentConfig.of({"model": {"name": "${KEY}", "provider": "groq"}, "tools": {"enabled": ["x"]}}) == config.AgentConfig(provider="groq", model="v", tools=("x",))
    (tmp_path / "prompt.txt").write_text("Be exact.")
    agent = config.AgentConfig.of({"agent": {"name": "a"}, "model": {"api_key": "k", "top_p": 0.5}, "execution": {"timeout": 5}, "provider_settings": {"thinking_budget": 7}, "system_prompt_file": "prompt.txt"}, tmp_path)
    assert (agent.name, agent.model, agent.has_key, agent.top_p, agent.timeout, agent.max_retries, agent.thinking_budget, agent.system_prompt) == ("a", "gpt-4", True, 0.5, 5, 3, 7, "Be exact.")
    assert agent.frame(spark).first().asDict()["tools"] == [] and "k" not in map(str, agent.frame(spark).first())
    task = config.TaskConfig.of({"dataset": {"path": "p.jsonl", "num_samples": 3, "shuffle": True}})
    assert (task.path, task.max_samples, task.shuffle) == ("p.jsonl", 3, True) and config.TaskConfig.of({}).max_samples is None
    config.write(tmp_path / "w.json", {"b": "é", "a": [1]})
    assert config.read(tmp_path / "w.json") == {"b": "é", "a": [1]}
    with pytest.warns(UserWarning):
        assert config.read_system(tmp_path / "no.yaml") == {}
    assert [config.has_key(k) for k in ("k", "", None, "${X}")] == [True, False, False, False]


@pytest.mark.skipif(config.yaml is None, reason="needs PyYAML")
def test_providers(spark, tmp_path):
    (tmp_path / "gpt-4.yaml").write_text("model: {provider: openai, name: gpt-4, api_key: k}\ntools: {enabled: [a, b]}")
    (tmp_path / "my-own.yaml").write_text("model: {api_key: '${X}'}")
    (tmp_path / "template.yaml").write_text("model: {}")
    (tmp_path / "bad.yaml").write_text("model: [")
    with pytest.warns(UserWarning):
        got = config.discover_providers(spark, tmp_path).collect()
    assert [(r.provider_id, r.name, r.has_api_key, r.tools_enabled, r.display_name) for r in got] == [("gpt-4", "GPT-4 (OpenAI)", True, ["a", "b"], "GPT-4 (OpenAI) (gpt-4)"), ("my-own", "My Own", False, [], "My Own (unknown)")]
    assert config.discover_providers(spark, tmp_path / "none").count() == 0
    config.write(tmp_path / "w.yaml", {"b": "é", "a": [1, None]})
    assert config.read(tmp_path / "w.yaml") == {"b": "é", "a": [1, None]}
    assert [len(r[0]) for r in config.discover_providers(spark, tmp_path).select(config.shown_tools(most=1)).collect()] == [1, 0, 0]


def test_workspace_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("a.txt", "one\ntwo"), ("sub/b.txt", ""), ("c.md", "x")):
        (tmp_path / name).write_text(text)
    assert [r.text for r in jsonl.read_files(spark, str(tmp_path), "*.txt").collect()] == ["one\ntwo"]
    assert sorted(r.size for r in jsonl.list_files(spark, str(tmp_path)).collect() if r.size) == [1, 7]


def test_limit_over_several_files(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"task_id": "{name}{k}"}}\n' for k in range(3)))
    assert [r.task_id for r in jsonl.scan_tasks(spark, str(tmp_path), limit=4).collect()] == ["a0", "a1", "a2", "b0"]


TASK = config.TaskConfig("lens", "Lens", {}, {"metrics": [{"name": "mtf"}], "success_criteria": [{"metric": "mtf", "operator": ">=", "value": 0.8}]})


def test_run(spark, tmp_path):
    tasks = spark.createDataFrame([("a", ""), ("b", "{}"), ("c", "")], "task_id string, expected_output string")
    answers = spark.createDataFrame([("a", '{"mtf": 0.9}', 1.0, 0.1), ("b", '{"mtf": 0.5}', 2.0, 0.1)], "task_id string, predicted_output string, execution_time double, cost double")
    row = engine.evaluate(tasks, answers, TASK, f"{tmp_path}/out.jsonl", "r1", model="m")
    assert (row["total_tasks"], row["successful_tasks"], row["metrics_summary"]["mtf"]["mean"]) == (3, 1, pytest.approx(1.4 / 3)) and engine.exit_code(row) == 1
    assert json.loads((tmp_path / "out.json").read_text())["total_tasks"] == 3
    assert engine.run(tasks, answers, TASK).where("error = 'no answer'").count() == 1
    with pytest.raises(ValueError):
        engine.aggregate_row(engine.run(tasks.limit(0), answers, TASK), TASK)


def test_reports(spark, tmp_path):
    results = spark.createDataFrame([("a", True, 0.9, None, 10.0, 0.05), ("b", False, 0.2, "invalid <x>", 5.0, 0.05)], "task_id string, success boolean, score double, error string, execution_time double, cost double")
    parts = report.sections(report.gather(results), "m<1>", "lens", "now")
    text, html = report.markdown(parts), report.page(parts)
    assert "| Success Rate | 50.0% |" in text and "| Invalid Output | 1 |" in text and "m&lt;1&gt;" in html and "Composite Score" in html
    assert "| Total Tasks | 0 |" in report.markdown(report.sections(report.gather(results.limit(0)), "m", "t"))
    assert [p.suffix for p in report.write(parts, tmp_path / "r", "x")] == [".html", ".md"]
    saved = report.of_aggregate({"model": "m", "total_tasks": 2, "successful_tasks": 1, "success_rate": 0.5, "metrics_summary": {"mtf": {"mean": 0.5, "min": 0, "max": 1, "std": 0.1}}})
    assert "1 (50.0%)" in report.plain(saved) and "mtf mean" in report.markdown(saved)
    row = {"provider": "P", "success": True, "model": "m", "latency": 1.234, "cost": 0.5, "tokens": 3, "response": "hi"}
    assert "1.23s" in report.answer(row) and "| Tokens | 3 |" in report.answer(row, "markdown") and json.loads(report.answer(row, "json")) == row and "boom" in report.answer({"provider": "P", "success": False, "error": "boom"})


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = lambda t, m, s, at: json.dumps({"task_id": t, "model": m, "success": s, "score": 1.0, "cost": 0.5, "finished": at})
    (src / "1.json").write_text("\n".join([line("a", "m1", True, "2024-01-01T00:01:00Z"), line("b", "m1", False, "2024-01-01T00:02:00Z"), line("c", "m2", True, "2024-01-01T01:00:00Z")]))
    for _ in range(2):  # the second run finds nothing new
        streams.append_results(streams.read_results(spark, str(src)), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.json(f"{tmp_path}/out").count() == 3
    done = streams.windowed_totals(streams.read_results(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    done.awaitTermination()
    assert sorted((r.model, r.total_tasks, r.successful_tasks) for r in spark.table("w").collect()) == [("m1", 2, 1), ("m2", 1, 1)]
    with pytest.raises(ValueError):
        config.write(tmp_path / "w.toml", {})
    done = streams.running_totals(streams.read_results(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("t").trigger(availableNow=True).start()
    done.awaitTermination()
    assert {r.model: r.total_cost for r in spark.table("t").collect()} == {"m1": 1.0, "m2": 0.5}
    answers = spark.readStream.schema("task_id string, predicted_output string, expected_output string").json(str(src))
    scored = streams.score_stream(answers, ScorerConfig("metric_based", (Metric("mtf"),), (Criterion("mtf", ">=", 0.8),)))
    assert scored.isStreaming and {"success", "score"} <= set(scored.columns)


def test_command_line(spark, tmp_path, capsys):
    from tallyframe.plans import cli

    for d in ("tasks", "data", "answers"):
        (tmp_path / d).mkdir()
    for name, mtf in (("one", 0.9), ("two", 0.1)):
        (tmp_path / "tasks" / f"{name}.json").write_text(json.dumps({"task": {"id": name}, "dataset": {}, "evaluation": TASK.evaluation}))
        (tmp_path / "data" / f"{name}.jsonl").write_text('{"task_id": "a", "instruction": "x"}\n')
        (tmp_path / "answers" / f"{name}.jsonl").write_text(json.dumps({"task_id": "a", "predicted_output": json.dumps({"mtf": mtf})}) + "\n")
    common = ["evaluate", "--tasks-dir", f"{tmp_path}/tasks", "--data", f"{tmp_path}/data", "--answers", f"{tmp_path}/answers", "--output", f"{tmp_path}/out.jsonl"]
    assert cli.main(common) == 1 and cli.main([*common, "--task", "one"]) == 0
    assert {p.name for p in tmp_path.glob("out*")} >= {"out_one.jsonl", "out_one.json", "out_two.json", "out.json"}
    assert cli.main(["report", f"{tmp_path}/out_one.jsonl", "-o", f"{tmp_path}/r", "--format", "markdown"]) == 0
    assert "| Successful | 1 (100.0%) |" in (tmp_path / "r" / "out_one.md").read_text()
    (tmp_path / "out_two.json").unlink()
    rows, found = cli.load(spark, f"{tmp_path}/out_two.jsonl")
    assert found["metrics_summary"]["mtf"]["mean"] == pytest.approx(0.1) and rows.count() == 1 and "timestamp" not in found
    (tmp_path / "out_two.json").write_text('{"model": "saved", "total_tasks": 9}')
    found = cli.load(spark, f"{tmp_path}/out_two.jsonl")[1]
    assert (found["model"], found["total_tasks"], found["successful_tasks"]) == ("saved", 9, 0)
    assert cli.main(["report", f"{tmp_path}/out_two.jsonl", "-o", f"{tmp_path}/r", "--format", "markdown"]) == 0
    text = (tmp_path / "r" / "out_two.md").read_text()
    assert "| Model | saved |" in text and "Composite Score" in text and "| Low Quality | 1 |" in text
    (tmp_path / "whole.json").write_text('{"total_tasks": 1, "individual": [{"task_id": "a", "success": true, "score": 1.0}]}')
    rows, found = cli.load(spark, f"{tmp_path}/whole.json")
    assert rows.first().task_id == "a" and found["total_tasks"] == 1
    assert jsonl.scan_runs(spark, [f"{tmp_path}/out_one.jsonl", f"{tmp_path}/out_two.jsonl"]).count() == 2
