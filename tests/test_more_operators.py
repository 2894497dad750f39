"""Templates, running sums and sessions, the solver, own scorers over batches, and retrieval on odd input, against plain code."""

import json
import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import optics, template
from tallyframe.model import Criterion, ScorerConfig
from tallyframe.operators import aggregate, cost, plugin, scorers
from tallyframe.plans import engine
from tallyframe.sources.config import TaskConfig
from tallyframe.sources.jsonl import scan_tasks

# ---- templates

ROW = "id int, name string, n int, x double, ok boolean, tags array<string>, items array<struct<label:string,count:int,parts:array<string>>>, about map<string,string>, inner struct<a:int,b:struct<c:string>>"
ROWS = [
    (1, "Ann", 3, 1.5, True, ["p", None, "q"], [("a", 1, ["x", "y"]), (None, 0, [])], {"k": "v"}, (7, ("deep",))),
    (2, "", 0, 0.0, False, [], [], {}, (None, None)),
    (3, None, None, None, None, None, None, None, None),
    (4, "{{name}}", -1, float("nan"), True, [""], [("$1 \\", 2, None)], {"k": None}, (0, ("",))),
]


def plain(parts, names):
    """The same by a plain walk over Python values."""

    def find(path):
        value = names.get(path.split(".")[0]) if path.split(".")[0] in names else None
        for name in path.split(".")[1:]:
            value = value.get(name) if isinstance(value, dict) else None
        return value

    def text(value):
        if value is None:
            return ""
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, list):
            return ",".join(text(v) for v in value)
        return "NaN" if value != value else str(value)

    out = []
    for part in parts:
        if isinstance(part, str):
            out.append(part)
        elif isinstance(part, template.Value):
            if len(part.names) == 1:
                out.append(text(find(part.names[0])))
            else:
                terms = [int(p) if p.lstrip("-").isdigit() else find(p) for p in part.names]
                out.append("" if None in terms else text(sum(terms)))
        else:
            value = find(part.name)
            true = bool(value) and value == value
            if not true:
                out.append(plain(part.other, names))
            elif part.kind == "if":
                out.append(plain(part.body, names))
            else:
                out += [plain(part.body, names | {"this": v, "@index": k}) for k, v in enumerate(value)]
    return "".join(out)


TEMPLATES = [
    "", "no tags\n", "{{name}}/{{ n }}/{{x}}/{{ok}}/{{tags}}/{{nothing}}", "{{about.k}}{{inner.a}}{{inner.b.c}}{{inner.none}}{{name.x}}", "a {{#if name}}yes {{name}}{{else}}no{{/if}} b", "{{#if n}}n{{/if}}{{#if x}}x{{/if}}{{#if ok}}ok{{/if}}{{#if tags}}t{{/if}}{{#if about}}m{{/if}}{{#if inner}}s{{/if}}{{#if nothing}}0{{else}}1{{/if}}",
    "{{#each tags}}[{{@index}}:{{this}}]{{else}}none{{/each}}", "start\n{{#if ok}}\n  line\n{{else}}\n  other\n{{/if}}\n{{#each items}}\n{{add @index 1}}. {{this.label}} of {{name}}{{#if this.count}} x {{this.count}}{{/if}}: {{#each this.parts}}<{{this}}{{@index}}{{#if ok}}!{{/if}}>{{/each}}\n{{/each}}\nend", "{{add n 1 -2}}|{{add n x}}|{{add nothing 1}}",
]


@pytest.mark.parametrize("source", TEMPLATES)
def test_templates(spark, source):
    df = spark.createDataFrame(ROWS, ROW)
    got = {r.id: r.t for r in df.select("id", template.render(df, source).alias("t")).collect()}
    assert got == {r.id: plain(template.parse(source), r.asDict(True)) for r in df.collect()}


def test_template_lines_and_faults(spark):
    df = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")
    assert df.select(template.render(df, "x\n {{#if a}} \ny\n{{/if}}\nz {{#if b}} w\n{{/if}}")).first()[0] == "x\ny\nz  w\n"
    for bad in ("{{#if a}}", "{{/if}}", "{{#each b}}{{/if}}", "{{else}}", "{{#if}}x{{/if}}", "{{a b}}", "{{}}", "{{#if a}}{{else}}{{else}}{{/if}}", "{{#unless a}}{{/unless}}"):
        with pytest.raises(ValueError):
            template.parse(bad)
    with pytest.raises(ValueError, match="no array"):
        template.render(df, "{{#each a}}{{/each}}")


# ---- running sums and sessions


@pytest.mark.parametrize("stretch", [1, 3, 4096])
def test_running(spark, stretch):
    r = random.Random(stretch)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(-5, 30)]), r.randrange(9)) for _ in range(150)]
    got = aggregate.running(spark.createDataFrame(rows, "g string, t int, v int"), ["g"], "t", {"total": F.col("v"), "count": F.lit(1)}, stretch)
    at = lambda t: (t is not None, t or 0)
    want = sorted(((g, t, v, sum(x for h, u, x in rows if h == g and at(u) <= at(t)), sum(1 for h, u, _ in rows if h == g and at(u) <= at(t))) for g, t, v in rows), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want and got.columns == ["g", "t", "v", "total", "count"]


def test_sessions(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["system", "user", "assistant"]), "x" * r.randrange(9), r.choice([True, False, False, None])) for c in range(6) for t in range(0, 9000, 700)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, reset boolean")
    want, lists, session, tokens, n = {}, defaultdict(list), {}, {}, {}
    for c, t, role, text, reset in rows:
        if reset or c not in session:
            session[c], tokens[c], n[c] = session.get(c, -1 if not reset else 0) + 1, 0, 0
        tokens[c] += len(text)
        n[c] += 1
        want[c, t] = (session[c], tokens[c], n[c])
        lists[c, session[c]].append((t, role, text))
    got = cost.session_totals(turns, F.col("reset"), F.length("text")).collect()
    assert {(x.conv_id, x.turn): (x.session, x.running_tokens, x.running_turns) for x in got} == want
    heard = cost.session_history(turns, F.col("reset")).collect()
    assert {(x.conv_id, x.session): [tuple(m) for m in x.messages] for x in heard} == lists
    assert {(x.conv_id, x.session): x.system for x in heard} == {k: next((t for _, role, t in reversed(v) if role == "system"), None) for k, v in lists.items()}
    more = cost.history(turns).select(cost.appended(F.col("messages"), "user", F.lit("and?")).alias("m"), "length").first()
    assert len(more.m) == more.length + 1 and tuple(more.m[-1]) == (more.m[-2].turn + 1, "user", "and?")


# ---- the solver


def test_minimized(spark):
    rows = [(0.3, 2.0, [0.0, 0.0]), (-5.0, 9.0, [9.0, -9.0]), (1.0, 1.0, [0.5, 0.5]), (None, 1.0, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "a double, b double, start array<double>")
    # a bowl whose axes lean, a flat valley, an edge
    bowl = lambda x: F.pow(F.get(x, 0) - F.col("a"), 2) + F.pow(F.get(x, 1) - F.col("b"), 2) + 0.8 * (F.get(x, 0) - F.col("a")) * (F.get(x, 1) - F.col("b"))
    low, high = F.array(F.lit(-1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(3.0))
    got = [r.m for r in df.select(optics.minimized(bowl, F.col("start"), low, high, rounds=25).alias("m")).collect()]

    def best(a, b):
        grid = [(x / 50, y / 50) for x in range(-50, 51) for y in range(151)]
        return min((x - a) ** 2 + (y - b) ** 2 + 0.8 * (x - a) * (y - b) for x, y in grid)

    for (a, b, _), m in zip(rows[:3], got, strict=False):
        assert m.value <= best(a, b) + 1e-9 and -1 <= m.x[0] <= 1 and 0 <= m.x[1] <= 3
    assert got[3].value is None and got[3].x == [0.5, 0.25]
    edge = df.select(optics.minimized(lambda x: -F.get(x, 0), F.array(F.lit(0.2)), F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("m")).first().m
    assert edge.x == [1.0] and edge.value == -1.0
    none = df.select(optics.minimized(lambda x: F.lit(4.0), F.array().cast("array<double>"), F.array(), F.array()).alias("m")).first().m
    assert none.x == [] and none.value == 4.0


@pytest.mark.parametrize("rounds", [1, 25])
def test_minimized_batches(spark, rounds):
    """Over numpy arrays the same points are found as by columns; a row that has no value keeps its start."""
    rows = [(0.3, 2.0, 0.0, 0.0), (-5.0, 9.0, 9.0, -9.0), (1.0, 1.0, 0.5, 0.5), (None, 1.0, 0.5, 0.25)]
    df = spark.createDataFrame(rows, "a double, b double, s double, t double").coalesce(1)
    bowl = lambda x: F.pow(F.get(x, 0) - F.col("a"), 2) + F.pow(F.get(x, 1) - F.col("b"), 2) + 0.8 * (F.get(x, 0) - F.col("a")) * (F.get(x, 1) - F.col("b"))
    array = lambda x, a, b: (x[0] - a) ** 2 + (x[1] - b) ** 2 + 0.8 * (x[0] - a) * (x[1] - b)
    low, high = [F.lit(-1.0), F.lit(0.0)], [F.lit(1.0), F.lit(3.0)]
    calls = spark.sparkContext.accumulator(0)

    def counted(x, a, b):
        calls.add(1)
        return array(x, a, b)

    got = df.select(optics.minimized(bowl, F.array("s", "t"), F.array(*low), F.array(*high), rounds=rounds).alias("m"), optics.minimized_batches(counted, [F.col("s"), F.col("t")], low, high, [F.col("a"), F.col("b")], rounds=rounds).alias("n")).collect()
    for r in got[:3]:
        assert r.n.x == pytest.approx(r.m.x, abs=1e-6) and r.n.value == pytest.approx(r.m.value, abs=1e-9)
    assert got[3].n.value is None and got[3].n.x == [0.5, 0.25]
    assert calls.value == 1 + rounds * 2 * (2 + 48 + 4)  # for all rows together
    flat = df.select(optics.minimized_batches(lambda x: 0 * x[0], [F.lit(0.2)], [F.lit(0.0)], [F.lit(1.0)], []).alias("m")).first().m
    assert flat.x == [0.0] and flat.value == 0.0


def test_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(optics, "ROWS_EACH", 100)
    rows = optics.spread(spark.range(950).coalesce(1))
    assert rows.rdd.getNumPartitions() == 10 and sorted(r.id for r in rows.collect()) == list(range(950)) and optics.spread(spark.range(0)).count() == 0


# ---- own scorers


def test_batch_scorer(spark):
    calls = []

    def letters(p, e):
        calls.append(len(p))
        if p.str.contains("!").any():
            raise ValueError("loud")
        return pd.DataFrame({"success": p == e, "score": [None if a is None else len(set(a) & set(b or "")) / 10 for a, b in zip(p, e, strict=True)], "size": p.str.len()})

    plugin.batch_scorer("letters", ("size", "never"))(letters)
    texts = ["abc", "no!", "", None, "xyz", "abc"] * 5
    df = spark.createDataFrame([(k, t, "abc") for k, t in enumerate(texts)], "id int, predicted_output string, expected_output string").coalesce(1)
    for criteria in ((), (Criterion("size", ">=", 1),)):
        for r in scorers.score(df, ScorerConfig("letters", criteria=criteria)).collect():
            t = texts[r.id]
            if t is None or "!" in t:
                assert (r.success, r.score, r.metrics, r.error) == (False, 0.0, {}, "no score" if t is None else "ValueError: loud")
            else:
                assert (r.success, r.error, r.metrics) == (bool(len(t)) if criteria else t == "abc", None, {"size": float(len(t))}) and r.score == len(set(t) & set("abc")) / 10
    letters_of = lambda p, e: pd.DataFrame({"score": [1.0]})
    assert plugin.isolated(letters_of, (), pd.Series(["a", "b"]), pd.Series(["a", "b"])).score.tolist() == [1.0, 1.0]
    assert scorers.score(df.limit(0), ScorerConfig("letters")).count() == 0


def test_saved_in_the_order_of_lines(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("".join(f'{{"task_id": "{(k * 37) % 101}"}}\n' for k in range(101)))
    tasks = scan_tasks(spark, f"{tmp_path}/t.jsonl")
    answers = spark.createDataFrame([(str(k), "{}") for k in range(101)], "task_id string, predicted_output string")
    engine.evaluate(tasks.repartition(5), answers, TaskConfig("x"), f"{tmp_path}/out.jsonl", "r")
    lines = [json.loads(x)["task_id"] for f in sorted((tmp_path / "out.jsonl").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [str((k * 37) % 101) for k in range(101)]
