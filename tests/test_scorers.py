"""Row scorers: golden values recomputed by hand from the formulas."""

import json

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import text as T
from tallyframe.model import Criterion, Metric, ScorerConfig
from tallyframe.operators import retrieval, scorers

LENS = ScorerConfig("metric_based", (Metric("mtf"), Metric("spot_size"), Metric("distortion")), (Criterion("mtf", ">=", 0.8), Criterion("spot_size", "<=", 0.01)))


def run(spark, config, pairs):
    rows = [(str(k), a, b) for k, (a, b) in enumerate(pairs)]
    done = scorers.score(spark.createDataFrame(rows, "task_id string, predicted_output string, expected_output string"), config)
    return {int(r.task_id): r for r in done.collect()}


def test_metric_scorer(spark):
    got = run(spark, LENS, [('{"mtf": 0.85, "spot_size": 0.008, "distortion": 0.02}', "{}"), ('{"mtf": 0.5, "spot_size": 0.05}', "{}"), ('{"mtf": 0.85}', None), ("{ invalid json }", "{}"), ('{"mtf": "0.9", "spot_size": true}', "{}"), ('{"mtf": null}', "{}"), ("[1]", "{}"), ('{"mtf": 1}', "{ broken"), (None, None)])
    assert got[0].success and got[0].score == 1.0 and got[0].metrics == {"mtf": 0.85, "spot_size": 0.008, "distortion": 0.02}
    assert not got[1].success and got[1].score == 0.0
    assert got[2].success and got[2].metrics["spot_size"] == 0.0  # an absent number is 0 and passes "at most"
    assert [got[k].error is not None and not got[k].success and got[k].metrics == {} for k in (3, 5, 6, 7, 8)] == [True] * 5
    assert got[4].metrics == {"mtf": 0.9, "spot_size": 1.0, "distortion": 0.0} and got[4].score == 0.5
    assert json.loads(got[4].details)["criteria_met"] == {"mtf": True, "spot_size": False}


def test_binary_and_judged_metrics(spark):
    config = ScorerConfig("metric_based", (Metric("b", "binary"), Metric("j", "llm_judge"), Metric("u", "unknown")), (Criterion("b", ">=", True),))
    values = ["true", "false", "0", "0.0", "2", '""', '"false"', "[]", "[null]", "{}", '{"a": 0}', "null"]
    got = run(spark, config, [(f'{{"b": {v}}}', None) for v in values] + [("{}", None)])
    assert [got[k].metrics["b"] for k in range(13)] == [1, 0, 0, 0, 1, 0, 1, 0, 1, 0, 1, 0, 0]
    assert got[0].metrics == {"b": 1.0, "j": 0.5} and got[0].success and not got[1].success


@pytest.mark.parametrize("operator", [">=", "<=", ">", "<", "==", "!="])
def test_operators(spark, operator):
    for target in (4.0, 5.0, 6.0, float("nan")):
        row = spark.range(1).select(scorers.condition(F.lit(5.0), Criterion("m", operator, target)).alias("x"), scorers.condition(F.lit(float("nan")), Criterion("m", operator, 4.0)).alias("n"), scorers.condition(F.lit(None).cast("double"), Criterion("m", operator, 4.0)).alias("u")).first()
        if target == target:
            assert row.x == eval(f"5.0 {operator} {target}")
        assert row.n == (operator == "!=") and row.u is False
    with pytest.raises(ValueError):
        Criterion("m", "~", 1.0)


def test_no_criteria_and_unknown_method(spark):
    assert run(spark, ScorerConfig("metric_based", (Metric("m"),)), [("{}", None)])[0].score == 1.0
    with pytest.raises(ValueError):
        scorers.score(spark.range(1), ScorerConfig("none_such"))
    assert {"metric_based", "exact_match", "partial_match", "rouge", "citation"} <= set(scorers.SCORERS)


def test_exact_and_partial(spark):
    exact = run(spark, ScorerConfig("exact_match"), [("a", "a"), ("a", "A"), ('{"a": 1, "b": 2.0}', '{"b":2,"a":1.0}'), ("", "")])
    assert [exact[k].score for k in range(4)] == [1, 0, 1, 1]
    pairs = [("the quick brown fox", "the quick red fox"), ("", ""), ("hello", ""), ('{"a": 1, "b": 2}', '{"a": 1, "c": 3}'), ('{"a": 1, "b": 2, "c": 3}', '{"a": 1, "b": 2, "d": 4}'), ("{}", "{}"), ('{"a": null}', "{}"), ("3", "3.0"), ("[1]", "[2]")]
    got = run(spark, ScorerConfig("partial_match"), pairs)
    assert [round(got[k].score, 4) for k in range(9)] == [0.6, 1.0, 0.0, 0.3333, 0.5, 1.0, 1.0, 1.0, 0.0]
    assert [got[k].success for k in (0, 1)] == [False, True]


@pytest.mark.parametrize(
    ("predicted", "reference", "want"),
    [
        ("the quick fox", "the quick brown fox", {"rouge_1_precision": 1, "rouge_1_recall": 0.75}),
        ("the quick brown", "the quick red", {"rouge_2_precision": 0.5, "rouge_2_recall": 0.5}),
        ("the quick fox", "the quick brown fox jumps", {"rouge_l_precision": 1, "rouge_l_recall": 0.6}),
        ("the quick brown fox jumps", "the quick red fox jumps over", {"rouge_1_precision": 0.8, "rouge_1_recall": 0.6667, "rouge_2_precision": 0.5, "rouge_2_recall": 0.4}),
        ("a b c d", "a b e f", {"rouge_1_f_score": 0.5}), ("THE FOX", "the fox", {"rouge_l_f_score": 1}), ("", "x", {"rouge_1_f_score": 0, "rouge_l_recall": 0}), ("a a a", "a a", {"rouge_1_precision": 0.6667, "rouge_1_recall": 1}),
        (None, None, {"rouge_1_f_score": 0, "rouge_2_f_score": 0, "content_coverage": 0}), ("a b", "a　b", {"rouge_2_f_score": 1}),
    ],
)
def test_rouge(spark, predicted, reference, want):
    row = scorers.rouge(spark.createDataFrame([(predicted, reference)], "predicted_output string, expected_output string")).first()
    assert {k: round(row[k], 4) for k in want} == want


def test_summarization_weights(spark):
    got = run(spark, ScorerConfig("rouge", criteria=(Criterion("rouge_1", ">=", 0.5),), settings={"weight_rouge_1": 1.0, "weight_rouge_2": 0.0, "weight_rouge_l": 0.0}), [("a b c d", "a b e f")])[0]
    assert got.success and got.score == pytest.approx(0.5) and got.metrics["composite_score"] == pytest.approx(0.5)


def test_lcs_two_ways(spark):
    import random

    r = random.Random(1)
    rows = [([r.choice("abcd") for _ in range(r.randrange(0, 12))], [r.choice("abcd") for _ in range(r.randrange(0, 12))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select(T.lcs("a", "b").alias("x"), T.lcs_native(F.col("a"), F.col("b")).alias("y"), F.size("a").alias("n"), F.size("b").alias("m"))
    for row in df.collect():
        assert row.x == row.y <= min(row.n, row.m)


def test_retrieval(spark):
    dois = lambda *x: json.dumps({"papers": [{"doi": d} for d in x]})
    pairs = [(dois("a", "b", "c"), dois("c", "d", "e")), (dois("a", "b"), dois("a", "b")), (dois("a", "b"), dois("a", "z")), (dois(), dois()), (dois("a"), dois()), (json.dumps([{"title": "Deep Nets"}, "DEEP nets"]), json.dumps(["deep nets"])), ('{"results": [{"doi": "a"}]}', dois("a")), (None, dois("a"))]
    got = run(spark, ScorerConfig("citation"), pairs)
    assert [round(got[k].metrics["f1"], 4) for k in range(8)] == [0.3333, 1, 0.5, 1, 0, 1, 0, 0]
    assert got[3].score == 1 and got[4].metrics["citation_accuracy"] == 0
    title = "one two three four five six seven eight nine ten"
    half = run(spark, ScorerConfig("citation"), [(json.dumps([title + " x", "same"]), json.dumps([title, "same"]))])[0]
    assert half.metrics["citation_accuracy"] == pytest.approx(0.75)
    row = spark.range(1).select(retrieval.title_similarity(F.lit("a b c d e"), F.lit("a b c d f")).alias("x"), retrieval.title_similarity(F.lit(""), F.lit("")).alias("y")).first()
    assert row.x == pytest.approx(4 / 6) and row.y == 0.0


#: Pairs of texts with whether they are equal, and their similarity. Text behind a JSON value makes it no JSON.
ODD_PAIRS = [
    ("5 apples", "5 pears", False, 1 / 3), ("true story", "true lies", False, 1 / 3), ("[1] ref", "[1] other", False, 1 / 3), ("3.5 mm", "3.5 cm", False, 1 / 3), ("null hypothesis", "null result", False, 1 / 3), ("1,0] x", "1", False, 0.0),
    ("true", "1", True, 1.0), ("100", "1e2", True, 1.0), ("[false, 2.50]", "[0, 25e-1]", True, 1.0), ('{"a": [true, "x\\"true"]}', '{"a":[1.0,"x\\"true"]}', True, 1.0), ('"1"', "1", False, 0.0), ('{"a": "1.0"}', '{"a": "1"}', False, 0.0), ('{"a": 1e2, "b": false}', '{"a": 100, "b": 0.0}', True, 1.0),
    ('{"a": 1}', "[1]", False, 0.0), (None, None, True, 1.0), ('{"a": 0.1}', '{"a": 1e-1}', True, 1.0), ("123456789012345678901", "123456789012345678902", False, 0.0),
]


def test_texts_and_json_in_full(spark):
    pairs = [p[:2] for p in ODD_PAIRS]
    exact, partial = run(spark, ScorerConfig("exact_match"), pairs), run(spark, ScorerConfig("partial_match"), pairs)
    for k, (a, b, equal, similarity) in enumerate(ODD_PAIRS):
        assert (exact[k].success, exact[k].score) == (equal, float(equal)), (a, b)
        assert partial[k].score == pytest.approx(similarity), (a, b)
    assert json.loads(partial[0].details)["threshold"] == 0.8


def test_malformed_answers_and_repeated_metrics(spark):
    config = ScorerConfig("metric_based", (Metric("a", "binary"), Metric("a")), (Criterion("a", ">=", 0.8),))
    got = run(spark, config, [('{"a": 0.9} and then prose', "{}"), ('{"a": 0.9}', "{} more"), ('{"a": 0.9}', '{"b": 1}')])
    assert [got[k].error for k in range(3)] == ["invalid JSON", "invalid JSON", None] and got[2].metrics == {"a": 0.9}
    assert json.loads(got[2].details) == {"predicted": {"a": 0.9}, "expected": {"b": 1}, "criteria_met": {"a": True}}
    for method in ("citation", "retrieval"):
        got = run(spark, ScorerConfig(method), [("{ broken", "{ broken"), ('["a"] b', '["a"]'), ('["A", "b"]', '["a", "c"]')])
        assert [(got[k].success, got[k].score, got[k].error, got[k].metrics) for k in (0, 1)] == [(False, 0.0, "invalid JSON", {})] * 2
        assert got[2].error is None and json.loads(got[2].details)["correct_papers"] == ["a"]


def test_configured_keys(spark):
    assert ScorerConfig.of({"success_criteria": [{"metric": "m", "value": 1}]}).criteria == (Criterion("m", ">=", 1),)
    config = ScorerConfig.of({"scoring_method": "partial_match", "threshold": 0.6})
    assert run(spark, config, [("a b c", "a b d e")])[0].success is False and run(spark, config, [("a b c", "a b c d")])[0].success
    with pytest.warns(UserWarning):
        ScorerConfig.of({"tresh": 1})
    long = "word " * 300
    got = run(spark, ScorerConfig.of({"scoring_method": "summarization", "weight_rouge_1": 1, "weight_rouge_2": 0, "weight_rouge_l": 0}), [(long, "word")])[0]
    details = json.loads(got.details)
    assert len(details["predicted"]) == 500 and details["rouge_details"]["rouge_1_recall"] == 1 and got.score == pytest.approx(2 / 301)


def test_overlap_is_that_of_multisets(spark):
    import random
    from collections import Counter

    r = random.Random(4)
    rows = [([r.choice("abcde") for _ in range(r.randrange(0, 30))], [r.choice("abcde") for _ in range(r.randrange(0, 30))]) for _ in range(80)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", F.sort_array("a").alias("x"), F.sort_array("b").alias("y")).select("a", "b", F.size(F.array_intersect(T.numbered(F.col("x")), T.numbered(F.col("y")))).alias("n"))
    for row in df.collect():
        assert row.n == sum((Counter(row.a) & Counter(row.b)).values())
