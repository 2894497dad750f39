"""Aggregates, comparisons and checks: golden values recomputed from the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import errors, optics, stats
from tallyframe.operators import aggregate, compare, cost, quality

ROWS = [("task_001", True, 0.95, {"mtf": 0.95, "spot_size": 0.005}, None, 10.5, 0.05), ("task_002", True, 0.88, {"mtf": 0.88, "spot_size": 0.008}, None, 12.3, 0.06), ("task_003", False, 0.45, {"mtf": 0.45}, None, 8.7, 0.04), ("task_004", True, 0.92, {"mtf": 0.92, "spot_size": 0.006}, None, 11.2, 0.055)]
SCHEMA = "task_id string, success boolean, score double, metrics map<string,double>, error string, execution_time double, cost double"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_totals_and_statistics(spark, rows):
    t = aggregate.totals(rows).first()
    assert (t.total_tasks, t.successful_tasks, t.success_rate, t.avg_score) == (4, 3, 0.75, pytest.approx(0.8))
    s = aggregate.statistics(rows).first()
    want = {"mean_score": 0.8, "std_score": 0.203592731, "median_score": 0.9, "p25_score": 0.7725, "p75_score": 0.9275, "mean_latency": 10.675, "median_latency": 10.85, "p95_latency": 12.135, "max_latency": 12.3, "total_cost": 0.205, "avg_cost": 0.05125}
    assert {k: s[k] for k in want} == pytest.approx(want)
    empty = rows.limit(0)
    assert aggregate.totals(empty).first().asDict() == {"total_tasks": 0, "successful_tasks": 0, "success_rate": 0.0, "avg_score": 0.0, "avg_execution_time": 0.0, "total_cost": 0.0}
    assert aggregate.statistics(empty).count() == 0 and aggregate.metric_summary(empty, ["mtf"]).count() == 0


def test_ladder_percentiles(spark):
    s = aggregate.statistics(spark.createDataFrame([("t", True, k / 10, None, None, 1.0, 0.0) for k in range(1, 11)], SCHEMA)).first()
    assert (s.p25_score, s.median_score, s.p75_score) == pytest.approx((0.325, 0.55, 0.775))


def test_metric_summary_counts_absent_as_zero(rows):
    got = {r.metric: r for r in aggregate.metric_summary(rows, ["mtf", "spot_size"]).collect()}
    assert got["spot_size"].min == 0.0 and got["spot_size"].mean == pytest.approx(0.019 / 4) and got["mtf"].std == pytest.approx(0.203592731)


def test_composite(rows):
    c = aggregate.composite(rows).first()
    assert (c.efficiency, c.cost, c.composite_score) == pytest.approx((0.911041667, 0.8975, 0.821833333))
    assert aggregate.composite(rows.limit(0)).first().composite_score == pytest.approx(0.15)
    assert aggregate.composite(rows, weights={"success_rate": 1.0, "performance": 0.0, "efficiency": 0.0, "cost": 0.0}).first().composite_score == pytest.approx(0.75)


def test_comparison(spark):
    a = [("A", 0.85 + (i % 3) * 0.05) for i in range(5)]
    b = [("B", 0.80 + (i % 3) * 0.03) for i in range(5)]
    r = compare.compare_models(spark.createDataFrame(a + b, "model string, score double")).first()
    assert (r.mean_a, r.mean_b, r.t_statistic, r.p_value) == pytest.approx((0.89, 0.824, 3.382170254, 0.000719156)) and r.significant and r.winner == "A"
    flat = compare.compare_models(spark.createDataFrame([("A", 0.9)] * 10 + [("B", 0.5)] * 10, "model string, score double")).first()
    assert (flat.t_statistic, flat.p_value, flat.significant) == (0.0, 1.0, False)
    assert compare.compare_models(spark.createDataFrame([("A", 0.5), ("B", 0.5)], "model string, score double")).first().winner == "B"


def test_normal_cdf(spark):
    for z in (-7.0, -1.96, -0.1, 0.0, 0.5, 1.0, 2.3915, 4.0, 5.9, 8.0):
        assert spark.range(1).select(stats.normal_cdf(F.lit(z))).first()[0] == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=1e-9)


@pytest.mark.parametrize(("error", "score", "want"), [("Request TIMED OUT", 0.0, "timeout"), ("rapid", 0.0, "api_error"), ("Rate limit", 0, "api_error"), ("cannot parse", 0, "invalid_output"), ("below threshold", 0, "quality_below_threshold"), ("odd", 0, "other"), (None, 0.3, "quality_below_threshold"), ("", 0.7, "other")])
def test_error_classes(spark, error, score, want):
    assert spark.range(1).select(errors.classify(F.lit(error).cast("string"), F.lit(score))).first()[0] == want


def test_histogram_has_all_categories(rows):
    got = {r.category: r["count"] for r in aggregate.error_histogram(rows).collect()}
    assert got == {"success": 3, "timeout": 0, "api_error": 0, "invalid_output": 0, "quality_below_threshold": 1, "other": 0}
    assert sum(r["count"] for r in aggregate.error_histogram(rows.limit(0)).collect()) == 0


def test_quality(spark, rows):
    bad = spark.createDataFrame([(1, "", True, 0.5, None, None, 1.0, 0.0), (2, "a", True, 1.5, None, None, -5.0, -1.0), (3, "b", True, float("nan"), None, None, 1.0, 0.0), (4, None, True, float("inf"), None, None, 1.0, 0.0), (5, "c", True, 1.0, None, None, 1.0, 0.0)], "row int, " + SCHEMA)
    assert sorted((r.row, r.rule) for r in quality.issues(bad, "row").collect()) == [(1, 1), (2, 2), (2, 3), (2, 4), (3, 5), (4, 1), (4, 4), (4, 5)]
    report = quality.validate(bad, "row").first()
    assert not report.valid and report.issues[0] == "row 1: missing task_id" and report.issues[-1] == "1 latency outliers" and len(report.issues) == 9
    assert quality.validate(rows.withColumn("row", F.lit(1)), "row").first().valid and quality.validate(bad.limit(0), "row").first().valid
    spread = spark.createDataFrame([(k, "t", True, 1.0, None, None, 1.0 if k < 11 else 100.0, 0.0) for k in range(12)], "row int, " + SCHEMA)
    assert quality.latency_outliers(spread).first().outliers == 1 and quality.validate(spread, "row").first().issues == ["1 latency outliers"]
    assert quality.latency_outliers(bad.limit(0)).count() == 0


def test_consistency(spark, rows):
    runs = rows.unionByName(rows.where("task_id = 'task_001'").withColumn("score", F.lit(0.3))).withColumn("pos", F.monotonically_increasing_id())
    got = aggregate.consistency(runs, "pos").collect()
    assert [(r.task_id, r.num_runs, sorted(r.scores)) for r in got] == [("task_001", 2, [0.3, 0.95])]
    s = aggregate.consistency_summary(runs).first()
    assert (s.num_tasks, s.total_runs, s.inconsistent_tasks, s.avg_runs_per_task) == (4, 5, 1, 1.25)
    assert aggregate.consistency_summary(runs.limit(0)).first().avg_runs_per_task == 0.0


def test_error_details_order(spark):
    rows = [(k, f"t{k}", False, 0.0, None, e, t, 0.0) for k, (e, t) in enumerate([("api down", 5.0), ("timeout", 60.0), ("", 99.0), (None, 99.0), ("invalid", 5.0)])]
    got = quality.error_details(spark.createDataFrame(rows, "pos int, " + SCHEMA), "pos").collect()
    assert [(r.task_id, r.category) for r in got] == [("t1", "timeout"), ("t0", "api_error"), ("t4", "invalid_output")]


def test_costs_lookup_history(spark):
    got = cost.token_cost(spark.createDataFrame([("openai", 1000, 2000), ("ollama", 9, 9), ("nobody", 1, 1)], "provider string, tokens_in long, tokens_out long")).collect()
    assert {r.provider: r.cost for r in got} == {"openai": pytest.approx(0.07), "ollama": 0.0, "nobody": None}
    usage = spark.createDataFrame([({"input_tokens": 7}, "x" * 9), ({}, "x" * 9), (None, "x" * 9)], "u map<string,bigint>, t string")
    assert [r[0] for r in usage.select(cost.tokens_of(F.col("u"), F.col("t"), "prompt_tokens", "input_tokens")).collect()] == [7, 2, 2]
    turns = spark.createDataFrame([(1, 0, "system", "s0"), (1, 2, "user", "u"), (1, 1, "system", "s1")], "conv_id long, turn long, role string, text string")
    assert cost.history(turns).first().system == "s1" and cost.history(turns, "first").first().system == "s0" and [m.turn for m in cost.history(turns).first().messages] == [0, 1, 2]
    found = cost.lookup_providers(spark.createDataFrame([("a",), ("b",)], "provider_id string"), spark.createDataFrame([("a", "A")], "provider_id string, name string"))
    assert {r.provider_id: r.error for r in found.collect()} == {"a": None, "b": "Provider not found: b"}


def test_optics(spark):
    row = spark.range(1).select(
        optics.propagated(F.lit(0.1), F.lit(50.0)).alias("y"), optics.through_thin_lens(F.lit(0.1), F.lit(5.0), F.lit(50.0)).alias("t"), optics.mtf(F.lit(0.0), F.lit(0.55), F.lit(2.0)).alias("m0"), optics.mtf(F.lit(5.0), F.lit(0.55), F.lit(2.0)).alias("m1"),
        optics.distortion(F.lit(11.0), F.lit(10.0)).alias("d"), optics.distortion(F.lit(1.0), F.lit(0.0)).alias("d0"), optics.transmission(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.0))).alias("tr"), optics.achromat_powers(F.lit(100.0)).alias("a"), optics.attainment(F.lit(2.0), F.lit(1.0)).alias("at"), optics.cost_efficiency(F.lit(0.5), F.lit(0.0)).alias("ce"),
    ).first()
    assert (row.y, row.t, row.m0, row.m1, row.d, row.d0, row.tr, row.at, row.ce) == pytest.approx((5.0, 0.0, 1.0, 0.0, 10.0, 0.0, 0.25, 1.0, 0.0)) and row.a.first == pytest.approx(0.02)


def test_exact_percentiles_against_sorting(spark):
    import random
    import statistics

    r = random.Random(2)
    rows = [(g, r.choice([round(r.gauss(0, 1), 1), r.gauss(0, 1), r.random() * 1e6, -r.random() / 1e6, 0.0])) for g in ("a", "b", None) for _ in range(r.randint(1, 400))] + [("one", 3.5), ("none", None)]
    got = {(x.g, x.q): x.value for x in aggregate.exact_percentiles(spark.createDataFrame(rows, "g string, x double"), {"x": (0.0, 0.1, 0.5, 0.95, 1.0)}, "g").collect()}
    for g in ("a", "b", None, "one"):
        values = sorted(x for k, x in rows if k == g)
        for q in (0.0, 0.1, 0.5, 0.95, 1.0):
            at = q * (len(values) - 1)
            low, share = int(at), at - int(at)
            assert got[g, q] == pytest.approx(values[low] * (1 - share) + values[min(low + 1, len(values) - 1)] * share, abs=1e-12)
        assert got[g, 0.5] == pytest.approx(statistics.median(values))
    assert not any(g == "none" for g, _ in got)


def test_weights_and_merit(spark):
    three = lambda *x: F.array(*[F.lit(float(k)) for k in x])
    row = spark.range(1).select(aggregate.weighted_score(three(1, 0.5, 0), three(0.4, 0.2, 0.2)).alias("w"), aggregate.weighted_score(three(1), three(0)).alias("z"), optics.merit(three(1, 2), three(0.5, 3), three(1, 2)).alias("m")).first()
    assert (row.w, row.z, row.m) == pytest.approx((0.625, 0.0, 0.5))
    assert optics.glasses(spark).count() == 4


def test_validation_report_is_bounded(spark):
    rows = spark.createDataFrame([(k, "", 2.0, -1.0, 1.0) for k in range(30)], "n long, task_id string, score double, cost double, execution_time double")
    found = quality.validate(rows, "n", most=4).first()
    assert (found.valid, found.n_issues, len(found.issues)) == (False, 90, 4) and found.issues[0].startswith("row 0: ")
