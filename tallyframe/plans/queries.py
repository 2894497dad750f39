"""The queries over the driver's tables, and DuckDB SQL with the same results."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import optics, template, text as T
from ..functions.errors import CATEGORIES, RULES
from ..functions.stats import TERMS
from ..model import Criterion, Metric, ScorerConfig
from ..operators import aggregate, compare, cost, plugin, quality, retrieval, scorers, similarity
from ..sources import jsonl, optics_text
from ..sources.shared import new_folder, stored
from ..streaming import results as streams, resume
from ..sources.config import TaskConfig
from . import engine, hosts, suite

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

METRICS = ScorerConfig("metric_based", (Metric("k", "binary"), Metric("k"), Metric("flag", "binary"), Metric("absent"), Metric("opinion", "llm_judge")), (Criterion("k", ">=", 50), Criterion("absent", "<=", 1), Criterion("flag", ">=", True)))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, so that engines that sum in another order agree."""
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- row scorers


@query(
    f"WITH {hosts.ANSWERS_SQL} SELECT event_id, NOT broken AND k >= 50 AND flag AS success, CASE WHEN broken THEN 0.0 ELSE round((CAST(k >= 50 AS INT) + 1 + CAST(flag AS INT)) / 3.0::DOUBLE, 6) END AS score, "
    "CASE WHEN NOT broken THEN k END AS k, CASE WHEN NOT broken THEN CAST(flag AS DOUBLE) END AS flag, CASE WHEN NOT broken THEN 0.0::DOUBLE END AS absent, CASE WHEN NOT broken THEN 0.5::DOUBLE END AS opinion, CASE WHEN broken THEN 'invalid JSON' END AS error FROM answers"
)
def metric_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scorers.score(hosts.answers(spark, sf_dir), METRICS)
    return rounded(done.select("event_id", "success", "score", *[F.try_element_at("metrics", F.lit(n)).alias(n) for n in ("k", "flag", "absent", "opinion")], "error"))


@query(f"WITH {hosts.ANSWERS_SQL} SELECT event_id, k >= 50 AS met_k, TRUE AS met_absent, flag AS met_flag, CAST(k AS BIGINT) AS predicted_k FROM answers WHERE NOT broken")
def criteria_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the details of scored rows say of each criterion, and the answer that they keep."""
    done = scorers.score(hosts.answers(spark, sf_dir), METRICS).where("error is null")
    told = F.from_json("details", "predicted struct<k:bigint>, criteria_met map<string,boolean>")
    return done.select("event_id", told.alias("d")).select("event_id", *[F.col("d.criteria_met")[n].alias(f"met_{n}") for n in ("k", "absent", "flag")], F.col("d.predicted.k").alias("predicted_k"))


@query(
    f"WITH {hosts.RESULTS_SQL} SELECT model, count(*) AS total_tasks, count(*) FILTER (k >= 50 AND execution_time <= 100) AS met_all, round(avg((CAST(k >= 50 AS INT) + CAST(execution_time <= 100 AS INT)) / 2.0::DOUBLE), 6) AS avg_share FROM results GROUP BY model"
)
def criteria_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    success, share, _ = scorers.judged(F.col("metrics"), (Criterion("k", ">=", 50), Criterion("value", "<=", 100)))
    return hosts.results(spark, sf_dir).groupBy("model").agg(F.count("*").alias("total_tasks"), F.count_if(success).alias("met_all"), r6(F.avg(share)).alias("avg_share"))


@query(
    f"WITH {hosts.RESULTS_SQL}, long AS (SELECT model, unnest(['k', 'value', 'absent']) AS metric, unnest([CAST(k AS DOUBLE), execution_time, 0.0]) AS v FROM results) SELECT model, metric, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(stddev_pop(v), 6) AS std FROM long GROUP BY ALL"
)
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.metric_summary(hosts.results(spark, sf_dir), ["k", "value", "absent"], "model"))


@query(
    f"WITH {hosts.PAIRS_SQL}, {hosts.ODD_SQL}, v AS (SELECT conv_id, turn, predicted_output = expected_output AS success FROM pairs UNION ALL SELECT conv_id, turn, equal FROM odd) SELECT conv_id, turn, success, CASE WHEN success THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM v"
)
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorers.score(hosts.pairs(spark, sf_dir).unionByName(hosts.odd_pairs(spark)), ScorerConfig("exact_match")).select("conv_id", "turn", "success", "score")


WORDS = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _tokens_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '{WORDS}'), lambda w: w <> '')"


TOKENS_SQL = f"{hosts.PAIRS_SQL}, words AS (SELECT conv_id, turn, {_tokens_sql('predicted_output')} AS p, {_tokens_sql('expected_output')} AS r FROM pairs)"
JACCARD = "CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN {2} WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END"


@query(f"WITH {TOKENS_SQL}, {hosts.ODD_SQL}, s AS (SELECT conv_id, turn, {JACCARD.format('p', 'r', '1.0')} AS v FROM words UNION ALL SELECT conv_id, turn, shared::DOUBLE / every FROM odd) SELECT conv_id, turn, v >= 0.8 AS success, round(v::DOUBLE, 6) AS score FROM s")
def partial_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scorers.score(hosts.pairs(spark, sf_dir).unionByName(hosts.odd_pairs(spark)), ScorerConfig("partial_match")).select("conv_id", "turn", "success", "score"))


@query(f"WITH {hosts.ORDERS_SQL} SELECT o_orderkey, round((CAST(s AS INT) + CAST(p AS INT))::DOUBLE / (3 + CAST(third AS INT)), 6) AS score, (CAST(s AS INT) + CAST(p AS INT))::DOUBLE / (3 + CAST(third AS INT)) >= 0.6 AS success FROM pairs")
def dict_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scorers.score(hosts.orders_json(spark, sf_dir), ScorerConfig("partial_match", settings={"threshold": 0.6}))
    return rounded(done.select("o_orderkey", "score", "success"))


#: Precision, recall and F-score of a table v with a and b, to six digits.
_PRF_OF_V = 'SELECT conv_id, turn, round(a::DOUBLE, 6) AS "precision", round(b::DOUBLE, 6) AS recall, round(CASE WHEN a + b = 0 THEN 0 ELSE 2 * a * b / (a + b) END::DOUBLE, 6) AS f_score FROM v'
_F_OF_V = 'SELECT conv_id, turn, CASE WHEN a + b = 0 THEN 0 ELSE 2 * a * b / (a + b) END::DOUBLE AS f FROM v'


def _rouge_sql(n: int, last: str = _PRF_OF_V) -> str:
    gram = "p" if n == 1 else "[array_to_string({0}[i:i + 1], chr(1)) for i in range(1, len({0}))]"
    p, r = ("p", "r") if n == 1 else (gram.format("p"), gram.format("r"))
    return f"""WITH {TOKENS_SQL}, grams AS (SELECT conv_id, turn, {p} AS p, {r} AS r FROM words),
    pc AS (SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, unnest(p) AS g FROM grams) GROUP BY ALL), rc AS (SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, unnest(r) AS g FROM grams) GROUP BY ALL),
    o AS (SELECT conv_id, turn, sum(least(pc.c, rc.c)) AS n FROM pc JOIN rc USING (conv_id, turn, g) GROUP BY ALL),
    v AS (SELECT conv_id, turn, CASE WHEN len(p) = 0 THEN 0 ELSE coalesce(n, 0)::DOUBLE / len(p) END AS a, CASE WHEN len(r) = 0 THEN 0 ELSE coalesce(n, 0)::DOUBLE / len(r) END AS b FROM grams LEFT JOIN o USING (conv_id, turn))
    {last}"""


def _rouge(n: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = scorers.rouge(hosts.pairs(spark, sf_dir))
        return rounded(made.select("conv_id", "turn", *[F.col(f"rouge_{n}_{c}").alias(c) for c in ("precision", "recall", "f_score")]))

    run.__name__ = f"rouge_{n}"
    return run


for _n in (1, 2):
    query(_rouge_sql(_n))(_rouge(str(_n)))

#: A row of the table for each reference word: a cell is the one before, or one more than the best before a match.
LCS_SQL = f"""WITH RECURSIVE {TOKENS_SQL}, step AS (
    SELECT conv_id, turn, p, r, 0 AS i, list_transform(p, lambda w: 0) AS row FROM words WHERE len(p) > 0 AND len(r) > 0
    UNION ALL SELECT conv_id, turn, p, r, i + 1, list_transform(range(1, len(p) + 1), lambda j: greatest(row[j], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda q: p[q] = r[i + 1]), lambda q: 1 + CASE WHEN q > 1 THEN row[q - 1] ELSE 0 END)), 0))) FROM step WHERE i < len(r)),
    ends AS (SELECT conv_id, turn, row[len(p)] AS n FROM step WHERE i = len(r)),
    v AS (SELECT conv_id, turn, CASE WHEN len(p) = 0 THEN 0 ELSE coalesce(n, 0)::DOUBLE / len(p) END AS a, CASE WHEN len(r) = 0 THEN 0 ELSE coalesce(n, 0)::DOUBLE / len(r) END AS b FROM words LEFT JOIN ends USING (conv_id, turn))
    """
query(LCS_SQL + _PRF_OF_V)(_rouge("l"))


_CC = "CASE WHEN len(r) = 0 THEN 0 ELSE len(list_intersect(p, r))::DOUBLE / len(list_distinct(r)) END"


@query(
    f"WITH r1 AS ({_rouge_sql(1, _F_OF_V)}), r2 AS ({_rouge_sql(2, _F_OF_V)}), rl AS ({LCS_SQL + _F_OF_V}), cc AS (WITH {TOKENS_SQL} SELECT conv_id, turn, {_CC} AS cc FROM words), "
    "s AS (SELECT conv_id, turn, r1.f AS a, r2.f AS b, rl.f AS c, cc, 0.2::DOUBLE * r1.f + 0.3::DOUBLE * r2.f + 0.5::DOUBLE * rl.f AS score FROM r1 JOIN r2 USING (conv_id, turn) JOIN rl USING (conv_id, turn) JOIN cc USING (conv_id, turn)) "
    "SELECT conv_id, turn, score >= 0.05 AS success, round(score, 6) AS score, round(a, 6) AS rouge_1, round(b, 6) AS rouge_2, round(c, 6) AS rouge_l, round(cc, 6) AS content_coverage FROM s"
)
def summarization_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scorers.score(hosts.pairs(spark, sf_dir), ScorerConfig("rouge", criteria=(Criterion("composite_score", ">=", 0.05),)))
    return rounded(done.select("conv_id", "turn", "success", "score", *[F.col("metrics")[c].alias(c) for c in ("rouge_1", "rouge_2", "rouge_l", "content_coverage")]))


@query(f"WITH {TOKENS_SQL} SELECT conv_id, turn, round({_CC}, 6) AS content_coverage FROM words")
def content_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = hosts.pairs(spark, sf_dir).select("conv_id", "turn", T.tokens(F.col("predicted_output")).alias("p"), T.tokens(F.col("expected_output")).alias("r"))
    return rounded(w.select("conv_id", "turn", T.ratio(F.size(F.array_intersect("p", "r")), F.size(F.array_distinct("r"))).alias("content_coverage")))


# ---- retrieval

_PRF = "CASE WHEN len(predicted) = 0 AND len(expected) = 0 THEN 1.0 WHEN len(predicted) = 0 OR len(expected) = 0 THEN 0.0 ELSE {0} END::DOUBLE"
_HIT = "len(list_intersect(predicted, expected))::DOUBLE"


@query(
    f"WITH {hosts.CARTS_SQL} SELECT o_custkey, round({_PRF.format(_HIT + ' / len(predicted)')}, 6) AS \"precision\", round({_PRF.format(_HIT + ' / len(expected)')}, 6) AS recall, "
    f"round({_PRF.format('2 * ' + _HIT + ' / (len(predicted) + len(expected))')}, 6) AS f1, CASE WHEN len(predicted) > 0 AND len(expected) > 0 THEN len(list_intersect(predicted, expected)) END::BIGINT AS num_correct FROM carts"
)
def retrieval_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r, f, n = retrieval.precision_recall(F.col("predicted"), F.col("expected"))
    return rounded(hosts.carts(spark, sf_dir).select("o_custkey", p.alias("precision"), r.alias("recall"), f.alias("f1"), n.cast("long").alias("num_correct")))


_NEAR_TITLES = (
    f"{hosts.TITLES_SQL}, extra AS (SELECT p_brand, p_size, unnest(list_filter(predicted, lambda x: NOT list_contains(expected, x))) AS x FROM lists), missed AS (SELECT p_brand, p_size, unnest(list_filter(expected, lambda x: NOT list_contains(predicted, x))) AS y FROM lists), "
    f"xt AS (SELECT *, list_distinct({_tokens_sql('x')}) AS a FROM extra), yt AS (SELECT *, list_distinct({_tokens_sql('y')}) AS b FROM missed), near AS (SELECT DISTINCT p_brand, p_size, x FROM xt JOIN yt USING (p_brand, p_size) WHERE {JACCARD.format('a', 'b', '0.0')} > 0.8), n AS (SELECT p_brand, p_size, count(*) AS c FROM near GROUP BY ALL) "
)


@query(
    f"WITH {_NEAR_TITLES} "
    "SELECT p_brand, p_size, round((len(list_intersect(predicted, expected)) + 0.5 * coalesce(c, 0)) / len(expected), 6)::DOUBLE AS citation_accuracy, len(predicted)::BIGINT AS num_predicted, len(expected)::BIGINT AS num_expected FROM lists LEFT JOIN n USING (p_brand, p_size)"
)
def citation_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = hosts.titles(spark, sf_dir)
    return rounded(made.select("p_brand", "p_size", retrieval.citation_accuracy(F.col("predicted"), F.col("expected")).alias("citation_accuracy"), F.size("predicted").cast("long").alias("num_predicted"), F.size("expected").cast("long").alias("num_expected")))


@query(
    f"WITH {_NEAR_TITLES}, v AS (SELECT p_brand, p_size, {_HIT} / len(expected) AS r, {_HIT} / len(predicted) AS p, (len(list_intersect(predicted, expected)) + 0.5::DOUBLE * coalesce(c, 0)) / len(expected) AS a FROM lists LEFT JOIN n USING (p_brand, p_size)) "
    "SELECT p_brand, p_size, p_brand <> 'Brand#3' AND r >= 0.3 AS success, CASE WHEN p_brand = 'Brand#3' THEN 0 ELSE round(0.3::DOUBLE * r + 0.3::DOUBLE * p + 0.4::DOUBLE * a, 6) END AS score, CASE WHEN p_brand = 'Brand#3' THEN 'invalid JSON' END AS error FROM v "
    f"UNION ALL SELECT * FROM (WITH {hosts.ODD_PAPERS_SQL} SELECT p_brand, p_size, coalesce(r >= 0.3, FALSE), coalesce(round(0.3 * r + 0.3 * p + 0.4 * a, 6), 0), CASE WHEN p IS NULL THEN 'invalid title' END FROM odd)"
)
def citation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scorer over JSON texts: lists of objects with titles, wrapped for half of the groups; the answers of one brand have text behind the list."""
    made = hosts.titles(spark, sf_dir)
    papers = F.to_json(F.transform("expected", lambda t: F.struct(t.alias("title"))))
    tail = F.when(F.col("p_brand") == "Brand#3", F.lit(" and more")).otherwise(F.lit(""))
    texts = made.select("p_brand", "p_size", F.concat(F.to_json("predicted"), tail).alias("predicted_output"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('{"papers": '), papers, F.lit("}"))).otherwise(papers).alias("expected_output"))
    texts = texts.unionByName(hosts.odd_papers(spark))
    done = scorers.score(texts, ScorerConfig("citation", criteria=(Criterion("recall", ">=", 0.3),)))
    return rounded(done.select("p_brand", "p_size", "success", "score", "error"))


@query(
    f"WITH {_NEAR_TITLES}, v AS (SELECT p_brand, p_size, len(predicted)::BIGINT AS num_predicted, len(expected)::BIGINT AS num_expected, len(list_intersect(predicted, expected))::BIGINT AS exact, coalesce(c, 0) AS partial FROM lists LEFT JOIN n USING (p_brand, p_size)) "
    "SELECT *, round((exact + 0.5 * partial) / num_expected, 6)::DOUBLE AS citation_accuracy FROM v"
)
def citation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation accuracy of lists whose titles are rows of two tables, by a similarity join."""
    return rounded(similarity.cited(*hosts.title_rows(spark, sf_dir), "title", "p_brand", "p_size"))


@query(
    f"WITH a AS (SELECT DISTINCT regexp_replace(text, '^\\S+\\s+', '') AS text FROM conversations), b AS (SELECT DISTINCT text FROM conversations), aw AS (SELECT text, list_distinct({_tokens_sql('text')}) AS a FROM a), bw AS (SELECT text AS other, list_distinct({_tokens_sql('text')}) AS b FROM b), "
    f"met AS (SELECT text, {JACCARD.format('a', 'b', '0.0')} AS s FROM aw JOIN bw ON len(a) > 0.8 * len(b) AND len(b) > 0.8 * len(a)) SELECT text, count(*) AS matches, round(max(s), 6) AS best FROM met WHERE s > 0.8 GROUP BY text"
)
def fuzzy_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that lost their first word, with the turns that they are like: a similarity join of two tables."""
    return rounded(similarity.similar_texts(*hosts.cut_turns(spark, sf_dir), "text"))


# ---- aggregates


@query(f"WITH {hosts.RESULTS_SQL} SELECT model, count(*) AS total_tasks, count(*) FILTER (success) AS successful_tasks, round(avg(CAST(success AS INT)), 6) AS success_rate, round(avg(score), 6) AS avg_score, round(avg(execution_time), 6) AS avg_execution_time, round(sum(cost), 6) AS total_cost FROM results GROUP BY model")
def aggregate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.totals(hosts.results(spark, sf_dir), "model"))


@query(
    f"WITH {hosts.RESULTS_SQL} SELECT model, count(*) AS num_tasks, round(avg(score), 6) AS mean_score, round(quantile_cont(score, 0.5), 6) AS median_score, round(stddev_pop(score), 6) AS std_score, min(score) AS min_score, max(score) AS max_score, round(quantile_cont(score, 0.25), 6) AS p25_score, round(quantile_cont(score, 0.75), 6) AS p75_score, "
    "round(avg(execution_time), 6) AS mean_latency, round(quantile_cont(execution_time, 0.5), 6) AS median_latency, round(quantile_cont(execution_time, 0.95), 6) AS p95_latency, max(execution_time) AS max_latency, count(*) FILTER (success) AS success_count, round(avg(CAST(success AS INT)), 6) AS success_rate, round(sum(cost), 6) AS total_cost, round(avg(cost), 6) AS avg_cost FROM results GROUP BY model"
)
def result_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.statistics(hosts.results(spark, sf_dir), "model"))


def _odd_logs() -> str:
    """Logarithms of 1, 1*3, 1*3*5, ... as a list."""
    total, out = 0.0, []
    for k in range(TERMS + 1):
        total += math.log(2 * k + 1)
        out.append(f"{total!r}")
    return "[" + ", ".join(out) + "]"


_CDF = f"0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, {TERMS + 1}), lambda k: exp((2 * k + 1) * ln(z) - {_odd_logs()}[k + 1])))"


@query(
    f"WITH {hosts.RESULTS_SQL}, m AS (SELECT model, avg(score) AS mean, var_pop(score) AS v, count(*) AS n FROM results GROUP BY model), t AS (SELECT a.model AS model_a, b.model AS model_b, a.mean AS mean_a, b.mean AS mean_b, a.mean - b.mean AS difference, (a.mean - b.mean) / sqrt(a.v / a.n + b.v / b.n) AS t FROM m a JOIN m b ON a.model < b.model), "
    f"z AS (SELECT *, abs(t) AS z FROM t), p AS (SELECT *, CASE WHEN z > 6 THEN 0.0 WHEN z = 0 THEN 1.0 ELSE 2 * (1 - ({_CDF})) END AS p FROM z) SELECT model_a, model_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(difference, 6) AS difference, round(t, 6) AS t_statistic, round(p, 6) AS p_value, p < 0.05 AS significant, CASE WHEN mean_a > mean_b THEN 'A' ELSE 'B' END AS winner FROM p"
)
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.compare_models(hosts.results(spark, sf_dir)))


_PARTS = "avg(CAST(success AS INT)) AS s, avg(score) AS p, CASE WHEN avg(execution_time) <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - avg(execution_time) / 120)) END AS e, CASE WHEN sum(cost) <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - sum(cost) / 2)) END AS c"


@query(f"WITH {hosts.RESULTS_SQL}, v AS (SELECT model, {_PARTS} FROM results GROUP BY model) SELECT model, round(s, 6) AS success_rate, round(p, 6) AS performance, round(e, 6) AS efficiency, round(c, 6) AS cost, round(0.30 * s + 0.35 * p + 0.20 * e + 0.15 * c, 6) AS composite_score FROM v")
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.composite(hosts.results(spark, sf_dir), "model"))


_CLASS = "CASE WHEN coalesce(error, '') = '' THEN CASE WHEN score < 0.5 THEN 'quality_below_threshold' ELSE 'other' END " + " ".join("WHEN " + " OR ".join(f"contains(lower(error), '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in RULES) + " ELSE 'other' END"


@query(
    f"WITH {hosts.RESULTS_SQL}, kinds AS (SELECT model, CASE WHEN success THEN 'success' ELSE {_CLASS} END AS category FROM results), every AS (SELECT model, category FROM (SELECT DISTINCT model FROM results), (SELECT unnest({list(CATEGORIES)}) AS category)) "
    "SELECT model, category, count(k.category) AS count FROM every LEFT JOIN kinds k USING (model, category) GROUP BY ALL"
)
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.error_histogram(hosts.results(spark, sf_dir), "model")


@query(f"WITH {hosts.RESULTS_SQL} SELECT task_id, error, {_CLASS} AS category, score, execution_time, event_id FROM results WHERE NOT success AND coalesce(error, '') <> '' ORDER BY execution_time DESC, event_id LIMIT 100")
def error_details_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred slowest failures: a top-k report."""
    return quality.error_details(hosts.results(spark, sf_dir), "event_id").limit(100)


@query(f"WITH {hosts.RESULTS_SQL} SELECT task_id, count(*) AS num_runs, round(stddev_pop(score), 6) AS std, array_to_string(list(CAST(k AS VARCHAR) ORDER BY event_id), ',') AS scores FROM results GROUP BY task_id HAVING count(*) > 1 AND round(stddev_pop(score), 9) > 0.1")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregate.consistency(hosts.results(spark, sf_dir), "event_id")
    return found.select("task_id", "num_runs", r6("std").alias("std"), F.array_join(F.transform("scores", lambda s: F.round(s * 100).cast("int").cast("string")), ",").alias("scores"))


@query(f"WITH {hosts.RESULTS_SQL}, g AS (SELECT task_id, count(*) AS n, stddev_pop(score) AS s FROM results GROUP BY task_id) SELECT count(*) AS num_tasks, sum(n)::BIGINT AS total_runs, count(*) FILTER (n > 1 AND round(s, 9) > 0.1) AS inconsistent_tasks, round(sum(n) / count(*), 6)::DOUBLE AS avg_runs_per_task FROM g")
def consistency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.consistency_summary(hosts.results(spark, sf_dir)))


@query(f"WITH {hosts.RESULTS_SQL}, m AS (SELECT model, avg(CAST(success AS INT)) AS s, avg(score) AS a, avg(execution_time) AS t, avg(cost) AS c FROM results GROUP BY model) SELECT model, round(s, 6) AS success_rate, round(a, 6) AS avg_score, round(t, 6) AS avg_time, round(c, 6) AS cost_per_task, rank() OVER (ORDER BY s DESC, a DESC, model) AS rank FROM m")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.leaderboard(hosts.results(spark, sf_dir)))


@query("SELECT conv_id, turn, CAST(sum(length(text) // 4) OVER w AS BIGINT) AS running_total, count(*) OVER w AS running_count FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = hosts.table(spark, sf_dir, "conversations").withColumn("tokens", F.floor(F.length("text") / 4))
    return aggregate.running_totals(turns, "conv_id", "turn", "tokens").select("conv_id", "turn", "running_total", "running_count")


@query(
    f"WITH {hosts.RESULTS_SQL}, r AS (SELECT model, k, execution_time, event_id % 3 = 0 AS has FROM results), long AS (SELECT model, 'k' AS metric, CAST(k AS DOUBLE) AS v FROM r UNION ALL SELECT model, 'value', execution_time FROM r UNION ALL SELECT model, 'rare', CASE WHEN has THEN execution_time - 20 ELSE 0 END FROM r) "
    "SELECT model, metric, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(stddev_pop(v), 6) AS std FROM long GROUP BY ALL"
)
def found_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of all metrics that rows hold; one of them only every third row has."""
    rare = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("rare"), F.col("execution_time") - 20)).otherwise(F.create_map().cast("map<string,double>"))
    return rounded(aggregate.found_metrics(hosts.results(spark, sf_dir).withColumn("metrics", F.map_concat("metrics", rare)), "model"))


@query(
    f"WITH {hosts.RESULTS_SQL}, r AS (SELECT *, 'task ' || (k % 4) AS kind FROM results), m AS (SELECT CASE WHEN grouping(kind) = 1 THEN 'all' ELSE 'kind' END AS level, kind, model, avg(CAST(success AS INT)) AS s, avg(score) AS a, avg(execution_time) AS t, avg(cost) AS c FROM r GROUP BY GROUPING SETS ((model), (kind, model))) "
    "SELECT level, kind, model, round(s, 6) AS success_rate, round(a, 6) AS avg_score, round(t, 6) AS avg_time, round(c, 6) AS cost_per_task, rank() OVER (PARTITION BY level, kind ORDER BY s DESC, a DESC, model) AS rank FROM m"
)
def leaderboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models over all tasks and within each kind of task, from one grouping."""
    kinds = hosts.results(spark, sf_dir).withColumn("kind", F.concat(F.lit("task "), F.col("k") % 4))
    return rounded(aggregate.leaderboards(kinds, "kind"))


def _suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, answers = hosts.suite_rows(spark, sf_dir)
    return suite.run_suite(tasks, answers, suite.suite_of(spark, map(TaskConfig.of, hosts.SUITE)))


@query(f"WITH {hosts.SUITE_SQL} SELECT task, task_id, success, round(score, 6) AS score, error FROM suite")
def suite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven tasks scored by three methods as one plan; what they ask for is data."""
    return rounded(_suite(spark, sf_dir).select("task", "task_id", "success", "score", "error"))


@query(
    f"WITH {hosts.SUITE_SQL}, v AS (SELECT *, CASE WHEN sound THEN k ELSE 0 END::DOUBLE AS kk FROM suite) SELECT task, count(*) AS total_tasks, count(*) FILTER (success) AS successful_tasks, round(avg(CAST(success AS INT)), 6) AS success_rate, round(avg(score), 6) AS avg_score, "
    "round(CASE WHEN task IN ('t0', 't1', 't2') THEN avg(kk) END, 6) AS k_mean, round(CASE WHEN task IN ('t0', 't1', 't2') THEN stddev_pop(kk) END, 6) AS k_std FROM v GROUP BY task"
)
def suite_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the tasks of a suite and the summary of those metrics that each has, from its saved rows."""
    k = F.try_element_at("metrics_summary", F.lit("k"))
    return rounded(suite.suite_totals(stored(_suite(spark, sf_dir), "suite-rows")).select("task", "total_tasks", "successful_tasks", "success_rate", "avg_score", k["mean"].alias("k_mean"), k["std"].alias("k_std")))


# ---- quality


@query(
    f"WITH {hosts.FAULTY_SQL}, r AS (SELECT event_id, 1 AS rule, 'missing task_id' AS issue FROM faulty WHERE coalesce(task_id, '') = '' UNION ALL SELECT event_id, 2, 'negative execution time' FROM faulty WHERE execution_time < 0 UNION ALL SELECT event_id, 3, 'negative cost' FROM faulty WHERE cost < 0 "
    "UNION ALL SELECT event_id, 4, 'score out of range' FROM faulty WHERE NOT isnan(score) AND (score < 0 OR score > 1) UNION ALL SELECT event_id, 5, 'score not finite' FROM faulty WHERE isnan(score) OR isinf(score)) SELECT * FROM r"
)
def qa_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.issues(hosts.faulty(spark, sf_dir), "event_id")


@query(f"WITH {hosts.FAULTY_SQL}, a AS (SELECT avg(execution_time) AS mean, stddev_pop(execution_time) AS std FROM faulty WHERE execution_time >= 0) SELECT round(mean, 6) AS mean, round(std, 6) AS std, count(*) FILTER (abs(execution_time - mean) > 3 * std) AS outliers FROM faulty, a GROUP BY mean, std")
def latency_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.latency_outliers(hosts.faulty(spark, sf_dir)))


@query(
    f"WITH {hosts.FAULTY_SQL}, r AS (SELECT event_id, 1 AS rule, 'missing task_id' AS issue FROM faulty WHERE coalesce(task_id, '') = '' UNION ALL SELECT event_id, 2, 'negative execution time' FROM faulty WHERE execution_time < 0 UNION ALL SELECT event_id, 3, 'negative cost' FROM faulty WHERE cost < 0 "
    "UNION ALL SELECT event_id, 4, 'score out of range' FROM faulty WHERE NOT isnan(score) AND (score < 0 OR score > 1) UNION ALL SELECT event_id, 5, 'score not finite' FROM faulty WHERE isnan(score) OR isinf(score)), "
    "a AS (SELECT avg(execution_time) AS mean, stddev_pop(execution_time) AS std FROM faulty WHERE execution_time >= 0), o AS (SELECT count(*) FILTER (abs(execution_time - mean) > 3 * std) AS outliers FROM faulty, a), "
    "f AS (SELECT event_id, rule, issue FROM r ORDER BY event_id, rule LIMIT 50), t AS (SELECT string_agg('row ' || event_id || ': ' || issue, '; ' ORDER BY event_id, rule) AS first FROM f) "
    "SELECT (SELECT count(*) FROM r) + CAST(outliers > 0 AS INT) = 0 AS valid, (SELECT count(*) FROM r) + CAST(outliers > 0 AS INT) AS n_issues, first || CASE WHEN outliers > 0 THEN '; ' || outliers || ' latency outliers' ELSE '' END AS issues FROM o, t"
)
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows checked and counted, the first fifty issues listed: a top-k report."""
    return quality.validate(hosts.faulty(spark, sf_dir), "event_id", 50).select("valid", "n_issues", F.array_join("issues", "; ").alias("issues"))


# ---- scans and streams


@query("SELECT 'e' || event_id AS task_id, event_type || '?' AS instruction, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS expected_output, CAST(event_id % 4 AS VARCHAR) AS level FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0")
def task_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks from JSON lines; blank, broken and continued lines are left out."""
    found = jsonl.scan_tasks(spark, hosts.task_lines(spark, sf_dir), {"input_field": "question", "output_field": "want", "metadata_fields": ["level", "absent"]})
    return found.select("task_id", "instruction", "expected_output", F.col("metadata")["level"].alias("level"))


_TASK_FIELDS = {"input_field": "question", "output_field": "want", "metadata_fields": ["level", "absent"]}
_TASK_LINES_SQL = "events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0"


@query(f"SELECT 'e' || event_id AS task_id, event_type || '?' || chr(10) || chr(10) || '- level: ' || event_id % 4 AS prompt FROM {_TASK_LINES_SQL}")
def task_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an agent is asked: the instruction, and a line for each member of the metadata."""
    found = jsonl.scan_tasks(spark, hosts.task_lines(spark, sf_dir), _TASK_FIELDS)
    return found.select("task_id", jsonl.prompt(found).alias("prompt"))


@query(f"SELECT 'e' || event_id AS task_id, event_type || '?' AS instruction FROM {_TASK_LINES_SQL} ORDER BY event_id LIMIT 100")
def first_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred tasks in the order of files and lines, then shuffled: how many a run takes is its setting."""
    return jsonl.scan_tasks(spark, hosts.task_lines(spark, sf_dir, ordered=True), _TASK_FIELDS, limit=100, seed=4).select("task_id", "instruction")


@query(
    f"WITH {hosts.ANSWERS_SQL}, v AS (SELECT *, event_id % 31 = 0 AS none FROM answers) SELECT CAST(event_id AS VARCHAR) AS task_id, NOT none AND NOT broken AND k >= 50 AND flag AS success, CASE WHEN none OR broken THEN 0.0 ELSE round((CAST(k >= 50 AS INT) + 1 + CAST(flag AS INT)) / 3.0::DOUBLE, 6) END AS score, "
    "CASE WHEN none THEN 'no answer' WHEN broken THEN 'invalid JSON' END AS error FROM v"
)
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of one task: each instance with its answer, if it has one, and faults as values of rows."""
    own = hosts.answers(spark, sf_dir)
    evaluation = {"metrics": [{"name": "k"}, {"name": "flag", "type": "binary"}, {"name": "absent"}], "success_criteria": [{"metric": "k", "value": 50}, {"metric": "absent", "operator": "<=", "value": 1}, {"metric": "flag", "value": True}]}
    done = engine.run(own.select("task_id", "expected_output"), own.where("event_id % 31 <> 0").select("task_id", "predicted_output"), TaskConfig("events", evaluation=evaluation))
    return rounded(done.select("task_id", "success", "score", "error"))


@query(f"WITH {hosts.RESULTS_SQL} SELECT CASE event_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS run_id, count(*) AS total_tasks, count(*) FILTER (success) AS successful_tasks, round(avg(score), 6) AS avg_score, round(sum(cost), 6) AS total_cost, count(error) AS failed, round(sum(k), 6)::DOUBLE AS sum_k FROM results GROUP BY ALL")
def saved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended to one folder of JSON lines, read again and told apart by their ids."""
    path = new_folder(spark, "runs")
    rows = hosts.results(spark, sf_dir).withColumn("details", F.lit(None).cast("string"))
    for n, run_id in enumerate(("even", "odd")):
        jsonl.save_results(rows.where(F.col("event_id") % 2 == n), path, run_id)
    found = jsonl.scan_runs(spark, [path])
    return rounded(found.groupBy("run_id").agg(F.count("*").alias("total_tasks"), F.count_if("success").alias("successful_tasks"), F.avg("score").alias("avg_score"), F.sum("cost").alias("total_cost"), F.count("error").alias("failed"), F.sum(F.col("metrics")["k"]).alias("sum_k")))


@query(f"WITH {hosts.RESULTS_SQL} SELECT model, count(*) AS total_tasks, count(*) FILTER (success) AS successful_tasks, round(sum(score), 6) AS sum_score, round(sum(cost), 6) AS total_cost FROM results GROUP BY model")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of a stream of results once it has caught up: one row a model reaches the driver."""
    name = f"totals_{uuid.uuid4().hex}"
    totals = streams.running_totals(hosts.results_of(hosts.event_stream(spark, sf_dir)))
    totals.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", new_folder(spark, "totals")).trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.table(name))


@query(
    f"WITH {hosts.LATE_SQL} SELECT strftime(start, '%Y-%m-%d %H') AS start, model, count(*) AS total_tasks, count(*) FILTER (success) AS successful_tasks, round(avg(score), 6) AS avg_score, round(sum(cost), 6) AS total_cost FROM kept, last WHERE start + INTERVAL 6 HOURS <= last.mark GROUP BY ALL"
)
def late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final windows of a stream in four parts, started anew for each: rows behind the watermark are dropped, late ones before it count."""
    source, output, checkpoint = (new_folder(spark, name) for name in ("late-in", "late-out", "late-check"))
    for batch in hosts.late_batches(spark, sf_dir):
        batch.write.mode("append").parquet(source)
        streams.append_windows(spark.readStream.schema(batch.schema).parquet(source), output, checkpoint, "6 hours", "12 hours").awaitTermination()
    found = spark.read.parquet(output)
    start = F.to_utc_timestamp("start", F.current_timezone())
    return rounded(found.select(F.date_format(start, "yyyy-MM-dd HH").alias("start"), "model", "total_tasks", "successful_tasks", "avg_score", "total_cost"))


@query(f"WITH {hosts.SUITE_SQL} SELECT task, task_id, success, round(score, 6) AS score, error FROM suite WHERE NOT none")
def resumed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose stream stops after half of the answers, goes on with all of them, and is started anew without its checkpoint: each task is scored once."""
    source, output, *checks = (new_folder(spark, name) for name in ("resume-in", "resume-out", "resume-check", "resume-again"))
    tasks, answers = hosts.suite_rows(spark, sf_dir)
    asked = suite.suite_of(spark, map(TaskConfig.of, hosts.SUITE))
    for part, check in ((answers.where(F.col("task_id") % 2 == 0), checks[0]), (answers, checks[0]), (answers.limit(0), checks[1])):
        part.write.mode("append").json(source)
        resume.score_stream(spark.readStream.schema("task string, task_id string, predicted_output string").json(source), tasks, asked, output, "run", check).awaitTermination()
    return rounded(suite.scan_suite_results(spark, output, "run").select("task", "task_id", "success", "score", "error"))


# ---- cost, providers, conversations

_NAMES = [p[0] for p in cost.PRICES]


@query(
    f"WITH prices AS (SELECT * FROM (VALUES {', '.join(f'({p!r}, {a}::DOUBLE, {b}::DOUBLE)' for p, a, b in cost.PRICES)}) t(provider, a, b)), turns AS (SELECT ({_NAMES + ['unlisted']})[conv_id % 8 + 1] AS provider, CASE WHEN role = 'user' THEN length(text) // 4 ELSE 0 END AS i, CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END AS o FROM conversations) "
    "SELECT provider, sum(i)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, round(sum(i / 1000 * a + o / 1000 * b), 6) AS cost FROM turns LEFT JOIN prices USING (provider) GROUP BY provider"
)
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = hosts.table(spark, sf_dir, "conversations")
    provider = F.element_at(F.array(*[F.lit(n) for n in [*_NAMES, "unlisted"]]), (F.col("conv_id") % 8 + 1).cast("int"))
    none = F.create_map().cast("map<string,bigint>")
    count = cost.tokens_of(none, F.col("text"), "prompt_tokens", "input_tokens")
    own = turns.select(provider.alias("provider"), F.when(F.col("role") == "user", count).otherwise(F.lit(0)).alias("tokens_in"), F.when(F.col("role") == "assistant", count).otherwise(F.lit(0)).alias("tokens_out"))
    return rounded(cost.token_cost(own).groupBy("provider").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost")))


@query(
    f"WITH p AS (SELECT * FROM (VALUES {', '.join(f'({n!r}, {n.title()!r})' for n in _NAMES)}) t(provider_id, name)), q AS (SELECT conv_id, ({_NAMES + ['unlisted']})[conv_id % 8 + 1] AS provider_id FROM conversations WHERE turn = 0) "
    "SELECT conv_id, provider_id, name, CASE WHEN name IS NULL THEN 'Provider not found: ' || provider_id END AS error, name IS NOT NULL AS found FROM q LEFT JOIN p USING (provider_id)"
)
def provider_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(n, n.title()) for n in _NAMES], "provider_id string, name string")
    provider = F.element_at(F.array(*[F.lit(n) for n in [*_NAMES, "unlisted"]]), (F.col("conv_id") % 8 + 1).cast("int"))
    asked = hosts.table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", provider.alias("provider_id"))
    return cost.lookup_providers(asked, F.broadcast(known)).select("conv_id", "provider_id", "name", "error", "found")  # seven rows


@query("SELECT conv_id, count(*) AS length, array_to_string(list(role || ':' || length(text) ORDER BY turn), ',') AS shape, arg_max(text, turn) FILTER (role = 'system') AS system FROM conversations GROUP BY conv_id")
def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = cost.history(hosts.table(spark, sf_dir, "conversations"))
    return listed.select("conv_id", "length", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["text"]).cast("string"))), ",").alias("shape"), "system")


_RESET_SQL = "marked AS (SELECT *, turn % 4 = 3 AND conv_id % 3 = 0 AS reset, length(text) // 4 AS tokens FROM conversations), sessions AS (SELECT *, CAST(count(*) FILTER (reset) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS session FROM marked)"


def _reset() -> Column:
    return (F.col("turn") % 4 == 3) & (F.col("conv_id") % 3 == 0)


@query(f"WITH {_RESET_SQL} SELECT conv_id, turn, session, CAST(sum(tokens) OVER w AS BIGINT) AS running_tokens, count(*) OVER w AS running_turns FROM sessions WINDOW w AS (PARTITION BY conv_id, session ORDER BY turn)")
def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of conversations that are reset on the way."""
    turns = hosts.table(spark, sf_dir, "conversations")
    return cost.session_totals(turns, _reset(), F.floor(F.length("text") / 4)).select("conv_id", "turn", "session", "running_tokens", "running_turns")


@query(f"WITH {_RESET_SQL} SELECT conv_id, session, count(*) AS length, array_to_string(list(role || ':' || length(text) ORDER BY turn), ',') AS shape, arg_max(text, turn) FILTER (role = 'system') AS system FROM sessions GROUP BY ALL")
def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a conversation's messages between resets."""
    listed = cost.session_history(hosts.table(spark, sf_dir, "conversations"), _reset())
    return listed.select("conv_id", "session", "length", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["text"]).cast("string"))), ",").alias("shape"), "system")


@query(
    "WITH items AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS INT), l_returnflag = 'R') AS n, l_partkey AS part, CAST(l_quantity AS INT) AS q, l_returnflag = 'R' AS back FROM lineitem), "
    "lines AS (SELECT o_orderkey, string_agg(n || '. part ' || part || ' x ' || q || CASE WHEN back THEN ' (back)' WHEN o_orderpriority LIKE '1%' THEN ' (soon)' ELSE '' END || chr(10), '' ORDER BY n) AS t FROM orders JOIN items ON o_orderkey = l_orderkey GROUP BY o_orderkey) "
    "SELECT o_orderkey, '# Order ' || o_orderkey || chr(10) || CASE WHEN o_orderpriority LIKE '1%' THEN 'URGENT' || CASE WHEN o_orderstatus = 'F' THEN ' and finished' ELSE '' END || chr(10) ELSE 'No hurry' || chr(10) END || coalesce(t, '') || 'End' || chr(10) AS prompt FROM orders LEFT JOIN lines USING (o_orderkey)"
)
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt of each order from a template with nested blocks."""
    orders = hosts.orders_with_items(spark, sf_dir)
    return orders.select("o_orderkey", template.render(orders, hosts.PROMPT).alias("prompt"))


@query(
    f"WITH {hosts.PAIRS_SQL}, l AS (SELECT conv_id, turn, length(predicted_output) AS p, length(expected_output) AS e FROM pairs), v AS (SELECT *, p % 7 = 0 AS bad, least(p, e)::DOUBLE / greatest(p, e, 1) AS r FROM l) "
    "SELECT conv_id, turn, NOT bad AND greatest(p, e) >= 100 AS success, CASE WHEN bad THEN 0.0 ELSE round(r, 6) END AS score, CASE WHEN NOT bad THEN greatest(p, e)::DOUBLE END AS longer, CASE WHEN bad THEN 'ValueError: seven' END AS error FROM v"
)
def plugin_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An own scorer over batches; rows that it fails on are errors, the others of their batch are not."""
    plugin.batch_scorer("half_the_length", ("longer",))(hosts.half_the_length)
    done = scorers.score(hosts.pairs(spark, sf_dir), ScorerConfig("half_the_length", criteria=(Criterion("longer", ">=", 100),)))
    return rounded(done.select("conv_id", "turn", "success", "score", F.try_element_at("metrics", F.lit("longer")).alias("longer"), "error"))


@query("SELECT doc_id, substr(coalesce(text, ''), 1, 500) AS clip FROM documents")
def clip_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preview column of 500 characters: the clipping is the feature."""
    return hosts.table(spark, sf_dir, "documents").select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 500).alias("clip"))


# ---- optics


@query(
    f"WITH {hosts.EXPORTS_SQL} SELECT l_orderkey, count(*) FILTER (NOT broken) AS points, coalesce(array_to_string(list(q || '/' || l_linenumber || '/' || l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey, line) FILTER (NOT broken), ','), '') AS series FROM exports GROUP BY l_orderkey"
)
def mtf_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hosts.exports(spark, sf_dir).select("l_orderkey", optics_text.parse_mtf(F.col("text")).alias("m"))
    numbers = F.arrays_zip("m.spatial_frequency", "m.mtf_tangential", "m.mtf_sagittal")
    series = F.transform(numbers, lambda r: F.concat_ws("/", *[r[k].cast("long").cast("string") for k in ("spatial_frequency", "mtf_tangential", "mtf_sagittal")]))
    return found.select("l_orderkey", F.size("m.spatial_frequency").cast("long").alias("points"), F.array_join(series, ",").alias("series"))


@query(f"WITH {hosts.EXPORTS_SQL} SELECT l_orderkey, count(*) FILTER (NOT broken) AS rays, coalesce(sum(CAST(q AS DOUBLE)) FILTER (NOT broken), 0) AS sum_x, coalesce(sum(CAST(l_linenumber AS DOUBLE)) FILTER (NOT broken), 0) AS sum_y FROM exports GROUP BY l_orderkey")
def spot_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hosts.exports(spark, sf_dir).select("l_orderkey", optics_text.parse_spot(F.col("text")).alias("s"))
    total = lambda c: F.aggregate("s.rays", F.lit(0.0), lambda n, r: n + r[c])
    return found.select("l_orderkey", F.size("s.rays").cast("long").alias("rays"), total("x").alias("sum_x"), total("y").alias("sum_y"))


@query("SELECT l_suppkey, round(sqrt(var_pop(l_discount) + var_pop(l_tax)), 6) AS rms FROM lineitem GROUP BY l_suppkey")
def spot_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hosts.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sqrt(F.var_pop("l_discount") + F.var_pop("l_tax")).alias("rms")))


@query("SELECT l_quantity, l_discount, round(CASE WHEN l_discount > 1 / (1.22 * 0.55 * l_quantity / 10) THEN 0 WHEN l_discount = 0 THEN 1 ELSE abs(sin(pi() * l_discount * 1.22 * 0.55 * l_quantity / 10) / (pi() * l_discount * 1.22 * 0.55 * l_quantity / 10)) END::DOUBLE, 6) AS mtf, count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount")
def mtf_sinc(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = hosts.table(spark, sf_dir, "lineitem").groupBy("l_quantity", "l_discount").agg(F.count("*").alias("n"))
    return rounded(grouped.select("l_quantity", "l_discount", optics.mtf(F.col("l_discount"), F.lit(0.55), F.col("l_quantity") / 10).alias("mtf"), "n"))


@query(
    "SELECT p_partkey, round(CASE WHEN p_size % 7 = 0 THEN 0 ELSE (p_size - p_size % 7) * 100.0::DOUBLE / (p_size % 7) END, 6)::DOUBLE AS distortion, round((1 - 0.04::DOUBLE) * (1 - 0.01::DOUBLE * (p_size % 5)) * exp(-0.01::DOUBLE * p_size) * exp(-0.01::DOUBLE * 2), 6) AS transmission, round(p_retailprice / 1000 - p_size / 50.0::DOUBLE, 6) AS lens, round(p_retailprice / 1000 * p_size, 6) AS propagated, "
    "round(greatest(0.0, least(1.0, p_size / 40.0::DOUBLE)), 6)::DOUBLE AS attainment, round(CASE WHEN p_size = 1 THEN 0 ELSE 0.5::DOUBLE / (p_size - 1) END, 6)::DOUBLE AS efficiency, round(1 + 0.5 * (p_size / 50.0::DOUBLE) * cos(0.3::DOUBLE) + 0.25 * pow(p_size / 50.0::DOUBLE, 2) * cos(0.6::DOUBLE), 6) AS wavefront FROM part"
)
def optics_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, angle = F.col("p_size").cast("double"), F.col("p_retailprice") / 1000
    return rounded(
        hosts.table(spark, sf_dir, "part").select(
            "p_partkey", optics.distortion(size, size % 7).alias("distortion"), optics.transmission(F.array(F.lit(0.04), 0.01 * (size % 5)), F.array(size, F.lit(2.0))).alias("transmission"), optics.through_thin_lens(angle, size, F.lit(50.0)).alias("lens"), optics.propagated(angle, size).alias("propagated"),
            optics.attainment(size, F.lit(40.0)).alias("attainment"), optics.cost_efficiency(F.lit(0.5), size - 1).alias("efficiency"), optics.wavefront(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.25)), size / 50, F.lit(0.3)).alias("wavefront"),
        )
    )


@query(
    "SELECT p_partkey, round(2.0::DOUBLE / p_size, 6) AS first_power, round(-1.0::DOUBLE / p_size, 6) AS second_power, round((0.4::DOUBLE * p_size / 50 + 0.2::DOUBLE * p_retailprice / 1999 + 0.2::DOUBLE) / 0.8, 6) AS weighted, "
    "round(0.4::DOUBLE * greatest(0, 0.6::DOUBLE - p_size / 50.0::DOUBLE) + 0.2::DOUBLE * greatest(0, 0.6::DOUBLE - p_retailprice / 1999), 6) AS merit, glass, round((nd - 1) * p_size, 6) AS power "
    "FROM part JOIN (VALUES " + ", ".join(f"({k}, '{g}', {nd}::DOUBLE)" for k, (g, nd, *_) in enumerate(optics.GLASSES)) + ") t(k, glass, nd) ON p_partkey % 4 = k"
)
def lens_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Powers of a doublet, weighted score and merit of each part, its glass looked up in a table of four rows."""
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    three = lambda a, b, c: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in (a, b, c)])
    powers = optics.achromat_powers(size)
    names = F.array(*[F.lit(g[0]) for g in optics.GLASSES])
    parts = hosts.table(spark, sf_dir, "part").withColumn("glass", F.element_at(names, (F.col("p_partkey") % 4 + 1).cast("int"))).join(F.broadcast(optics.glasses(spark)), "glass")
    made = (size / 50, price / 1999, 1.0)
    return rounded(
        parts.select(
            "p_partkey", powers["first"].alias("first_power"), powers["second"].alias("second_power"), aggregate.weighted_score(three(*made), three(0.4, 0.2, 0.2)).alias("weighted"), optics.merit(three(0.4, 0.2, 0.2), three(*made), three(0.6, 0.6, 0.6)).alias("merit"),
            "glass", ((F.col("nd") - 1) * size).alias("power"),
        )
    )


@query(
    "WITH v AS (SELECT p_partkey, p_size / 40.0::DOUBLE - 0.613 AS a, p_retailprice / 37 AS b FROM part), x AS (SELECT *, greatest(-1.0, least(1.0, a + 0.1)) AS c, greatest(0.5, least(50.0, b)) AS t FROM v) "
    "SELECT p_partkey, round(c, 2) AS curvature, round(t, 2) AS thickness, round(greatest(0, 0.1 - (c - a)) + 0.3 * pow(t - b, 2) + 0.01 * (c + 1), 4) AS merit FROM x"
)
def merit_minimized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curvature and thickness within bounds that make a merit least: what is missing to a target, a distance squared and a small price of curvature."""
    parts = hosts.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 40.0 - 0.613).alias("a"), (F.col("p_retailprice") / 37).alias("b"))
    merit = lambda x, a, b: np.maximum(0.0, 0.1 - (x[0] - a)) + 0.3 * (x[1] - b) ** 2 + 0.01 * (x[0] + 1)
    numbers = lambda *values: [F.lit(v) for v in values]
    least = optics.minimized_batches(merit, numbers(0.0, 5.0), numbers(-1.0, 0.5), numbers(1.0, 50.0), [F.col("a"), F.col("b")], rounds=2, sections=44)
    found = optics.spread(parts).select("p_partkey", least.alias("m"))
    return found.select("p_partkey", F.round(F.col("m.x")[0], 2).alias("curvature"), F.round(F.col("m.x")[1], 2).alias("thickness"), F.round("m.value", 4).alias("merit"))


@query(f"WITH {hosts.RESULTS_SQL} SELECT model, round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 6) AS iqr, round(avg(score) - 1.96 * stddev_pop(score) / sqrt(count(*)), 6) AS ci_low, round(avg(score) + 1.96 * stddev_pop(score) / sqrt(count(*)), 6) AS ci_high FROM results GROUP BY model")
def score_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interquartile range, and the interval of 95 per cent around the mean."""
    s = aggregate.statistics(hosts.results(spark, sf_dir), "model")
    half = 1.96 * F.col("std_score") / F.sqrt("num_tasks")
    return rounded(s.select("model", (F.col("p75_score") - F.col("p25_score")).alias("iqr"), (F.col("mean_score") - half).alias("ci_low"), (F.col("mean_score") + half).alias("ci_high")))
