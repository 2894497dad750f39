"""The driver's tables in the shapes that the operators take, with the same views as SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.shared import new_folder

MESSAGES = ("Request timed out", "API rate limit reached", "Invalid JSON in answer", "Quality threshold missed", "Unknown failure")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results_of(table(spark, sf_dir, "events"))


def results_of(e: DataFrame) -> DataFrame:
    """Events as result rows of five models; six kinds of errors, the sixth without message."""
    k = F.get_json_object("props", "$.k").cast("int")
    turn = F.pmod(F.floor(F.col("event_id") / 5), F.lit(6))
    message: Column = F.lit(None).cast("string")
    for n, text in enumerate(MESSAGES):
        message = F.when(turn == n, F.lit(text)).otherwise(message)
    failed = F.col("event_type") == "error"
    return e.select(
        "event_id", F.concat(F.lit("task_"), F.col("user_id"), F.lit("_"), F.col("event_id") % 30).alias("task_id"), F.concat(F.lit("m"), F.col("event_id") % 5).alias("model"), k.alias("k"),
        (k / 100.0).cast("double").alias("score"), F.col("value").alias("execution_time"), (k / 10000.0).cast("double").alias("cost"), (~failed & (k >= 50)).alias("success"), F.when(failed, message).alias("error"),
        F.create_map(F.lit("k"), k.cast("double"), F.lit("value"), F.col("value")).alias("metrics"),
    )


RESULTS_SQL = (
    "results AS (SELECT event_id, 'task_' || user_id || '_' || (event_id % 30) AS task_id, 'm' || (event_id % 5) AS model, CAST(json_extract_string(props, '$.k') AS INT) AS k, "
    "CAST(CAST(json_extract_string(props, '$.k') AS INT) AS DOUBLE) / 100 AS score, value AS execution_time, CAST(CAST(json_extract_string(props, '$.k') AS INT) AS DOUBLE) / 10000 AS cost, "
    "event_type <> 'error' AND CAST(json_extract_string(props, '$.k') AS INT) >= 50 AS success, "
    "CASE WHEN event_type = 'error' THEN CASE (event_id // 5) % 6 " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(MESSAGES)) + " END END AS error FROM events)"
)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers in JSON, one in 97 of them cut off, one in 89 with prose behind."""
    e = table(spark, sf_dir, "events")
    body = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "flag": '), F.when(F.col("event_id") % 3 == 0, "true").otherwise("false"), F.when(F.col("event_id") % 97 == 0, "").otherwise("}"), F.when(F.col("event_id") % 89 == 0, " and then prose").otherwise(""))
    return e.select("event_id", F.col("event_id").cast("string").alias("task_id"), body.alias("predicted_output"), F.lit(None).cast("string").alias("expected_output"))


ANSWERS_SQL = "answers AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_id % 3 = 0 AS flag, event_id % 97 = 0 OR event_id % 89 = 0 AS broken FROM events)"


#: Tasks of a suite as they are configured: by metrics, by equality and by similarity.
SUITE = (
    {"task": {"id": "t0"}, "evaluation": {"metrics": [{"name": "k"}], "success_criteria": [{"metric": "k", "operator": ">=", "value": 50}]}},
    {"task": {"id": "t1"}, "evaluation": {"metrics": [{"name": "k"}, {"name": "flag", "type": "binary"}], "success_criteria": [{"metric": "k", "operator": ">", "value": 30}, {"metric": "flag", "operator": "==", "value": True}]}},
    {"task": {"id": "t2"}, "evaluation": {"metrics": [{"name": "absent"}, {"name": "k"}], "success_criteria": [{"metric": "absent", "operator": "<=", "value": 1}, {"metric": "k", "operator": "<", "value": 80}, {"metric": "k", "operator": "!=", "value": 7}]}},
    {"task": {"id": "t3"}, "evaluation": {"scoring_method": "exact_match"}},
    {"task": {"id": "t4"}, "evaluation": {"scoring_method": "partial_match", "threshold": 0.5}},
    {"task": {"id": "t5"}, "evaluation": {"scoring_method": "partial_match"}},
    {"task": {"id": "t6"}, "evaluation": {"metrics": [{"name": "opinion", "type": "llm_judge"}]}},
)


def suite_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as tasks of seven kinds (some of a kind that is not configured) and as their answers; one in 31 has none."""
    n = F.col("event_id")
    task = F.when((n % 7 == 6) & (n % 5 == 0), F.lit("t9")).otherwise(F.concat(F.lit("t"), n % 7))
    flag = F.when(n % 3 == 0, "true").otherwise("false")
    k = F.get_json_object("props", "$.k").cast("int")
    wanted = F.concat(F.lit('{"flag": '), flag, F.lit(', "k": '), (k + F.when(n % 4 < 2, 0).otherwise(1)).cast("string"), F.lit("}"))
    tasks = table(spark, sf_dir, "events").select(task.alias("task"), n.cast("string").alias("task_id"), F.when((n % 7).isin(3, 4, 5), wanted).otherwise(F.lit("")).alias("expected_output"))
    own = answers(spark, sf_dir).where(n % 31 != 0).select(task.alias("task"), "task_id", "predicted_output")
    return tasks, own


SUITE_SQL = (
    "asked AS (SELECT event_id, event_id % 7 AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id % 3 = 0 AS flag, event_id % 31 = 0 AS none, event_id % 97 = 0 OR event_id % 89 = 0 AS broken, event_id % 4 < 2 AS same, event_id % 7 = 6 AND event_id % 5 = 0 AS unknown FROM events), "
    "judged AS (SELECT *, CASE t WHEN 0 THEN CAST(k >= 50 AS INT) WHEN 1 THEN (CAST(k > 30 AS INT) + CAST(flag AS INT)) / 2.0 WHEN 2 THEN (1 + CAST(k < 80 AS INT) + CAST(k <> 7 AS INT)) / 3.0 WHEN 3 THEN CAST(same AS INT) WHEN 6 THEN 1 ELSE (1 + CAST(same AS INT)) / 2.0 END::DOUBLE AS share, "
    "t IN (0, 1, 2, 6) AS by_metrics FROM asked), "
    "suite AS (SELECT CASE WHEN unknown THEN 't9' ELSE 't' || t END AS task, CAST(event_id AS VARCHAR) AS task_id, k, unknown, none, NOT (unknown OR none OR broken) AS sound, by_metrics, CASE WHEN unknown OR none OR broken THEN 0.0 ELSE share END AS score, "
    "NOT (unknown OR none OR broken) AND (share = 1 OR (t = 4 AND share >= 0.5)) AS success, CASE WHEN unknown THEN 'no such task' WHEN none THEN 'no answer' WHEN broken AND by_metrics THEN 'invalid JSON' END AS error FROM judged)"
)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")  # a pattern, as a stream starts from folders


def late_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Results in four batches of about eight days; one in 50 comes with the last batch whatever its time, one in 50 with the next one."""
    e = table(spark, sf_dir, "events")
    n, own = F.col("event_id"), F.floor((F.dayofmonth("ts") - 1) / 8).cast("int")
    batch = F.when(n % 50 == 0, F.lit(3)).when(n % 50 == 25, F.least(own + 1, F.lit(3))).otherwise(own)
    # the table's times have no zone; they are read as UTC, whatever the session's is
    at = F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp")
    timed = results_of(e).join(e.select("event_id", at.alias("finished"), batch.alias("batch")), "event_id")
    return [timed.where(F.col("batch") == b).select("task_id", "model", "success", "score", "cost", "finished") for b in range(4)]


LATE_SQL = (
    RESULTS_SQL + ", timed AS (SELECT r.*, ts, CASE WHEN r.event_id % 50 = 0 THEN 3 WHEN r.event_id % 50 = 25 THEN least((day(ts) - 1) // 8 + 1, 3) ELSE (day(ts) - 1) // 8 END AS batch FROM results r JOIN events e ON r.event_id = e.event_id), "
    "ends AS (SELECT batch, max(ts) AS latest FROM timed GROUP BY batch), marks AS (SELECT batch, max(latest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 12 HOURS AS mark FROM ends), "
    "placed AS (SELECT *, time_bucket(INTERVAL 6 HOURS, ts) AS start FROM timed JOIN marks USING (batch)), "
    "kept AS (SELECT * FROM placed WHERE mark IS NULL OR start + INTERVAL 6 HOURS > mark), last AS (SELECT max(ts) - INTERVAL 12 HOURS AS mark FROM events)"
)


def task_lines(spark: SparkSession, sf_dir: str, ordered: bool = False) -> str:
    """A folder with a line of JSON for each event: blank ones, such that are cut off and such with text behind among them. Ordered, the files in the order of their names hold the events in the order of their ids."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    body = F.concat(F.lit('{"task_id": "e'), n.cast("string"), F.lit('", "question": "'), F.col("event_type"), F.lit('?", "want": {"k": '), F.get_json_object("props", "$.k"), F.lit('}, "level": '), (n % 4).cast("string"))
    line = F.when(n % 11 == 0, F.lit("  ")).when(n % 13 == 0, body).when(n % 17 == 0, F.concat(body, F.lit("} trailing"))).when(n % 19 == 0, F.concat(body, F.lit(', "more": [1, 2]}'))).otherwise(F.concat(body, F.lit("}")))
    path = new_folder(spark, "task-lines")
    (e.orderBy("event_id") if ordered else e).select(line.alias("value")).write.text(path)
    return path


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn as answer and the assistant's next as reference. The window is within one conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    return c.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("predicted_output"), F.col("next_text").alias("expected_output"))


PAIRS_SQL = (
    "pairs AS (SELECT conv_id, turn, text AS predicted_output, next_text AS expected_output FROM (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations "
    "WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"
)


#: Pairs of texts with odd JSON: whether they are equal, and shared and all members or words. Text behind a JSON value makes it a plain text; 1, 1.0, 1e0 and true are one value.
ODD_PAIRS = (
    ("5 apples", "5 pears", False, 1, 3), ("true story", "true lies", False, 1, 3), ("[1] ref", "[1] other", False, 1, 3), ("3.5 mm", "3.5 cm", False, 1, 3), ("null hypothesis", "null result", False, 1, 3),
    ("true", "1", True, 1, 1), ("100", "1e2", True, 1, 1), ("[false, 2.50]", "[0, 25e-1]", True, 1, 1), ('"1"', "1", False, 0, 1), ('{"a": "1.0"}', '{"a": "1"}', False, 0, 1),
    ('{"a": 1e2, "b": false}', '{"a": 100, "b": 0.0}', True, 1, 1), ('{"a": 1, "b": 2}', '{"a": true, "c": 3}', False, 1, 3), ('{"a": 1} end', '{"a": 1} end', True, 1, 1), ('{"a": 1}', "[1]", False, 0, 1),
)


def odd_pairs(spark: SparkSession) -> DataFrame:
    rows = [(-1, k, *p[:2]) for k, p in enumerate(ODD_PAIRS)]
    return spark.createDataFrame(rows, "conv_id long, turn long, predicted_output string, expected_output string")


ODD_SQL = "odd AS (SELECT * FROM (VALUES " + ", ".join(f"(-1, {k}, {equal}, {a}, {b})" for k, (_, _, equal, a, b) in enumerate(ODD_PAIRS)) + ") t(conv_id, turn, equal, shared, every))"


def half_the_length(predicted: pd.Series, expected: pd.Series) -> pd.DataFrame:
    """A scorer over batches: the shorter length over the longer one. It fails for answers whose length is a multiple of seven."""
    p, e = predicted.str.len(), expected.str.len()
    if ((p % 7) == 0).any():
        raise ValueError("seven")
    ratio = np.minimum(p, e) / np.maximum(np.maximum(p, e), 1)
    return pd.DataFrame({"success": ratio >= 0.5, "score": ratio, "longer": np.maximum(p, e)})


#: A prompt with blocks of all kinds, for orders.
PROMPT = """# Order {{o_orderkey}}
{{#if urgent}}
URGENT{{#if finished}} and finished{{/if}}
{{else}}
No hurry
{{/if}}
{{#each items}}
{{add @index 1}}. part {{this.part}} x {{this.quantity}}{{#if this.back}} (back){{else}}{{#if urgent}} (soon){{/if}}{{/if}}
{{/each}}
{{absent}}End
"""


def orders_with_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("quantity"), (F.col("l_returnflag") == "R").alias("back"))
    items = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select("o_orderkey", (F.col("o_orderpriority").startswith("1")).alias("urgent"), F.when(F.col("o_orderstatus") == "F", F.lit("yes")).alias("finished"), "items")


def orders_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two JSON objects an order: its members against those of the order with the next key."""
    o = table(spark, sf_dir, "orders")
    n = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.col("o_custkey").alias("c"))
    member = lambda name, c: F.concat(F.lit(f'"{name}": "'), c.cast("string"), F.lit('"'))
    left = F.concat_ws(", ", member("status", F.col("o_orderstatus")), member("priority", F.col("o_orderpriority")), member("half", F.col("o_custkey") % 2))
    right = F.concat_ws(", ", member("status", F.col("s")), member("priority", F.col("p")), F.when(F.col("c") % 3 == 0, F.lit('"half": null')).otherwise(member("third", F.col("c") % 3)))
    whole = lambda c: F.concat(F.lit("{"), c, F.lit("}"))
    return o.join(n, F.col("o_orderkey") + 1 == F.col("k")).select("o_orderkey", whole(left).alias("predicted_output"), whole(right).alias("expected_output"))


#: Members: status, priority, half (null counts as absent but is a name), third.
ORDERS_SQL = "pairs AS (SELECT o.o_orderkey, o.o_orderstatus = n.o_orderstatus AS s, o.o_orderpriority = n.o_orderpriority AS p, n.o_custkey % 3 <> 0 AS third FROM orders o JOIN orders n ON o.o_orderkey + 1 = n.o_orderkey)"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each brand and size: descriptions of all parts as expected titles; predicted are the same, those without their last word, or others."""
    start = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type", F.lit("size"), F.col("p_size").cast("string"), F.lit("no")))
    title = F.concat(start, F.lit(" "), F.col("p_partkey").cast("string"))
    other = F.concat(F.lit("other"), F.col("p_partkey").cast("string"))
    predicted = F.when(F.col("p_partkey") % 3 == 0, title).when(F.col("p_partkey") % 3 == 1, start).otherwise(other)
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.collect_set(predicted).alias("predicted"), F.collect_set(title).alias("expected"))


TITLES_SQL = (
    "named AS (SELECT p_brand, p_size, p_partkey, lower(p_name || ' ' || p_brand || ' ' || p_type || ' size ' || p_size || ' no') AS start FROM part), "
    "titles AS (SELECT p_brand, p_size, start || ' ' || p_partkey AS expected, CASE p_partkey % 3 WHEN 0 THEN start || ' ' || p_partkey WHEN 1 THEN start ELSE 'other' || p_partkey END AS predicted FROM named), "
    "lists AS (SELECT p_brand, p_size, list_distinct(list(predicted)) AS predicted, list_distinct(list(expected)) AS expected FROM titles GROUP BY ALL)"
)


#: Lists of papers in odd JSON: predicted, expected, and recall, precision and citation accuracy, none where a title is no text.
ODD_PAPERS = (
    ('{"papers": {"papers": ["A"]}}', '["a"]', 1, 1, 1), ('{"papers": {"papers": {"papers": ["A", "b"]}}}', '{"papers": ["b"]}', 1, 0.5, 1), ('[{"title": 5}]', '["5"]', None, None, None), ('["x"]', '[{"title": null}]', None, None, None),
    ('[{"title": "A"}, {}]', '["a"]', 1, 1, 1), ('[{"doi": "D", "title": 5}]', '["D"]', 0, 0, 0.5), ('[{"doi": "", "title": "T"}]', '["t"]', 1, 1, 1), ('[{"doi": 0, "title": "T"}]', '["t"]', 1, 1, 1), ('[7, null, [1], "q"]', '["q"]', 1, 1, 1), ('[{"doi": ["D"]}]', '["D"]', None, None, None),
    ('{"papers": "x"}', "[]", 1, 1, 1), ('{"other": ["x"]}', '["x"]', 0, 0, 0),
)


def odd_papers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("odd", k, *p[:2]) for k, p in enumerate(ODD_PAPERS)], "p_brand string, p_size int, predicted_output string, expected_output string")


ODD_PAPERS_SQL = "odd AS (SELECT * FROM (VALUES " + ", ".join(f"('odd', {k}, {', '.join('NULL' if x is None else f'{x}::DOUBLE' for x in n)})" for k, (_, _, *n) in enumerate(ODD_PAPERS)) + ") t(p_brand, p_size, r, p, a))"


def title_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same titles as rows of two tables: predicted and expected ones, some of them twice."""
    start = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type", F.lit("size"), F.col("p_size").cast("string"), F.lit("no")))
    title = F.concat(start, F.lit(" "), F.col("p_partkey").cast("string"))
    part = table(spark, sf_dir, "part")
    predicted = F.when(F.col("p_partkey") % 3 == 0, title).when(F.col("p_partkey") % 3 == 1, start).otherwise(F.concat(F.lit("other"), F.col("p_partkey").cast("string")))
    return part.select("p_brand", "p_size", predicted.alias("title")), part.select("p_brand", "p_size", F.explode(F.array(title, title)).alias("title"))


def cut_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns without their first word, and the turns themselves."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return turns.select(F.regexp_replace("text", r"^\S+\s+", "").alias("text")), turns.select("text")


def carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's distinct part names on finished orders as predicted, on open ones as expected."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    named = lambda s: F.coalesce(F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("p_name"))), F.array().cast("array<string>"))
    return joined.groupBy("o_custkey").agg(named("F").alias("predicted"), named("O").alias("expected"))


CARTS_SQL = (
    "carts AS (SELECT o_custkey, coalesce(list(DISTINCT p_name) FILTER (o_orderstatus = 'F'), []) AS predicted, coalesce(list(DISTINCT p_name) FILTER (o_orderstatus = 'O'), []) AS expected "
    "FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey)"
)


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows with faults put in."""
    n = F.col("event_id")
    return results(spark, sf_dir).select(
        "event_id", F.when(n % 101 == 0, F.lit(None)).when(n % 103 == 0, F.lit("")).otherwise(F.col("task_id")).alias("task_id"), F.when(n % 107 == 0, -F.col("execution_time") - 1).otherwise(F.col("execution_time")).alias("execution_time"),
        F.when(n % 109 == 0, -F.col("cost") - 1).otherwise(F.col("cost")).alias("cost"), F.when(n % 113 == 0, F.lit(1.5)).when(n % 127 == 0, F.lit(float("nan"))).when(n % 131 == 0, F.lit(float("inf"))).otherwise(F.col("score")).alias("score"),
    )


FAULTY_SQL = (
    RESULTS_SQL + ", faulty AS (SELECT event_id, CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 103 = 0 THEN '' ELSE task_id END AS task_id, CASE WHEN event_id % 107 = 0 THEN -execution_time - 1 ELSE execution_time END AS execution_time, "
    "CASE WHEN event_id % 109 = 0 THEN -cost - 1 ELSE cost END AS cost, CASE WHEN event_id % 113 = 0 THEN 1.5 WHEN event_id % 127 = 0 THEN 'nan'::DOUBLE WHEN event_id % 131 = 0 THEN 'inf'::DOUBLE ELSE score END AS score FROM results)"
)


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as a text export: a heading, three numbers a line, broken lines between."""
    line = F.when(F.col("l_linenumber") == 2, F.concat(F.lit("n/a "), F.col("l_quantity").cast("int").cast("string"), F.lit(" 1"))).otherwise(F.concat_ws(" ", F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")))
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("Freq Tan Sag\n"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n")).alias("text"))


EXPORTS_SQL = (
    "exports AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q, l_linenumber = 2 AS broken, "
    "CASE WHEN l_linenumber = 2 THEN 'n/a ' || CAST(l_quantity AS INT) || ' 1' ELSE CAST(l_quantity AS INT) || ' ' || l_linenumber || ' ' || l_suppkey END AS line FROM lineitem)"
)
