"""Checks of result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.errors import classify


def rules() -> list[tuple[int, str, Column]]:
    """Number, text and condition of each row check."""
    time, cost, value = F.col("execution_time"), F.col("cost"), F.col("score")
    return [
        (1, "missing task_id", F.coalesce(F.col("task_id"), F.lit("")) == ""),
        (2, "negative execution time", time < 0),
        (3, "negative cost", cost < 0),
        (4, "score out of range", ~F.isnan(value) & ((value < 0) | (value > 1))),
        (5, "score not finite", F.isnan(value) | (F.abs(value) == float("inf"))),
    ]


def issues(df: DataFrame, row: str) -> DataFrame:
    """One row for each failed check: row, number and text. One pass over the table."""
    made = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(n).alias("rule"), F.lit(text).alias("issue"))) for n, text, hit in rules()]))
    return df.select(F.col(row), F.explode(made).alias("x")).select(row, "x.rule", "x.issue")


def latency_outliers(df: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Number of rows whose time is over ``sigmas`` deviations from the mean; mean and deviation are over times of 0 or more."""
    sane = F.when(F.col("execution_time") >= 0, F.col("execution_time"))
    around = df.agg(F.avg(sane).alias("mean"), F.stddev_pop(sane).alias("std"))
    far = F.count_if(F.abs(F.col("execution_time") - F.col("mean")) > sigmas * F.col("std"))
    return df.select("execution_time").join(F.broadcast(around)).groupBy("mean", "std").agg(far.alias("outliers")).where("mean is not null")  # one row on that side


def validate(df: DataFrame, row: str, most: int = 1000) -> DataFrame:
    """One row: ``valid``, ``n_issues`` and the first ``most`` issues in order of row and rule, that of outliers last.

    All rows are checked and counted; the list is a report and as long as ``most`` says. ``issues`` gives all of them, distributed.
    """
    every = issues(df, row)
    counted = every.agg(F.count("*").alias("n"))
    listed = every.orderBy(row, "rule").limit(most).agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("row"), "rule", "issue"))).alias("found"))
    far = latency_outliers(df).agg(F.coalesce(F.sum("outliers"), F.lit(0)).alias("outliers"))
    texts = F.transform("found", lambda x: F.concat(F.lit("row "), x["row"].cast("string"), F.lit(": "), x["issue"]))
    more = F.when(F.col("outliers") > 0, F.array(F.concat(F.col("outliers").cast("string"), F.lit(" latency outliers")))).otherwise(F.array().cast("array<string>"))
    # three tables of one row
    n = F.col("n") + (F.col("outliers") > 0).cast("long")
    return counted.join(listed).join(far).select((n == 0).alias("valid"), n.alias("n_issues"), F.concat(texts, more).alias("issues"))


def error_details(df: DataFrame, order: str) -> DataFrame:
    """Failed rows with a message: id, message, class, score and time, slowest first, equal ones in input order."""
    failed = df.where(~F.col("success") & (F.coalesce("error", F.lit("")) != ""))
    return failed.select("task_id", "error", classify(F.col("error"), F.col("score")).alias("category"), "score", "execution_time", order).orderBy(F.desc("execution_time"), order)


