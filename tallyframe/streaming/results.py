"""Result rows as a stream: scored as they arrive, appended once, aggregated as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import SAVED_RESULT, ScorerConfig
from ..operators import scorers


def read_results(spark: SparkSession, path: str, schema: str = SAVED_RESULT + ", model string, finished timestamp") -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def score_stream(answers: DataFrame, config: ScorerConfig) -> DataFrame:
    """The batch scorers work on streams as they are: they are columns only."""
    return scorers.score(answers, config)


def append_results(results: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Append each row once, whatever restarts happen: the checkpoint holds what has been written."""
    return results.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("json").start(output)


def windowed_totals(results: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Totals for each model and window of finishing time.

    The watermark is the latest time of all rows so far less ``late``. A window that ends at or before it is final: in append mode it is emitted then, once, its state goes, and rows for it that come after are dropped. A
    late row whose window is still open counts.
    """
    timed = results.withWatermark("finished", late)
    return timed.groupBy(F.window("finished", window), "model").agg(F.count("*").alias("total_tasks"), F.count_if("success").alias("successful_tasks"), F.avg("score").alias("avg_score"), F.sum("cost").alias("total_cost"))


def append_windows(results: DataFrame, output: str, checkpoint: str, window: str = "5 minutes", late: str = "10 minutes") -> StreamingQuery:
    """Final windows appended to ``output`` as Parquet: ``start``, ``end``, the model and totals. State, watermark and what has been written are in the checkpoint, so a restart goes on where the stream stopped."""
    totals = windowed_totals(results, window, late).select("window.start", "window.end", "model", "total_tasks", "successful_tasks", "avg_score", "total_cost")
    return totals.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", output).start()


def running_totals(results: DataFrame) -> DataFrame:
    """Totals for each model over all rows so far, for update or complete mode."""
    return results.groupBy("model").agg(F.count("*").alias("total_tasks"), F.count_if("success").alias("successful_tasks"), F.sum("score").alias("sum_score"), F.sum("cost").alias("total_cost"))
