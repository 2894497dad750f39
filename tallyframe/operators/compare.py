"""Two-sample comparison of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.stats import normal_cdf


def compare_models(df: DataFrame, by: str = "model", alpha: float = 0.05) -> DataFrame:
    """Every two models: means, their difference, t by population variances, two-sided normal p, significance, winner.

    Equal means go to b. Without variance t is 0 and p is 1. The self-join is of one row a model.
    """
    each = df.groupBy(by).agg(F.avg("score").alias("mean"), F.var_pop("score").alias("var"), F.count("score").alias("n"))
    a, b = (each.select(*[F.col(c).alias(f"{c}_{s}") for c in each.columns]) for s in "ab")
    pairs = a.join(b, F.col(f"{by}_a") < F.col(f"{by}_b"))
    error = F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))
    t = pairs.withColumn("difference", F.col("mean_a") - F.col("mean_b")).withColumn("t_statistic", F.when(error > 0, F.col("difference") / error).otherwise(F.lit(0.0)))
    p = t.withColumn("p_value", F.when(error > 0, 2 * (1 - normal_cdf(F.abs("t_statistic")))).otherwise(F.lit(1.0)))
    return p.select(F.col(f"{by}_a").alias("model_a"), F.col(f"{by}_b").alias("model_b"), "mean_a", "mean_b", "difference", "t_statistic", "p_value", (F.col("p_value") < alpha).alias("significant"), F.when(F.col("mean_a") > F.col("mean_b"), "A").otherwise("B").alias("winner"))
