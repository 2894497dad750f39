"""Own scorers over batches: a function of two columns of texts, in pandas, with the rows that it fails on kept apart."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..model import ScorerConfig
from .scorers import SCORERS, _scored, judged

BatchScorer = Callable[[pd.Series, pd.Series], pd.DataFrame]


def isolated(f: BatchScorer, names: tuple[str, ...], predicted: pd.Series, expected: pd.Series) -> pd.DataFrame:
    """``f`` of a whole batch; if it fails, of each row by itself, so that only rows that it fails on are errors. A row without a score is one, too."""
    columns = ["success", "score", *names]

    def checked(p: pd.Series, e: pd.Series) -> pd.DataFrame:
        made = f(p, e)
        if len(made) != len(p):
            raise ValueError(f"{len(made)} rows for {len(p)}")
        out = made.reindex(columns=columns).reset_index(drop=True)
        out["error"] = out["score"].isna().map({True: "no score", False: None}).astype(object)
        return out

    try:
        return checked(predicted, expected)
    except Exception:
        parts = []
        for k in range(len(predicted)):
            try:
                parts.append(checked(predicted.iloc[k : k + 1], expected.iloc[k : k + 1]))
            except Exception as failed:
                parts.append(pd.DataFrame([[False, 0.0, *[None] * len(names), f"{type(failed).__name__}: {failed}"]], columns=[*columns, "error"]))
        return pd.concat(parts, ignore_index=True)


def batch_scorer(name: str, metrics: tuple[str, ...] = ()) -> Callable[[BatchScorer], BatchScorer]:
    """Register a scorer under a method name. It gets batches of ``predicted_output`` and ``expected_output`` (null texts as None) and returns as many rows: ``success``, ``score`` and the named ``metrics``.

    Batches travel by Arrow. With criteria configured, success is that all of them are met by the metrics; otherwise it is what the scorer says. A row that makes the scorer fail has score 0, no metrics and the failure as its error.
    """

    def register(f: BatchScorer) -> BatchScorer:
        schema = "success boolean, score double, " + "".join(f"m{k} double, " for k in range(len(metrics))) + "error string"

        def run(predicted: pd.Series, expected: pd.Series) -> pd.DataFrame:
            out = isolated(f, metrics, predicted, expected)
            out.columns = ["success", "score", *[f"m{k}" for k in range(len(metrics))], "error"]
            return out.astype({"score": float, **{f"m{k}": float for k in range(len(metrics))}})

        run.__annotations__ = {"predicted": pd.Series, "expected": pd.Series, "return": pd.DataFrame}
        udf = F.pandas_udf(run, schema)

        def scorer(df: DataFrame, config: ScorerConfig) -> DataFrame:
            read = df.withColumn("_made", udf(F.col("predicted_output").cast("string"), F.col("expected_output").cast("string")))
            values = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"_made.m{k}").alias("value")) for k, n in enumerate(metrics)])
            held = F.map_from_entries(F.filter(values, lambda x: x["value"].isNotNull() & ~F.isnan(x["value"]))) if metrics else F.create_map().cast("map<string,double>")
            read = read.withColumn("_metrics", held)
            met, _, status = judged(F.col("_metrics"), config.criteria)
            success = met if config.criteria else F.coalesce(F.col("_made.success"), F.lit(False))
            details = F.to_json(F.struct(status.alias("criteria_met")))
            done = _scored(read, success, F.col("_made.score"), details, F.col("_metrics"), F.col("_made.error"))
            return done.drop("_made", "_metrics")

        SCORERS[name] = scorer
        return f

    return register
