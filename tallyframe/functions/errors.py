"""Classes of errors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Classes in the order in which they are tried, with the parts of a message that tell them.
RULES = (("timeout", ("timeout", "timed out")), ("api_error", ("api", "rate limit")), ("invalid_output", ("invalid", "parse")), ("quality_below_threshold", ("quality", "threshold")))
CATEGORIES = ("success", "timeout", "api_error", "invalid_output", "quality_below_threshold", "other")


def classify(error: Column, score: Column) -> Column:
    """Class of a failed row: by its message, without one by whether the score is below one half."""
    low = F.lower(error)
    by_text = F.lit("other")
    for name, parts in reversed(RULES):
        hit = F.lit(False)
        for part in parts:
            hit = hit | low.contains(part)
        by_text = F.when(hit, F.lit(name)).otherwise(by_text)
    silent = error.isNull() | (error == "")
    return F.when(silent, F.when(score < 0.5, F.lit("quality_below_threshold")).otherwise(F.lit("other"))).otherwise(by_text)


def category(success: Column, error: Column, score: Column) -> Column:
    return F.when(success, F.lit("success")).otherwise(classify(error, score))
