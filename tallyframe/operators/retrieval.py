"""Retrieval scorer: identifiers found against identifiers expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, variant as V
from ..model import ScorerConfig
from .scorers import SCORED, _scored, judged, parsed, scorer


#: How deep a list of papers may lie in objects that have only it as ``papers``.
DEPTH = 8


def _papers(root: Column) -> Column:
    """The list that is the value, or that lies in the ``papers`` of it, of these, and so on; null if there is none."""
    at, listed = root, F.try_variant_get(root, "$", "array<variant>")
    for _ in range(DEPTH):
        at = V.field(at, "papers")
        listed = F.coalesce(listed, F.try_variant_get(at, "$", "array<variant>"))
    return listed


def _named(e: Column) -> Column:
    """Identifier of a list's element, and whether it has none because its title is no text."""
    doi, title = V.field(e, "doi"), V.field(e, "title")
    by_doi = V.truthy(doi)
    name = F.when(V.is_object(e), F.when(by_doi, V.field(e, "doi", "string")).otherwise(F.lower(V.field(e, "title", "string")))).when(V.is_text(e), F.lower(F.try_variant_get(e, "$", "string")))
    return F.struct(name.alias("name"), (V.is_object(e) & F.when(by_doi, F.coalesce(V.kind(doi).rlike("^(ARRAY|OBJECT)"), F.lit(False))).otherwise(title.isNotNull() & ~V.is_text(title))).alias("bad"))


def named_papers(root: Column) -> Column:
    """A struct of ``ids``, the distinct identifiers in a JSON list or in the ``papers`` of a JSON object (nested up to DEPTH levels), and ``bad``, whether an object has no usable title.

    An object counts by its ``doi`` as written, without one by its title in lower case; a text by itself in lower case. Anything else has none. An object without ``doi`` whose
    title is null, a number or anything but a text is bad, as is a ``doi`` that is a list or an object; one without title has no identifier.
    """
    found = F.transform(F.coalesce(_papers(root), F.array().cast("array<variant>")), _named)
    ids = lambda named: F.array_distinct(F.filter(F.transform(named, lambda x: x["name"]), lambda x: x.isNotNull() & (x != "")))
    # transform over one element binds the names, so each element is read once
    return F.element_at(F.transform(F.array(found), lambda named: F.struct(ids(named).alias("ids"), F.exists(named, lambda x: F.coalesce(x["bad"], F.lit(False))).alias("bad"))), 1)


def identifiers(root: Column) -> Column:
    """The ``ids`` of ``named_papers``."""
    return named_papers(root)["ids"]


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two titles' token sets; 0 if one is empty."""
    return T.jaccard(F.array_distinct(T.tokens(a)), F.array_distinct(T.tokens(b)), both_empty=0.0)


def precision_recall(predicted: Column, expected: Column) -> tuple[Column, Column, Column, Column]:
    """Precision, recall, F-score and number right (null unless both have elements) of two sets; all 1 if both are empty."""
    right, p, e = F.size(F.array_intersect(predicted, expected)), F.size(predicted), F.size(expected)
    both = (p == 0) & (e == 0)
    values = [F.when(both, F.lit(1.0)).otherwise(v) for v in T.prf(right, p, e)]
    return values[0], values[1], values[2], F.when((p > 0) & (e > 0), right)


def citation_accuracy(predicted: Column, expected: Column, threshold: float = 0.8) -> Column:
    """Exact hits, and half a hit for each other prediction with a similar title among the other expected ones, over the number expected.

    One expected title may serve several predictions, so this can exceed 1. With nothing expected, 1 if nothing was predicted, else 0.
    """
    words = lambda titles: F.transform(titles, lambda t: F.array_distinct(T.tokens(t)))
    # transform over one element binds the word lists, so each title is split once; lists too different in size are not compared
    both = F.array(F.struct(words(F.array_except(predicted, expected)).alias("extra"), words(F.array_except(expected, predicted)).alias("missed")))
    may = lambda x, y: (F.size(x) > threshold * F.size(y)) & (F.size(y) > threshold * F.size(x))
    close = F.element_at(F.transform(both, lambda b: F.size(F.filter(b["extra"], lambda x: F.exists(b["missed"], lambda y: may(x, y) & (T.jaccard(x, y, both_empty=0.0) > threshold))))), 1)
    hits = F.size(F.array_intersect(predicted, expected)) + 0.5 * close
    return F.when(F.size(expected) == 0, (F.size(predicted) == 0).cast("double")).otherwise(hits / F.greatest(F.size(expected), F.lit(1)))


def retrieval_columns(df: DataFrame, predicted: str, expected: str) -> DataFrame:
    """Add the retrieval metrics of two arrays of identifiers."""
    p, r, f, right = precision_recall(F.col(predicted), F.col(expected))
    accuracy = citation_accuracy(F.col(predicted), F.col(expected))
    return df.withColumns({"precision": p, "recall": r, "f1": f, "num_correct": right, "citation_accuracy": accuracy}).withColumn("composite_score", 0.3 * F.col("recall") + 0.3 * F.col("precision") + 0.4 * F.col("citation_accuracy"))


@scorer("citation")
@scorer("retrieval")
def citation(df: DataFrame, config: ScorerConfig) -> DataFrame:
    """Recall, precision and citation accuracy weighted 0.3, 0.3 and 0.4, held against the criteria.

    Malformed JSON on either side, and a title that is no text, make the row an error with score 0; an absent side has no papers.
    """
    read = parsed(df)
    bad = lambda text, value: F.col(text).isNotNull() & F.col(value).isNull()
    read = read.withColumns({"_np": named_papers(F.col("_a")), "_ne": named_papers(F.col("_b"))})
    error = F.when(bad("predicted_output", "_a") | bad("expected_output", "_b"), F.lit("invalid JSON")).when(F.col("_np.bad") | F.col("_ne.bad"), F.lit("invalid title"))
    read = read.withColumns({"_p": F.col("_np.ids"), "_e": F.col("_ne.ids"), "_error": error})
    read = retrieval_columns(read.drop("_a", "_b", "_np", "_ne"), "_p", "_e")
    names = ("precision", "recall", "f1", "citation_accuracy", "composite_score")
    read = read.withColumn("_metrics", F.create_map(*[x for k in names for x in (F.lit(k), F.col(k))]))
    success, _, status = judged(F.col("_metrics"), config.criteria)
    details = F.to_json(F.struct(F.size("_p").alias("num_predicted"), F.size("_e").alias("num_expected"), F.array_intersect("_p", "_e").alias("correct_papers"), status.alias("criteria_met")))
    return _scored(read, success, F.col("composite_score"), details, F.col("_metrics"), F.col("_error")).select(*df.columns, *SCORED)
