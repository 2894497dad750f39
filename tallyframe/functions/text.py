"""Tokens, n-grams and similarities of texts, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import IntegerType

#: What Unicode counts as white space, as a Java character class.
WHITE = r"[\s\x0B\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def tokens(text: Column) -> Column:
    """Lower-cased words between white space; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WHITE), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by U+0001; empty if there are fewer words."""
    if n == 1:
        return words
    made = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), "\x01"))
    return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<string>"))


def ratio(over: Column, under: Column) -> Column:
    """over / under, 0 where under is 0."""
    return F.when(under == 0, F.lit(0.0)).otherwise(over.cast("double") / under)


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Shared over all distinct elements; ``both_empty`` if neither array has any, 0 if one has none."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both_empty)).otherwise(ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))))


def numbered(ordered: Column) -> Column:
    """Elements of a sorted array of strings, each with how often it has come so far: a multiset as a set."""
    n = F.size(ordered)
    # places (from 0) where an element differs from the one before, and the end
    starts = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get(ordered, i) != F.get(ordered, i - 1)))
    runs = F.zip_with(F.slice(starts, 1, F.size(starts) - 1), F.slice(starts, 2, F.size(starts)), lambda a, b: F.transform(F.sequence(F.lit(1), b - a), lambda k: F.concat(F.get(ordered, a), F.lit("\x02"), k.cast("string"))))
    return F.when(n > 0, F.flatten(runs)).otherwise(F.array().cast("array<string>"))


def prf(shared: Column, predicted: Column, reference: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F-score."""
    p, r = ratio(shared, predicted), ratio(shared, reference)
    return p, r, F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two word lists, a row of the table at a time as the bits of one integer."""
    where: dict[str, int] = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        hit = row & where.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x.split("\x01") if x else [], y.split("\x01") if y else []) for x, y in zip(a, b, strict=True)], dtype="int32")


def lcs(a: Column | str, b: Column | str) -> Column:
    """``lcs_length`` of two word arrays: Arrow batches, linear in words times words / 64. Words go as one text, which costs less than a list."""
    return _lcs(F.array_join(a, "\x01"), F.array_join(b, "\x01"))


def lcs_native(a: Column, b: Column) -> Column:
    """The same with higher-order functions only; quadratic, for short texts and as a cross-check."""
    zero = F.transform(F.concat(F.array(F.lit("")), b), lambda _: F.lit(0))

    def add_row(row: Column, word: Column) -> Column:
        cells = F.zip_with(F.sequence(F.lit(1), F.size(b)), b, lambda j, w: F.struct(j.alias("j"), (w == word).alias("same")))
        start = F.array(F.lit(0))
        return F.aggregate(cells, start, lambda new, c: F.concat(new, F.array(F.greatest(F.element_at(new, -1), F.get(row, c["j"]), F.when(c["same"], F.get(row, c["j"] - 1) + 1).otherwise(0)))))

    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(F.element_at(F.aggregate(a, zero, add_row), -1))
