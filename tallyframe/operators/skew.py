"""Joins of many rows with a table of keys, whatever share of the rows a key has."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key of more than one in so many rows is hot: there are fewer such keys than this.
HOT_SHARE = 10_000


def hot_join(rows: DataFrame, keyed: DataFrame, key: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) with ``keyed``: one row a key, whose column ``count`` tells how many rows have it.

    Rows with a hot key, one of more than one in HOT_SHARE of ``total`` rows, stay where they are and meet a broadcast table of
    these keys; all other rows are shuffled by key. ``count`` is not returned. If there are more rows than ``total`` says, so much more is broadcast.
    """
    hot = F.col(count) * HOT_SHARE > total
    known = F.broadcast(keyed.where(hot).drop(count))
    rest = rows.join(F.broadcast(keyed.where(hot).select(*key)), key, "left_anti").join(keyed.where(~hot).drop(count), key, how)
    return rows.join(known, key).unionByName(rest)
