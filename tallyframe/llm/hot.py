"""Joins of many rows with a table of keys, whatever share of the rows a key has."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import written

#: A key of more than one in HOT_SHARE rows, and of more than FEW_ROWS, is hot: there are fewer such keys than HOT_SHARE.
HOT_SHARE, FEW_ROWS = 10_000, 2_000


def hot_join(rows: DataFrame, keyed: DataFrame, key: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) with ``keyed``: one row a key, whose column ``count`` tells how many rows have it.

    Rows with a hot key stay where they are and meet a broadcast table of these keys; all other rows are shuffled by key, all of them if no key is
    hot. ``keyed`` is written first unless it has been. ``count`` is not returned. If there are more rows than ``total`` says, so much more is broadcast.
    """
    keyed = keyed if getattr(keyed, "_tf_path", None) else written(keyed, "hot-keys")
    hot = (F.col(count) * HOT_SHARE > total) & (F.col(count) > FEW_ROWS)
    some = keyed.where(hot).drop(count)
    if some.isEmpty():
        return rows.join(keyed.drop(count), key, how)
    rest = rows.join(F.broadcast(some.select(*key)), key, "left_anti").join(keyed.where(~hot).drop(count), key, how)
    return rows.join(F.broadcast(some), key).unionByName(rest)
