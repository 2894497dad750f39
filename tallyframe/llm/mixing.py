"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordering import with_position
from .scratch import written
from .text import whole, word_count


def source_targets(sizes: DataFrame, max_copies: int = 3, cycle: int = 3) -> DataFrame:
    """Targets from a table ``source, source_size`` with one row a source.

    Sources by code point, null last, weigh 1 to ``cycle`` in turn and share all
    of the sizes by weight; what would exceed ``max_copies`` times a source's size is
    shared by weight among the others until none exceeds it. Closed form: with the
    sources in order of limit per weight, a source is at its limit if the share a
    unit of weight would get after filling all before it reaches the source's limit.
    """
    ranked = sizes.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1)
    ranked = ranked.withColumn("limit", F.lit(max_copies) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    filled = ranked.select("*", left.alias("left"), F.sum("weight").over(after).alias("weights"))
    filled = filled.withColumn("level", F.when(F.col("limit") * F.col("weights") > F.col("left") * F.col("weight"), F.col("left") / F.col("weights")))
    # the first level found holds: beyond it more than a fair share is subtracted, so later ones are lower
    return filled.withColumn("level", F.max("level").over(every)).select("source", "source_size", F.when(F.col("level").isNull(), F.col("limit").cast("double")).otherwise(F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight"))).alias("target"))


def _with_copies(rows: DataFrame, ties: list[Column], seed: int, max_copies: int) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to rows with ``doc``, ``source`` and ``size``; ``ties`` orders those equal in id and size."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = source_targets(totals.select("source", "source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "docs", F.coalesce(F.sum("docs").over(order), F.lit(0)).alias("start"))
    table = targets.join(starts, targets["source"].eqNullSafe(starts["source"])).drop(starts["source"])
    table = written(table, "mix-targets")
    ordered = with_position(
        rows.select("*", F.md5(F.coalesce(F.col("doc").cast("string"), F.lit(""))).alias("md5")),
        [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("md5"), *ties],
    )
    joined = ordered.join(table, ordered["source"].eqNullSafe(table["source"])).drop(table["source"])
    offset = F.conv(F.substring(F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = (F.col("position") - F.col("start")).cast("double")
    copies = F.floor(rate * (rank + 1) + offset) - F.floor(rate * rank + offset)
    return joined.withColumn("copies", F.least(copies, F.lit(max_copies)).cast("long"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, max_copies: int = 3) -> DataFrame:
    """Copies of each document that the mix takes.

    Returns a row for each row of ``docs``: id, ``source``, ``size`` (words),
    ``source_size``, ``target`` (words, of its source) and ``copies``. Within a source each
    document's expected copies are target / source_size. Documents stand by falling size, then by
    MD5 of the id; a document gets a copy for each integer that the running sum of
    expected copies plus the source's offset crosses. So copies are the expected ones
    rounded up or down, and all sizes are taken in proportion.

    A null text has size 0. Rows equal in id and size are interchangeable, so
    reruns agree. A source without words has target 0.
    """
    text = whole(text_col)
    slim = written(docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), word_count(text).alias("size")), "mix-sizes")
    return _with_copies(slim, [], seed, max_copies).select(F.col("doc").alias(id_col), "source", "size", "source_size", "target", "copies")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, max_copies: int = 3) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (same columns).

    Rows go through the mix as they are, so ids may be null or repeated.
    """
    text = whole(text_col)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = _with_copies(rows, [F.xxhash64(F.col("row")[text_col])], seed, max_copies).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
