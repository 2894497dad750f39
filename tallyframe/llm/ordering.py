"""Row numbers over a whole table without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import written


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add ``name``: the 0-based place of each row in the order of ``order``.

    The rows are range-partitioned and sorted once. A partition's id and a row's
    place in it are then the halves of ``monotonically_increasing_id``; only the
    number of rows in each partition (one row a partition) is summed up and joined
    back. A hot key is spread if later columns of ``order`` tell its rows apart.
    Rows equal in all of ``order`` get their places in any order.
    """
    placed = written(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()),
        "positions",
    ).withColumn("_pid", F.shiftright("_mid", 33))
    counts = placed.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition of a shuffle: bounded by its number of partitions
    starts = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_pid").withColumn(name, F.col("_start") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_pid", "_mid", "_start")
