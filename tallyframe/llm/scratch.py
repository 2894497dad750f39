"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_dir

#: What has been written and not been deleted, by application: folders, and the tables over some of them.
_WRITTEN: dict[str, dict[str, str | None]] = {}


def _place(spark: SparkSession, name: str, table: bool = False) -> tuple[str, str | None]:
    mark = uuid.uuid4().hex
    path, named = f"{shared_dir(spark)}/{name}-{mark}", f"tf_{name.replace('-', '_')}_{mark}" if table else None
    _WRITTEN.setdefault(spark.sparkContext.applicationId, {})[path] = named
    return path, named


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends there.

    A lost executor costs nothing that was written. ``discard`` and ``release`` delete the files.
    """
    path, _ = _place(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._tf_path = path
    return found


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """The same as a table in buckets by ``keys``, each one file sorted by them: joins on the keys need no exchange of it, within ``ordered_scans`` no sort."""
    path, table = _place(df.sparkSession, name, table=True)
    df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    found = df.sparkSession.table(table)
    found._tf_path = path
    return found


@contextmanager
def ordered_scans(spark: SparkSession) -> Iterator[None]:
    """Let scans of buckets tell that they are sorted, while tables are merged."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def sized_shuffles(spark: SparkSession, rows: int, each: int = 100_000) -> Iterator[None]:
    """No more partitions a shuffle than some for ``each`` of so many rows, while small tables are joined step by step; what is run within must be written within."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(1, min(int(before), -(-rows // each)))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _delete(spark: SparkSession, path: str, table: str | None) -> None:
    if table:
        spark.sql(f"drop table if exists {table}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables from ``written`` or ``bucketed`` that nothing reads any more: what is made from them has been written."""
    for df in tables:
        spark, path = df.sparkSession, df._tf_path
        _delete(spark, path, _WRITTEN.get(spark.sparkContext.applicationId, {}).pop(path, None))


def release(spark: SparkSession) -> None:
    """Delete all that is left; call it when no result is read any more."""
    for path, table in _WRITTEN.pop(spark.sparkContext.applicationId, {}).items():
        _delete(spark, path, table)
