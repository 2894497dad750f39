"""Scans of JSON lines by physical line, and sinks."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import variant as V
from ..model import SAVED_RESULT


def numbered_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``file_path``, ``line_num`` (from 1, within its file) and ``line`` of text files; a limit counts blank and broken lines, too, within each file.

    Files are read in splits. Lines of a split have consecutive ids, so only the number of lines before each split is needed:
    one row a split is counted, summed up by file and joined back. No line moves.
    """
    at = ["file_path", "file_block_start"]
    rows = spark.read.text(path).select(F.col("value").alias("line"), *[F.col(f"_metadata.{c}").alias(c) for c in at], F.monotonically_increasing_id().alias("id"))
    splits = rows.groupBy(*at).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(*at, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = rows.join(F.broadcast(starts), at).select("file_path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_num"), "line")  # one row a split
    return numbered.where(F.col("line_num") <= limit) if limit else numbered


def scan_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``file_path``, ``line_num`` and ``record`` (VARIANT) of each line that holds JSON; blank and broken lines are left out."""
    rows = numbered_lines(spark, path, limit).where(F.trim("line") != "")
    return rows.withColumn("record", V.parse(F.col("line"))).where("record is not null").drop("line")


def _text(record: Column, name: str) -> Column:
    """A member as text: a JSON text as it is, anything else as JSON."""
    found = V.field(record, name)
    return F.when(V.kind(found) == "STRING", V.field(record, name, "string")).otherwise(F.to_json(found))


def scan_tasks(spark: SparkSession, path: str, fields: dict[str, Any] | None = None, limit: int | None = None, seed: int | None = None) -> DataFrame:
    """Tasks of a JSON-lines file: ``line_num, task_id, instruction, expected_output, metadata``.

    ``fields`` names ``input_field`` (instruction), ``output_field`` (expected_output) and ``metadata_fields``. An absent id is
    task_ and the line's number, absent texts are empty, metadata holds only listed members that are present.
    ``limit`` takes the first tasks in order of files and lines; with ``seed`` these are shuffled afterwards.
    """
    fields = fields or {}
    record = F.col("record")
    pairs = [F.struct(F.lit(n).alias("key"), _text(record, n).alias("value")) for n in fields.get("metadata_fields", [])]
    present = F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()) if pairs else None
    metadata = F.map_from_entries(present) if pairs else F.create_map().cast("map<string,string>")
    tasks = scan_jsonl(spark, path).select(
        "file_path", "line_num",
        F.coalesce(_text(record, "task_id"), F.concat(F.lit("task_"), F.col("line_num").cast("string"))).alias("task_id"),
        F.coalesce(_text(record, fields.get("input_field", "instruction")), F.lit("")).alias("instruction"),
        F.coalesce(_text(record, fields.get("output_field", "expected_output")), F.lit("")).alias("expected_output"),
        metadata.alias("metadata"),
    )
    if limit:
        tasks = tasks.orderBy("file_path", "line_num").limit(limit)
    return (tasks.orderBy(F.xxhash64(F.lit(seed), "file_path", "line_num")) if seed is not None else tasks).drop("file_path")


def prompt(df: DataFrame) -> Column:
    """The instruction, and a line for each metadata member but the id."""
    kept = F.filter(F.map_entries("metadata"), lambda e: e["key"] != "task_id")
    lines = F.array_join(F.transform(kept, lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"])), "\n")
    return F.when(F.size(kept) == 0, F.col("instruction")).otherwise(F.concat("instruction", F.lit("\n\n"), lines))


def scan_results(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Saved result rows; with ``strict`` a broken line fails, otherwise it is left out."""
    return spark.read.schema(SAVED_RESULT).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def scan_report(spark: SparkSession, path: str, beside: str | None = None) -> tuple[DataFrame | None, dict[str, Any]]:
    """What a report is made from: the saved rows, of which a broken one fails, and the aggregate saved beside them, empty without one.

    A path that ends in .json is an aggregate alone, or a whole report with its rows under ``individual``.
    """
    if path.endswith(".json"):
        found = _read_json(path)
        rows = found.pop("individual", None)
        return (spark.createDataFrame([{k: r.get(k) for k in _saved_names()} for r in rows], SAVED_RESULT) if rows else None), found
    beside = beside or path.rstrip("/").removesuffix(".jsonl") + ".json"
    return scan_results(spark, path, strict=True), _read_json(beside) if Path(beside).is_file() else {}


def _read_json(path: str) -> dict[str, Any]:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def _saved_names() -> list[str]:
    return [c.split(" ")[0] for c in SAVED_RESULT.replace("map<string,double>", "map").split(", ")]


def scan_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The saved rows of several runs, one after another, with the id of their run; equal rows stay."""
    return reduce(DataFrame.unionByName, [spark.read.schema(SAVED_RESULT + ", run_id string").json(p) for p in paths])


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path`` and ``text`` of the files of a folder and those below it whose names match; each file that is not empty is one row."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return rows.select("path", F.col("content").cast("string").alias("text"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path`` and ``size`` of the files of a folder and those below it whose names match; their contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return rows.select("path", F.col("length").alias("size"))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """Rows as JSON lines, nulls written out; the path is a folder with a file for each task of the write."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def save_results(df: DataFrame, path: str, run_id: str) -> None:
    """Append result rows with the id of their run, so that a run that is repeated can be told apart."""
    write_jsonl(df.select(*_saved_names(), F.lit(run_id).alias("run_id")), path, append=True)


def save_aggregate(row: dict[str, Any], path: str) -> None:
    """One aggregate as a JSON file on the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(row, f, ensure_ascii=False, indent=2)
