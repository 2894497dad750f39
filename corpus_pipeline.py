"""A training corpus from documents: toxic ones out, repeated lines out, near copies out, sources mixed, packed."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.llm.line_dedup import line_dedup
from tallyframe.llm.mixing import repeated
from tallyframe.llm.ngram_join import ngram_components
from tallyframe.llm.ordering import with_position
from tallyframe.llm.packing import pack
from tallyframe.llm.scratch import written
from tallyframe.llm.toxicity import score_toxicity, train_toxicity



def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, name="__tf_toxicity").where("__tf_toxicity < 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur across documents stay in one of them; documents stay, n_chars follows the text."""
    kept = line_dedup(docs)
    if "n_chars" in docs.columns:
        kept = kept.selectExpr(*[f"cast(char_length(text) as bigint) as {c}" if c == "n_chars" else f"`{c}`" for c in docs.columns])
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, one row of it; texts without words stay, too.

    Rows are told apart by their places in the order of ids, null last: ids may be null or repeated.
    """
    placed = with_position(docs, [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")], "__tf_place")
    firsts = ngram_components(placed, id_col="__tf_place").where("__tf_place = component_id").select("__tf_place")
    return placed.join(firsts, "__tf_place", "left_semi").select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return repeated(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("mix_sources", mix_to_weights),
    ("pack", pack_sequences),
]

#: SQL cannot train the classifier or run the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
