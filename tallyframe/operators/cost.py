"""Token costs, provider lookup and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .aggregate import running

#: US dollars for 1000 tokens in and out.
PRICES = (("openai", 0.01, 0.03), ("anthropic", 0.003, 0.015), ("gemini", 0.00125, 0.005), ("groq", 0.0006, 0.0006), ("ollama", 0.0, 0.0), ("bedrock", 0.003, 0.015), ("together", 0.001, 0.001))


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "provider string, price_in double, price_out double")


def tokens_of(usage: Column, text: Column, *names: str) -> Column:
    """A count by the first of its names in the usage, without one a quarter of the text's length."""
    return F.coalesce(*[F.try_element_at(usage, F.lit(n)) for n in names], F.floor(F.length(text) / 4)).cast("long")


def token_cost(df: DataFrame) -> DataFrame:
    """Add ``cost`` from ``provider``, ``tokens_in`` and ``tokens_out``; an unknown provider has none. Prices are seven rows."""
    known = F.broadcast(prices(df.sparkSession))
    return df.join(known, "provider", "left").withColumn("cost", F.col("tokens_in") / 1000 * F.col("price_in") + F.col("tokens_out") / 1000 * F.col("price_out")).drop("price_in", "price_out")


def lookup_providers(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """Requests by provider id, with the provider's columns; a missing one gives an error row."""
    joined = requests.join(providers, "provider_id", "left")
    return joined.withColumn("error", F.when(F.col("name").isNull(), F.concat(F.lit("Provider not found: "), F.col("provider_id")))).withColumn("found", F.col("name").isNotNull())


def appended(messages: Column, role: str, text: Column) -> Column:
    """A conversation's messages (``turn``, ``role``, ``text``) with one more behind the last."""
    turn = F.coalesce(F.array_max(F.transform(messages, lambda m: m["turn"])) + 1, F.lit(0).cast("long"))
    return F.concat(messages, F.array(F.struct(turn.alias("turn"), F.lit(role).alias("role"), text.alias("text"))))


def sessions(turns: DataFrame, reset: Column) -> DataFrame:
    """Add ``session``: how often the conversation has been reset up to the turn. A turn for which ``reset`` holds is the first of a new session; conversations start with session 0.

    Turns of one conversation are counted in stretches of its turn numbers, so a long one is many tasks' work.
    """
    marked = turns.withColumn("_reset", F.coalesce(reset, F.lit(False)).cast("long"))
    return running(marked, ["conv_id"], "turn", {"session": F.col("_reset")}).drop("_reset")


def session_totals(turns: DataFrame, reset: Column, tokens: Column) -> DataFrame:
    """``sessions`` with ``running_tokens`` and ``running_turns``, which start again with each session."""
    counted = sessions(turns.withColumn("_tokens", tokens.cast("long")), reset)
    return running(counted, ["conv_id", "session"], "turn", {"running_tokens": F.col("_tokens"), "running_turns": F.lit(1).cast("long")}).drop("_tokens")


def session_history(turns: DataFrame, reset: Column, system: str = "last") -> DataFrame:
    """``history`` of each session of each conversation: a reset empties what has been said before, system messages, too."""
    return history(sessions(turns, reset), system, ["conv_id", "session"])


def history(turns: DataFrame, system: str = "last", by: list[str] | None = None) -> DataFrame:
    """Messages of each conversation in order, and its system message: the last, or the first."""
    listed = turns.groupBy(*(by or ["conv_id"])).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"), F.count("*").alias("length"))
    prompts = F.filter("messages", lambda m: m["role"] == "system")
    return listed.withColumn("system", F.try_element_at(prompts, F.lit(-1 if system == "last" else 1))["text"])
