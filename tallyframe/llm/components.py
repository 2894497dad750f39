"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .hot import hot_join
from .scratch import discard, sized_shuffles, written


def _print(edges: DataFrame) -> tuple:
    """Count and two hashes of the links: equal if nothing has moved."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first())


def _round(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("many")).select("a", F.least("a", "low").alias("low"), "many")
    # larger neighbours of each id are linked to the smallest id it knows
    large = hot_join(both, low, ["a"], "many", total).where("b > a or a = low").select(F.when(F.col("b") > F.col("a"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("low").alias("b")).distinct()
    large = written(large, "links")
    low = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("many"))
    small = hot_join(large, low, ["a"], "many", total).select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("x")).select("x.*").distinct()
    settled = written(small, "links")
    discard(large)
    return settled


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, component`` (the smallest id reachable) of each id in ``links`` (``a``, ``b``).

    Alternates two steps over the links: each id's larger neighbours, then its smaller ones, are linked to
    the smallest id among it and its neighbours. That ends in stars around the smallest ids
    after a number of rounds that grows with the logarithm of the size. An id's smallest neighbour is found by
    aggregation with map-side combining, never by gathering its neighbours; ids with a large share of all links meet theirs by
    broadcast, as each step has at most twice as many rows as there are links.
    Each round is written to the shared folder, in as many partitions as its links need. Links of an id with itself count as an id without others; null ids are dropped.
    """
    nodes = links.where("a is not null and b is not null")
    edges = written(nodes.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _print(edges)
    for _ in range(rounds):
        with sized_shuffles(links.sparkSession, 2 * before[0]):
            settled = _round(edges, before[0])
            discard(edges)
            edges = settled
            now = _print(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
