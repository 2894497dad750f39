"""Sharding by a Feistel permutation over global row numbers. DataFrame functions only."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, functions as F

from .ordering import with_position
from .scratch import written
from .text import whole

#: A prime below 2**31: products of two residues fit a 64-bit integer.
PRIME = 2147483647


def round_keys(seed: int, rounds: int) -> list[tuple[int, int]]:
    """Multiplier and summand of each round, from the seed."""
    made = [hashlib.sha256(f"{seed}:{k}".encode()).digest() for k in range(rounds)]
    return [(int.from_bytes(d[:4], "big") % (PRIME - 1) + 1, int.from_bytes(d[4:8], "big") % PRIME) for d in made]


def halves(n: int) -> tuple[int, int]:
    """Two radices whose product is at least n, and by less than the first of them above it."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _mix(x: Column, key: tuple[int, int]) -> Column:
    """A keyed function of a residue: linear, squared, linear again, modulo PRIME."""
    y = (x * key[0] + key[1]) % PRIME
    return (y * y % PRIME + y) % PRIME


def permute(row: Column, n: int, seed: int = 11, rounds: int = 6, walks: int = 64) -> Column:
    """Place of row number ``row`` in a permutation of 0 to n - 1.

    A Feistel network over pairs of residues (``halves``) permutes a few more numbers
    than n; a number that lands at n or above is permuted again (cycle walking) until it
    is below. At most one in sqrt(n) lands there, so ``walks`` steps don't run out: if
    ever they did, the query fails and no row is misplaced.
    """
    a, b = halves(n)
    keys = round_keys(seed, rounds)

    def step(x: Column) -> Column:
        pair = F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r"))
        for k, key in enumerate(keys):
            # transform over one element binds the pair, so it is computed once a round
            turn = (lambda key, k: lambda p: F.struct(((p["l"] + _mix(p["r"], key)) % a).alias("l"), p["r"].alias("r")) if k % 2 == 0 else F.struct(p["l"].alias("l"), ((p["r"] + _mix(p["l"], key)) % b).alias("r")))(key, k)
            pair = F.element_at(F.transform(F.array(pair), turn), 1)
        return F.element_at(F.transform(F.array(pair), lambda p: p["r"] * a + p["l"]), 1)

    first = step(row)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), first, lambda x, _: F.when(x < n, x).otherwise(step(x)))
    place = F.when(first < n, first).otherwise(walked)
    return F.when(place < n, place).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """Deal all rows into ``shards`` shards, at most one row apart, in a reproducible shuffle.

    Rows are numbered in order of id, CRC-32 and size (null ids first); the permuted
    number p gives shard p mod ``shards`` and slot p div ``shards``, so both can be
    computed for any row number without the table. Returns id, ``size`` (UTF-8
    bytes plus 8; null: 8), ``text_crc32`` (null: as empty), ``law`` ('rows'), ``shard``,
    ``slot`` and ``grown_shard`` (null: this law moves rows when the number grows). Rows equal in all three are
    interchangeable. An empty table gives no rows.
    """
    text = whole(text_col)
    slim = written(docs.select(F.col(id_col).alias("doc"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "shard-rows")
    n = max(1, slim.count())
    place = with_position(slim, [F.col("doc"), F.col("text_crc32"), F.col("size")]).withColumn("place", permute(F.col("position"), n, seed))
    return place.select(F.col("doc").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
