"""Fuzzy join of two tables of texts: pairs whose sets of words are similar, found by rare words and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..sources.shared import stored
from .skew import hot_join

#: 64-bit columns of a class's bitmap, a power of two. Sets of some 200 words fill most of 64 or 128 bits, so that any two pass; four columns tell them apart.
BITMAP_LONGS = 4


def _null_safe(left: str, right: str, columns: list[str]) -> list[Column]:
    return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]


def _numbered_texts(df: DataFrame, text: str, group: list[str]) -> DataFrame:
    """The different texts of a group that have words, each with a number: stored, so that numbers stay."""
    found = df.select(*group, text).distinct().where(F.size(T.tokens(F.col(text))) > 0)
    return stored(found.withColumn("_id", F.monotonically_increasing_id()), "numbered-texts")


def _listed(texts: DataFrame, text: str, group: list[str]) -> DataFrame:
    """A row for each different word of a text: ``_id``, ``_n`` (how many it has) and ``_token``, a 64-bit hash of group and word."""
    home = F.xxhash64(F.to_json(F.struct(*group))) if group else F.lit(0)
    words = texts.select("_id", home.alias("_home"), F.array_distinct(T.tokens(F.col(text))).alias("_words"))
    return words.select("_id", F.size("_words").alias("_n"), "_home", F.explode("_words").alias("_word")).select("_id", "_n", F.xxhash64("_home", "_word").alias("_token"))


def _least(n: Column, threshold: float) -> Column:
    """Words that a similar set must share with one of n words at least."""
    return F.floor(n * threshold).cast("int") + 1


def _bits(token: Column) -> list[Column]:
    """Aggregates that make a bitmap of tokens: BITMAP_LONGS columns of 64 bits."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), token.bitwiseAND(63).cast("int"))
    home = F.shiftright(token, 6).bitwiseAND(BITMAP_LONGS - 1)
    return [F.bit_or(F.when(home == i, bit).otherwise(0)).alias(c) for i, c in enumerate(_bitmap())]


def _bitmap() -> list[str]:
    return [f"_bits{i}" for i in range(BITMAP_LONGS)]


def _by_text(listed: DataFrame, threshold: float) -> DataFrame:
    """Texts that can be similar to any: ``_id``, ``_n``, ``_tokens`` (those that both tables have, rarest first), ``_class``, a digest of both, and a bitmap of the tokens.

    A token becomes one number that sorts by rarity: a byte for the power of 2 ** (1 / 4) that its frequency reaches, then 56 bits of its hash.
    """
    rarity = F.floor(4 * F.log2(F.col("_df").cast("double"))).cast("long")
    code = F.shiftleft(rarity, 56).bitwiseOR(F.shiftrightunsigned("_token", 8))
    found = listed.groupBy("_id").agg(F.first("_n").alias("_n"), F.array_sort(F.collect_list(code)).alias("_tokens"), *_bits(code)).where(F.size("_tokens") >= _least(F.col("_n"), threshold))
    return found.withColumn("_class", F.unhex(F.md5(F.to_json(F.struct("_n", "_tokens")))))


def _prefixes(classes: DataFrame, threshold: float) -> DataFrame:
    """The rarest tokens of each class that a similar one cannot all miss, with the number of tokens from there on (``left``), the number of all (``k``) and a bitmap of all."""
    k = F.size("_tokens")
    first = F.slice("_tokens", F.lit(1), k - _least(F.col("_n"), threshold) + 1)
    about = classes.select("_rep", F.col("_n").alias("n"), k.alias("k"), *_bitmap(), F.posexplode(first).alias("place", "token"))
    return about.withColumn("left", F.col("k") - F.col("place")).drop("place")


def _met(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of classes that are worth a comparison, ``left_rep`` and ``right_rep``: all similar ones, and few others."""
    one, two = (_prefixes(side, threshold).alias(name) for side, name in ((left, "l"), (right, "r")))
    n, m = F.col("l.n"), F.col("r.n")
    lacking = lambda a, b: sum(F.bit_count(F.col(f"{a}.{c}").bitwiseAND(F.bitwise_not(F.col(f"{b}.{c}")))) for c in _bitmap())
    most = F.least(F.col("l.left"), F.col("r.left"), F.col("l.k") - lacking("l", "r"), F.col("r.k") - lacking("r", "l"))
    # more than threshold of the union: shared * (1 + threshold) > threshold * (n + m); rounding is left to the comparison
    enough = (most + 1e-6) * (1 + threshold) > threshold * (n + m)
    return one.join(two, [F.col("l.token") == F.col("r.token"), (n > threshold * m) & (m > threshold * n), enough]).select(F.col("l._rep").alias("left_rep"), F.col("r._rep").alias("right_rep")).distinct()


def similar_classes(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of classes whose Jaccard similarity is over ``threshold`` (0 < threshold < 1): ``left_rep``, ``right_rep``, ``similarity``.

    Tokens are in one order, rarest first. Similar sets of n and m words share more than threshold times n words, so one of the first k - floor(threshold * n) of the k tokens that count is common to both
    (prefix filter), and n and m differ by no more than that share (length filter). Only classes that meet under such a token are compared, if enough tokens are left from there on in both, and if the tokens whose bit the other's
    bitmap lacks, which it cannot have, leave enough. Nothing is paired without a key. A pair moves with the tokens of one side to be compared, so pairs that are not similar have to go before that.
    """
    met = _met(left, right, threshold)
    sides = [s.select(F.col("_rep").alias(f"{side}_rep"), F.col("_n").alias(f"{side}_n"), F.col("_tokens").alias(f"{side}_tokens")) for s, side in ((left, "left"), (right, "right"))]
    shared = F.size(F.array_intersect("left_tokens", "right_tokens"))
    compared = met.join(sides[0], "left_rep").join(sides[1], "right_rep").withColumn("shared", shared)
    return compared.select("left_rep", "right_rep", T.ratio(F.col("shared"), F.col("left_n") + F.col("right_n") - F.col("shared")).alias("similarity")).where(F.col("similarity") > threshold)


def similar_texts(left: DataFrame, right: DataFrame, text: str, *by: str, threshold: float = 0.8) -> DataFrame:
    """For each different text of ``left`` (within ``by``) that has similar ones in ``right``: ``by``, the text, ``matches`` (different similar texts), ``best`` (the greatest similarity).

    Similar means a Jaccard similarity of the sets of lower-cased words of more than ``threshold``. Null texts and texts without words are similar to none; null groups match null groups.

    Words are counted within their group, as the same word may be rare among all rows and in each text of a group. Words that only one table has in a group cannot be shared: they count in a set's size alone. So texts with
    as many words and the same words of both tables are one class, compared once, whatever else they hold: copies, and titles that differ by a number, cost no pairs. Words are compared as 56 bits of a hash of group and word.
    """
    group = list(by)
    texts = [_numbered_texts(s, text, group) for s in (left, right)]
    listed = [_listed(t, text, group) for t in texts]
    side = [e.groupBy("_token").agg(F.count("*").alias(c)) for e, c in zip(listed, ("_l", "_r"), strict=True)]
    counted = stored(side[0].join(side[1], "_token").select("_token", (F.col("_l") + F.col("_r")).alias("_df"), (F.col("_l") + F.col("_r")).alias("_many")), "token-counts")
    total = counted.agg(F.sum("_df")).first()[0] or 0
    ids = [_by_text(hot_join(e, counted, ["_token"], "_many", total), threshold) for e in listed]
    ids[0] = stored(ids[0], "text-tokens")  # read for classes and for their texts
    about = [F.min("_id").alias("_rep"), F.first("_n").alias("_n"), F.first("_tokens").alias("_tokens"), *[F.first(c).alias(c) for c in _bitmap()], F.count("*").alias("_texts")]
    one, two = (stored(t.groupBy("_class").agg(*about), "token-classes") for t in ids)  # read for prefixes and comparisons
    pairs = similar_classes(one, two, threshold)
    best = pairs.join(two.select(F.col("_rep").alias("right_rep"), "_texts"), "right_rep").groupBy(F.col("left_rep").alias("_rep")).agg(F.sum("_texts").alias("matches"), F.max("similarity").alias("best"))
    found = ids[0].select("_id", "_class").join(one.select("_class", "_rep").join(best, "_rep"), "_class")
    return texts[0].join(found, "_id").select(*group, text, "matches", "best")


def cited(predicted: DataFrame, expected: DataFrame, text: str, *by: str, threshold: float = 0.8) -> DataFrame:
    """Citation accuracy of lists that are rows of two tables: ``by``, ``num_predicted``, ``num_expected``, ``exact``, ``partial``, ``citation_accuracy``.

    As ``citation_accuracy`` for arrays: different texts that both tables have count 1, predicted ones that are only similar to an expected one which was not predicted count 1/2, over the number expected; without
    any expected, 1 if nothing was predicted, else 0. Lists need not fit a row or a task. Null texts are none.
    """
    group = list(by)
    sides = [s.where(F.col(text).isNotNull()).select(*group, text).distinct().withColumn(side, F.lit(1)) for s, side in ((predicted, "_p"), (expected, "_e"))]
    p, e = (s.alias(a) for s, a in zip(sides, "pe", strict=True))
    both = p.join(e, _null_safe("p", "e", [*group, text]), "full").select(*[F.coalesce(F.col(f"p.{c}"), F.col(f"e.{c}")).alias(c) for c in (*group, text)], "_p", "_e")
    both = stored(both, "cited-texts")  # read three times
    extra, missed = both.where("_e is null").select(*group, text), both.where("_p is null").select(*group, text)
    near = similar_texts(extra, missed, text, *group, threshold=threshold).groupBy(*group).agg(F.count("*").alias("partial"))
    counted = both.groupBy(*group).agg(F.count("_p").alias("num_predicted"), F.count("_e").alias("num_expected"), F.count_if(F.col("_p").isNotNull() & F.col("_e").isNotNull()).alias("exact"))
    c, n = counted.alias("c"), near.alias("n")
    joined = c.join(n, _null_safe("c", "n", group), "left").select(*[F.col(f"c.{k}").alias(k) for k in group], "num_predicted", "num_expected", "exact", F.coalesce("partial", F.lit(0)).alias("partial"))
    accuracy = F.when(F.col("num_expected") == 0, F.lit(0.0)).otherwise((F.col("exact") + 0.5 * F.col("partial")) / F.greatest("num_expected", F.lit(1)))
    return joined.withColumn("citation_accuracy", accuracy)
