"""URL filter: rules by host and path, and boosted trees on lexical features for what no rule decides."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .boosting import BoostedTrees
from .text import lower_ascii, whole

#: Rules that may be compiled into columns.
MOST_RULES = 500
#: Kinds of keys whose statistics are features: ends of the host of one to three labels, first part of the path, ending of the file.
KINDS = ("suffix1", "suffix2", "suffix3", "section", "file")
#: A key of one in so many rows has statistics of its own, so there are at most as many of a kind; all others of a kind share theirs.
KEY_SHARE = 10_000
FOLDS = 5
#: Labels that the share of a key starts from.
PRIOR = 10.0
LEXICAL = ("length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "entropy", "host_entropy", "parameters", "hyphens", "fragment")


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    def __post_init__(self) -> None:
        if self.verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {self.verdict!r}")

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (then up to ``?``, ``#`` or the end); both empty for null and without ``://``."""
    at = F.instr(whole(url), "://")
    rest = F.when(at > 0, F.substr(whole(url), at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def fitting_rule(host: Column, path: Column, rules: Iterable[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does. Of rules of one length the longer host goes first, of equal ones ``block``."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block", r.text))
    if len(ordered) > MOST_RULES:
        raise ValueError(f"{len(ordered)} rules; at most {MOST_RULES} can be compiled")
    fits = [(r, ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)) for r in ordered]
    first = lambda value: reduce(lambda c, f: F.when(f[1], F.lit(value(f[0]))).otherwise(c), reversed(fits), F.lit(None).cast("string"))
    return first(lambda r: r.text), first(lambda r: r.verdict)


def _keys(host: Column, path: Column) -> Column:
    """One key of each kind; long ones by their digest."""
    short = lambda c: F.when(F.length(c) > 64, F.md5(c)).otherwise(c)
    file = F.when(path.endswith("/"), F.lit("/")).otherwise(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)))
    return F.array(*[short(F.substring_index(host, ".", -k)) for k in (1, 2, 3)], short(F.regexp_extract(path, r"^/[^/]*", 0)), file)


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def lexical_features(url: str, host: str, path: str) -> list[float]:
    """The values of ``LEXICAL``: lengths, depth of the path, labels of the host, shares of digits, entropies in bits a character, parameters, hyphens of the host, fragment."""
    query = url.partition("#")[0].partition("?")[2]
    digits = lambda s: sum(map(s.count, "0123456789")) / max(len(s), 1)
    return [len(url), len(host), len(path), sum(map(bool, path.split("/"))), len(host.split(".")), digits(url), digits(host), _entropy(url), _entropy(host), sum(map(bool, query.split("&"))), host.count("-"), float("#" in url)]


class KeyStatistics:
    """How often keys occur and which share of their labels is ``block``, in all folds or in all but one."""

    def __init__(self, rows: list, total: int):
        self.total = max(total, 1)
        self.known = {(r["kind"], r["key"]): (r["n"], np.array(r["labels"], float), np.array(r["blocked"], float)) for r in rows}
        # every row has one key of each kind: any kind has all labels
        first = [v for (kind, _), v in self.known.items() if kind == 0]
        labels, blocked = (sum((v[c].sum() for v in first), 0.0) for c in (1, 2))
        self.share = blocked / labels if labels else 0.0
        self.labels = int(labels)

    def features(self, keys: list[str], without: int | None = None) -> list[float]:
        """Share of rows and share of blocked labels of each key, those of all rare keys of its kind for a rare one."""
        out: list[float] = []
        for kind, key in enumerate(keys):
            n, labels, blocked = self.known.get((kind, key)) or self.known.get((kind, None)) or (0, np.zeros(FOLDS), np.zeros(FOLDS))
            some = labels.sum() - (0 if without is None else labels[without])
            bad = blocked.sum() - (0 if without is None else blocked[without])
            out += [n / self.total, (bad + PRIOR * self.share) / (some + PRIOR)]
        return out


@dataclass
class UrlModel:
    """What judges URLs: statistics of keys, and trees (None where the labels are of one kind: then their share is the score)."""

    statistics: KeyStatistics
    trees: BoostedTrees | None

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.trees.probability(x) if self.trees else np.full(len(x), self.statistics.share)

    def score(self, url: Column, host: Column, path: Column) -> Column:
        """Likelihood of ``block``, 0 to 1."""

        @F.pandas_udf("double")
        def scored(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for urls, hosts, paths, keys in batches:
                rows = [[*lexical_features(u, h, p), *self.statistics.features(list(k))] for u, h, p, k in zip(urls, hosts, paths, keys, strict=True)]
                yield pd.Series(self.probability(np.array(rows)) if rows else [], dtype=float)

        return scored(whole(url), host, path, _keys(host, path))


def train_url_filter(urls: DataFrame, url_col: str = "url", label_col: str = "label", max_labelled: int = 20_000) -> UrlModel:
    """A model from URLs of which some are labelled: 1 for block, 0 for allow, null for unknown.

    Statistics of keys (ends of hosts, first parts of paths, endings of files) are counted over all rows and all labels. A key of at least one in KEY_SHARE
    rows has its own, all others of a kind share theirs, so what reaches the driver is bounded. The trees are fitted on
    at most ``max_labelled`` different labelled URLs, half of each label, those of the smallest hash; for them, a key's labels of their own fold are left out.
    """
    url = F.col(url_col).cast("string")
    host, path = split_url(url)
    rows = urls.select(url.alias("url"), F.col(label_col).cast("int").alias("label"), F.pmod(F.xxhash64(whole(url)), F.lit(FOLDS)).cast("int").alias("fold"), _keys(host, path).alias("keys"), host.alias("host"), path.alias("path"))
    listed = rows.select("label", "fold", F.posexplode("keys").alias("kind", "key"))
    per = lambda hit: F.array(*[F.count_if(hit & (F.col("fold") == f)) for f in range(FOLDS)])
    counted = listed.groupBy("kind", "key").agg(F.count("*").alias("n"), per(F.col("label").isNotNull()).alias("labels"), per(F.col("label") == 1).alias("blocked"))
    total = rows.count()
    summed = lambda c: F.array(*[F.sum(F.col(c)[f]) for f in range(FOLDS)]).alias(c)
    pooled = counted.withColumn("key", F.when(F.col("n") * KEY_SHARE >= total, F.col("key"))).groupBy("kind", "key").agg(F.sum("n").alias("n"), summed("labels"), summed("blocked"))
    statistics = KeyStatistics(pooled.collect(), total)  # at most KEY_SHARE + 1 keys of each of five kinds
    known = rows.where("label is not null and url is not null").groupBy("url", "label").agg(*[F.first(c).alias(c) for c in ("fold", "keys", "host", "path")])
    sample = [r for y in (0, 1) for r in known.where(F.col("label") == y).orderBy(F.xxhash64("url"), "url").limit(max_labelled // 2).collect()]
    y = np.array([r["label"] for r in sample], float)
    if not 0 < y.sum() < len(y):
        return UrlModel(statistics, None)
    x = np.array([[*lexical_features(r["url"], r["host"], r["path"]), *statistics.features(r["keys"], r["fold"])] for r in sample])
    return UrlModel(statistics, BoostedTrees(trees=60, depth=3, rate=0.3).fit(x, y))


def filter_urls(pages: DataFrame, rules: Iterable[Rule], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", max_labelled: int = 20_000) -> DataFrame:
    """A verdict for each URL: that of the longest rule that fits, otherwise that of the trees: id, ``host``, ``path``, ``rule``, ``verdict``, ``score``.

    The trees learn from ``labelled`` (``url``, and ``label`` 1 for block or 0 for allow), or without it from those of ``pages`` that a rule decides.
    No row moves: rules and features are columns, the model is bounded and goes to every task. A null URL and one without ``://`` have an empty host and path, and no
    rule with a host or a path fits. Without labels all are allowed, with labels of one kind all get that. Rows are judged one by one, repeated ids and URLs as often as they occur; other columns are ignored.
    """
    rules = tuple(rules)
    host, path = split_url(F.col(url_col).cast("string"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    read = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("__url"), host.alias("host"), path.alias("path"))
    judged = read.select("*", rule.alias("rule"), verdict.alias("__by_rule"))
    seen = judged.select(F.col("__url").alias("url"), F.when(F.col("__by_rule").isNotNull(), (F.col("__by_rule") == "block").cast("int")).alias("label"))
    if labelled is not None:
        seen = seen.withColumn("label", F.lit(None).cast("int")).unionByName(labelled.select(F.col("url").cast("string"), F.col("label").cast("int")))
    model = train_url_filter(seen, max_labelled=max_labelled)
    scored = judged.withColumn("score", model.score(F.col("__url"), F.col("host"), F.col("path")))
    learnt = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(id_col, "host", "path", "rule", F.coalesce("__by_rule", learnt).alias("verdict"), "score")
