"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Hashed words and their beginnings: the weights take 2 MB.
BUCKETS = 1 << 18
#: Characters stripped from both ends of a word.
EDGES = ".,;:!?\"'()[]{}|*-_"


#: A word is described by itself and its beginnings of these lengths, so that forms of a word share weight.
STEMS = (4, 5, 6, 7)


def word_buckets(word: str) -> tuple[int, ...]:
    word = word.strip(EDGES).lower()
    return tuple({zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in (word, *("^" + word[:k] for k in STEMS if len(word) > k))}) if word else ()


class WordBuckets(dict):
    """Buckets of each word, of those in ``used`` if given; keeps ``room`` words."""

    def __init__(self, used: frozenset[int] | None = None, room: int = 300_000):
        super().__init__()
        self.used, self.room = used, room

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.room:
            self.clear()
        found = word_buckets(word)
        if self.used is not None:
            found = tuple(b for b in found if b in self.used)
        if len(word) <= 64:
            self[word] = found
        return found

    def of(self, text: str) -> set[int]:
        """Distinct buckets of the words of a whole text."""
        return set().union(*map(self.__getitem__, set(text.split())))


class NonNegativePU:
    """A linear classifier by the non-negative risk estimator.

    With prior p, the risk is p * E+[l(g)] + max(0, E_u[l(-g)] - p * E+[l(-g)]), l the logistic
    loss: the second part estimates the risk on negatives from unlabelled text, corrected for the positives
    in it, and is kept from falling below zero: where it does, the step goes against it. Full-batch Adam with a
    falling rate; ``sparse`` and ``decay`` are the L1 and L2 penalties. A bucket in fewer than ``min_docs`` sample
    documents gets no weight (fewer than a fiftieth of them in a small sample).
    """

    def __init__(self, prior: float, steps: int = 300, rate: float = 0.03, sparse: float = 8e-4, decay: float = 5e-5, min_docs: int = 20):
        self.prior, self.steps, self.rate, self.sparse, self.decay, self.min_docs = prior, steps, rate, sparse, decay, min_docs
        self.weights, self.bias = np.zeros(BUCKETS), 0.0

    def risk(self, w: np.ndarray, doc: np.ndarray, col: np.ndarray, is_p: np.ndarray) -> tuple[float, np.ndarray]:
        """The corrected risk of weights (the bias last) on documents given as (document, column) pairs, and the direction of the step's descent.

        That is the risk's gradient; where the estimate on negatives has fallen below zero it is that of its negative.
        """
        n, n_p = len(is_p), int(is_p.sum())
        g = np.bincount(doc, w[:-1][col], minlength=n) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        loss = np.logaddexp(0, g)  # l(-g); its slope is s, that of l(g) is s - 1
        negative = loss[~is_p].mean() - self.prior * loss[is_p].mean()
        if negative >= 0:
            d = np.where(is_p, -self.prior / n_p, s / (n - n_p))
        else:
            d = np.where(is_p, self.prior * s / n_p, -s / (n - n_p))
        grad = np.append(np.bincount(col, d[doc], minlength=len(w) - 1), d.sum())
        return float(self.prior * np.logaddexp(0, -g[is_p]).mean() + max(0.0, negative)), grad

    def fit(self, positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> NonNegativePU:
        sets = [*positive, *unlabelled]
        n_p, n = len(positive), len(sets)
        flat = np.concatenate(sets).astype(np.int64)
        seen = np.bincount(flat, minlength=BUCKETS)
        used = np.flatnonzero(seen >= min(self.min_docs, max(1, n // 50)))
        column = np.full(BUCKETS, -1, np.int32)
        column[used] = np.arange(len(used))
        doc = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
        col = column[flat]
        doc, col = doc[col >= 0], col[col >= 0]
        del flat
        w = np.zeros(len(used) + 1)
        m, v = np.zeros_like(w), np.zeros_like(w)
        w[-1] = np.log(self.prior / (1 - self.prior))
        is_p = np.arange(n) < n_p
        for k in range(1, self.steps + 1):
            _, grad = self.risk(w, doc, col, is_p)
            grad[:-1] += self.decay * w[:-1] + self.sparse * np.sign(w[:-1])
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w -= self.rate * min(1, 2 - 2 * k / self.steps) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w[:-1][np.abs(w[:-1]) < 0.02] = 0  # what the L1 penalty holds near zero
        self.weights[used], self.bias = w[:-1], w[-1]
        return self


def _at_most(buckets: set[int], text: str, most: int) -> np.ndarray:
    found = np.sort(np.fromiter(buckets, "<i4"))
    if len(found) > most:
        found = np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace"))).choice(found, most, replace=False)
    return found


def _bucket_sets(docs: DataFrame, most: int) -> list[tuple[bool, bool, np.ndarray]]:
    """For each text of a bounded sample, on the driver: whether it counts as positive, as unlabelled, and its buckets, ``most`` at most."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordBuckets()
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(0)]
            found = pa.array([_at_most(cache.of(t), t, most).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), found], names=["p", "u", "b"])

    rows = docs.select("text", "p", "u").mapInArrow(sets, "p boolean, u boolean, b binary").collect()
    return [(r["p"], r["u"], np.frombuffer(r["b"], "<i4")) for r in rows]


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positive: int = 3000, max_unlabelled: int = 6000, folds: int = 5, priors: tuple[float, float] = (0.01, 0.5), max_buckets: int = 8192) -> NonNegativePU | None:
    """Fit the classifier; None if no toxic row can be learned from.

    Uses rows whose crc32(id as text) mod ``folds`` is not 0: up to ``max_positive`` documents marked toxic and up to
    ``max_unlabelled`` of all documents, both by smallest hash of the id. That sample goes to the driver, of a document with more than
    ``max_buckets`` different features as many, drawn at random: 32 kB each, so the sample has a proven size; scores are of all features. The class
    prior is the share of toxic rows among labelled ones, kept within ``priors``: beyond them the correction has no use.
    Null ids and labels of null ids are not learned from; of rows with equal id each counts.
    """
    learn = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != 0
    marks = labels.where(learn & F.col("toxic").isNotNull()).select(F.col(id_col).alias("id"), "toxic")
    prior = marks.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not prior:
        return None
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = [F.xxhash64("id"), F.col("id")]
    sample_p = marks.where("toxic = 1").select("id").orderBy(*order).limit(max_positive).withColumns({"p": F.lit(True), "u": F.lit(False)})
    sample_u = docs.where(learn).select(F.col(id_col).alias("id")).orderBy(*order).limit(max_unlabelled).withColumns({"p": F.lit(False), "u": F.lit(True)})
    sample = sample_p.unionByName(sample_u).groupBy("id").agg(F.bool_or("p").alias("p"), F.bool_or("u").alias("u"))
    sets = _bucket_sets(texts.join(F.broadcast(sample), "id"), max_buckets)  # at most max_positive + max_unlabelled ids
    positive, unlabelled = [b for p, _, b in sets if p], [b for _, u, b in sets if u]
    if not positive or not unlabelled:
        return None
    return NonNegativePU(min(priors[1], max(priors[0], prior))).fit(positive, unlabelled)


def score_toxicity(docs: DataFrame, model: NonNegativePU | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``name``: probability-like score from 0 to 1 of each whole text; without a model, 0 for all."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    weights, bias = {int(b): float(model.weights[b]) for b in np.flatnonzero(model.weights)}, float(model.bias)
    caches: dict[int, WordBuckets] = {}

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        cache = caches.setdefault(0, WordBuckets(frozenset(weights)))  # one a task
        g = np.array([sum(weights[b] for b in sorted(cache.of(t or ""))) + bias for t in texts], dtype=float)
        return pd.Series(1 / (1 + np.exp(-np.clip(g, -30, 30))))

    return docs.withColumn(name, score(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """Toxicity of each row: id, ``held_out``, ``score`` and ``predicted`` (1 if the score is 0.5 or more).

    Only words of the text enter a score. Null and empty texts get the score of no words; a row with a null id is
    scored like others and is not held out, but nothing is learned from it. Rows with equal id are scored one by one. An empty table gives no rows; without
    a toxic row to learn from all scores are 0. Columns of the names of the result are replaced.
    """
    scored = score_toxicity(docs.select(id_col, text_col), train_toxicity(docs, labels, id_col, text_col, folds=folds), text_col)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
