"""Ranked lexical search: a tree of maxima over document ranges, searched best first."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import discard, written

#: Documents, and counts of terms in documents, after which a block of the index ends.
BLOCK_DOCS, BLOCK_POSTINGS = 16_384, 1_000_000
#: Ranges of one level that make one of the next.
FANOUT = 16
#: Terms of queries, with repeats between queries, that are looked for in one pass over the documents.
PASS_TERMS = 400_000
#: Bytes as they count: letters, digits and all of other characters stay, A-Z in lower case; anything else separates.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

_BLOCK = "ids binary, sizes binary, starts binary, terms binary, counts binary, docs long, total long"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split(b" ") if text else []


def count_terms(text: str | None) -> tuple[Counter, int]:
    """How often each term is in a text, and how many terms there are in all."""
    found = Counter(terms_of(text))
    found.pop(b"", None)
    return found, found.total()


def index_blocks(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """Blocks of documents with a term of the vocabulary: ids and sizes, and for each the numbers and counts of these terms. ``docs`` and ``total`` count all documents with any term and their terms."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        sizes: list[int] = []
        lengths: list[int] = []
        terms: list[int] = []
        counts: list[int] = []
        look = vocabulary.get

        def block() -> pa.RecordBatch:
            # by id, so that the smaller one of equal documents comes first; those without id come last, they count only
            own = sorted((k for k in range(len(ids)) if ids[k] is not None and lengths[k]), key=ids.__getitem__)
            order = own + [k for k in range(len(ids)) if ids[k] is None and lengths[k]]
            starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            size = np.array([lengths[k] for k in order], dtype=np.int64)
            ends = np.cumsum(size)
            pick = np.repeat(starts[order] - (ends - size), size) + np.arange(size.sum()) if order else np.zeros(0, np.int64)
            columns = [np.array([ids[k] for k in own], "<i8"), np.array([sizes[k] for k in order], "<i8"), np.concatenate([[0], ends]).astype("<i8"), np.array(terms, "<i4")[pick], np.array(counts, "<i4")[pick]]
            return pa.RecordBatch.from_arrays([*(pa.array([c.tobytes()], pa.binary()) for c in columns), pa.array([len(ids)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["ids", "sizes", "starts", "terms", "counts", "docs", "total"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, size = count_terms(text.as_py())
                if not size:
                    continue
                before = len(terms)
                for term, n in found.items():
                    number = look(term)
                    if number is not None:
                        terms.append(number)
                        counts.append(n)
                ids.append(doc)
                sizes.append(size)
                lengths.append(len(terms) - before)
                if len(ids) >= BLOCK_DOCS or len(terms) >= BLOCK_POSTINGS:
                    yield block()
                    for x in (ids, sizes, lengths, terms, counts):
                        x.clear()
        if ids:
            yield block()

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(build, _BLOCK)


def document_frequencies(blocks: DataFrame, vocabulary: int) -> DataFrame:
    """``term`` and ``df`` of each term of the vocabulary that a document of the blocks holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for terms in batch.column(0):
                total += np.bincount(np.frombuffer(terms.as_py(), "<i4"), minlength=vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])

    return blocks.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


class MaxTree:
    """For each range of documents and term the greatest part of a score that a document of the range has from the term.

    Level 0 are the documents themselves, a range of a level holds FANOUT of the level below. A level keeps the terms of a range together, so the bounds of all
    children of a range for a query are one sum over a slice.
    """

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray):
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.levels = [(starts, owner, terms, values)]
        while len(self.levels[-1][0]) - 1 > 1:
            starts, owner, terms, values = self.levels[-1]
            owner = owner // FANOUT
            order = np.lexsort((terms, owner))
            owner, terms, values = owner[order], terms[order], values[order]
            new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (terms[1:] != terms[:-1])]) if len(terms) else np.zeros(0, np.int64)
            owner, terms, values = owner[new], terms[new], np.maximum.reduceat(values, new) if len(new) else values[:0]
            ranges = -(-(len(starts) - 1) // FANOUT)
            self.levels.append((np.searchsorted(owner, np.arange(ranges + 1)), owner, terms, values))

    def children(self, level: int, node: int, asked: np.ndarray) -> tuple[int, np.ndarray]:
        """First child of a range, and the bounds of all its children: the sums of their maxima over the terms asked for."""
        starts, owner, terms, values = self.levels[level - 1]
        first = node * FANOUT
        last = min(first + FANOUT, len(starts) - 1)
        at = slice(starts[first], starts[last])
        hit = np.flatnonzero(asked[terms[at]])
        # sums stay far below 2 ** 53, so they are exact
        return first, np.bincount(owner[at][hit] - first, values[at][hit], last - first).astype(np.int64)

    def best(self, asked: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """(score, place) of the k best documents of those that score ``floor`` or more and more than 0, ties to the smaller place.

        The range with the greatest bound is opened first; of equal bounds the one with the smallest places, whether it is a document or a range, so a tie
        is never decided while a range could still hold a smaller place. What is below the k-th score known so far is not kept.
        """
        known = [floor] * k  # a heap of the k best scores seen
        floor = max(floor, 1)
        top = len(self.levels) - 1
        queue: list[tuple[int, int, int]] = []
        first, bounds = self.children(top, 0, asked) if top else (0, np.bincount(self.levels[0][1], self.levels[0][3] * asked[self.levels[0][2]], 1).astype(np.int64))
        level = top - 1 if top else 0
        out: list[tuple[int, int]] = []
        while True:
            keep = np.flatnonzero(bounds >= floor)
            if level == 0:
                for c in keep.tolist():
                    if (score := int(bounds[c])) >= known[0]:
                        heappushpop(known, score)
                        heappush(queue, (-score, first + c, 0))
                floor = max(floor, known[0])
            else:
                for c in keep.tolist():
                    heappush(queue, (-int(bounds[c]), (first + c) * FANOUT**level, level))
            while True:
                if not queue or -queue[0][0] < floor or len(out) == k:
                    return out
                bound, place, level = heappop(queue)
                if level:
                    break
                out.append((-bound, place))
            first, bounds = self.children(level, place // FANOUT**level, asked)
            level -= 1


def _parts(starts: np.ndarray, sizes: np.ndarray, counts: np.ndarray, weights: np.ndarray, terms: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What each term adds to the score of a document."""
    mean = 100 - 90 + (90 * sizes * docs) // total
    tf = counts.astype(np.int64)
    return weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(mean, np.diff(starts))))


def term_weight(docs: int, df: int) -> int:
    """Rarity of a term that df of so many documents hold."""
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _search(blocks: DataFrame, queries: list[tuple[int, np.ndarray]], weights: np.ndarray, docs: int, total: int, k: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.zeros(len(weights), dtype=bool)
        best: list[list[tuple[int, int]]] = [[] for _ in queries]  # (-score, id), the k best of this task so far
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, starts, terms, counts = (np.frombuffer(batch.column(c)[row].as_py(), t) for c, t in enumerate(("<i8", "<i8", "<i8", "<i4", "<i4")))
                if not len(ids):
                    continue
                starts = starts[: len(ids) + 1]
                sizes, terms, counts = sizes[: len(ids)], terms[: starts[-1]], counts[: starts[-1]]
                tree = MaxTree(starts, terms, _parts(starts, sizes, counts, weights, terms, docs, total))
                for found, (_, numbers) in zip(best, queries, strict=True):
                    asked[numbers] = True
                    new = tree.best(asked, k, -found[-1][0] if len(found) == k else 0)
                    asked[numbers] = False
                    found[:] = sorted([*found, *((-score, int(ids[place])) for score, place in new)])[:k]
        rows = [(item, doc, -score) for (item, _), found in zip(queries, best, strict=True) for score, doc in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["__query", "doc_id", "score"])

    return blocks.select("ids", "sizes", "starts", "terms", "counts").mapInArrow(search, "__query long, doc_id long, score long")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """The k documents that score highest for each query: ``query_id``, ``rank`` (from 1), ``doc_id`` and ``score``.

    A term's part of a score grows with its count in the document, falls with the document's size and weighs as much as the term is rare; a score is the sum over the query's distinct
    terms, in whole numbers. Documents with score 0 are not returned; equal scores go by ascending id.

    The documents are read once a pass, and become blocks of counts of those terms that the queries of the pass ask for; rarity and mean size come from all blocks.
    A block is a tree of maxima over ranges of documents. It is searched best first: the range with the highest sum of maxima is opened, ranges that cannot
    reach the k-th best score known to the task are never opened, ranges with equal bounds are opened in order of ids. So the result is exact. A task returns k rows a query.
    The vocabulary of a pass is bounded (PASS_TERMS, or one query's terms), so it may go to all tasks; more queries take more passes.

    A null text has no terms. Rows of equal ids stand each for itself, also among the queries, where each row gets its own ranks; documents without id count
    in the statistics and are not returned; a query with a null id is one like others. Queries without terms, or with terms that no document holds, have no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    asked = written(queries.select(F.col(query_id).alias("__id"), F.col(query_text).cast("string").alias("__text")).withColumn("__query", F.monotonically_increasing_id()), "search-queries")
    # a term takes a separator, so there are at most half as many as bytes and one more
    room = asked.agg(F.sum(F.octet_length("__text") / 2 + 1)).first()[0] or 0
    passes = max(1, math.ceil(room / PASS_TERMS))
    found: list[DataFrame] = []
    for turn in range(passes):
        own = [(r["__query"], sorted(t for t in set(terms_of(r["__text"])) if t)) for r in asked.where(F.pmod(F.xxhash64("__query"), F.lit(passes)) == turn).collect()]  # a bounded share of the queries
        vocabulary = {t: n for n, t in enumerate(sorted({t for _, terms in own for t in terms}))}
        if not vocabulary:
            continue
        blocks = written(index_blocks(docs, id_col, text_col, vocabulary), "search-index")
        size = blocks.agg(F.sum("docs"), F.sum("total")).first()
        if not size[0]:
            discard(blocks)
            break
        weights = np.full(len(vocabulary), term_weight(size[0], 0), dtype=np.int64)
        for r in document_frequencies(blocks, len(vocabulary)).collect():  # at most a row a term of the pass
            weights[r["term"]] = term_weight(size[0], r["df"])
        numbers = [(query, np.array([vocabulary[t] for t in terms], dtype=np.int64)) for query, terms in own if terms]
        best = Window.partitionBy("__query").orderBy(F.col("score").desc(), "doc_id")
        ranked = _search(blocks, numbers, weights, size[0], size[1], k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found.append(written(ranked, "search-ranks"))
        discard(blocks)
    if not found:
        return asked.limit(0).select(F.col("__id").alias(query_id), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.join(asked, "__query").select(F.col("__id").alias(query_id), "rank", "doc_id", "score")
