"""Exact top-k search by inner product: term at a time, exhaustive."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import written

#: Rows of a block of queries and of a block of candidates: 512 x 4096 scores of 8 bytes are 16 MB.
QUERY_ROWS, CANDIDATE_ROWS = 512, 4096
#: Blocks of queries and of candidates that meet in one cell of the grid, at most: all pairs of them are one task's work.
QUERY_BLOCKS, CANDIDATE_BLOCKS = 64, 32


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """Id and floor(scale * x) of each component; rows that are null or hold null or non-finite components go."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    sound = F.col(vec_col).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("v"))


def _blocks(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` rows by hash (ids and components as matrices in binary), and the number of blocks."""
    rows = written(rows, "topk-vectors")
    blocks = max(1, -(-rows.count() // size))

    def pack(table):
        vectors = table["v"].to_pylist()
        width = max(map(len, vectors))
        m = np.zeros((len(vectors), width), dtype="<i8")  # missing components count as zero
        for k, row in enumerate(vectors):
            m[k, : len(row)] = row
        # components are sent in as few bytes as hold all of the block
        size = next(b for b in (2, 4, 8) if not m.size or -(1 << 8 * b - 1) <= m.min() and m.max() < 1 << 8 * b - 1)
        return pa.table({"block": table["block"][:1], "ids": pa.array([table["id"].to_numpy().astype("<i8").tobytes()]), "m": pa.array([m.astype(f"<i{size}").tobytes()]), "width": pa.array([width], pa.int32()), "bytes": pa.array([size], pa.int32())})

    numbered = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    return numbered.groupBy("block").applyInArrow(pack, "block int, ids binary, m binary, width int, bytes int"), blocks


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the k best rows for each query, ties to the smaller id.

    One component at a time: the queries that have it scatter their weight times the postings of that component
    (its non-zero rows) into the score arrays. Partition selection then finds the k-th score; rows
    above it and the smallest ids at it stay.
    """
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    scores = np.zeros((len(queries), len(rows)), dtype=np.int64)
    for t in range(min(queries.shape[1], rows.shape[1])):
        having, posted = np.flatnonzero(queries[:, t]), np.flatnonzero(rows[:, t])
        if len(posted) > len(rows) // 2:
            for q in having:
                scores[q] += queries[q, t] * rows[:, t]
        else:
            for q in having:
                scores[q, posted] += queries[q, t] * rows[posted, t]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, own in enumerate(query_ids):
        s = scores[q]
        other = ids != own
        if not other.all():
            s, mine = s[other], ids[other]
        else:
            mine = ids
        if len(s) > k:
            at = np.partition(s, len(s) - k)[len(s) - k]
            above = np.flatnonzero(s > at)
            found = np.concatenate([above, np.flatnonzero(s == at)[: k - len(above)]])  # ids ascend
        else:
            found = np.arange(len(s))
        out.append((np.full(len(found), own), mine[found], s[found]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The k best rows of ``vectors`` for each row of ``queries`` by inner product of floor(scale * x).

    Blocks of queries and of rows are dealt over a grid: a cell gets up to QUERY_BLOCKS of the one and CANDIDATE_BLOCKS of the other by an equi-join on its number, so no cross join, and a block
    of rows is sent once for each QUERY_BLOCKS blocks of queries, not for each of them. A cell keeps k rows a query; the cells' results are merged by rank.
    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``. Ties go to the smaller id; a query never finds rows of its own id.
    Null vectors and those with null or non-finite components take no part, neither do null ids; where lengths differ, missing components
    count as zero. Products must fit 64 bits. Of queries of one id the smallest vector is asked, component by component;
    candidates of one id stand each for itself.
    """
    rows, n_rows = _blocks(integer_vectors(vectors, id_col, vec_col, scale).where("id is not null"), CANDIDATE_ROWS)
    asked, n_asked = _blocks(integer_vectors(queries, id_col, vec_col, scale).where("id is not null").groupBy("id").agg(F.min("v").alias("v")), QUERY_ROWS)
    down = -(-n_asked // QUERY_BLOCKS)
    # small tables are dealt over all cores
    across = min(n_rows, max(-(-n_rows // CANDIDATE_BLOCKS), vectors.sparkSession.sparkContext.defaultParallelism))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = asked.select("ids", "m", "width", "bytes", (F.col("block") % down).alias("i"), every(across).alias("j"))
    met = rows.select("ids", "m", "width", "bytes", every(down).alias("i"), (F.col("block") % across).alias("j"))

    def search(asked_blocks: pa.Table, row_blocks: pa.Table) -> pa.Table:
        read = lambda r: (np.frombuffer(r["m"], f"<i{r['bytes']}").astype(np.int64).reshape(-1, r["width"]) if r["width"] else np.zeros((len(r["ids"]) // 8, 0), "<i8"), np.frombuffer(r["ids"], "<i8"))
        found, held = [], [read(r) for r in row_blocks.to_pylist()]
        for q, ids in map(read, asked_blocks.to_pylist()):
            parts = [best_of_block(q, ids, *r, k) for r in held]
            if parts:
                query, vec, score = (np.concatenate(c) for c in zip(*parts, strict=True))
                order = np.lexsort((vec, -score, query))
                query, vec, score = query[order], vec[order], score[order]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                found.append((query[place < k], vec[place < k], score[place < k]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    merged = sent.groupBy("i", "j").cogroup(met.groupBy("i", "j")).applyInArrow(search, "query_id long, vec_id long, score long")
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
