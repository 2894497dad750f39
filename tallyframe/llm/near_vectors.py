"""Embedding near-dedup by a pivot-permutation index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import roots
from .components import components
from .scratch import discard, written

#: Rows of a list that meet in one task.
LIST_ROWS = 4096
#: Most pivots that are fitted, and pivots for the square root of the number of vectors.
MOST_PIVOTS, PIVOTS_PER_ROOT = 4096, 4
#: Vectors from which a pivot is chosen.
CANDIDATES = 8


def nearest_pivots(v: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest pivots of each row by cosine, nearest first; equal ones by number."""
    width = min(v.shape[1], pivots.shape[1])
    near = v[:, :width] @ pivots[:, :width].T
    return np.argsort(-near, axis=1, kind="stable")[:, :k].astype(np.int32)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow of squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def spread(v: np.ndarray, k: int, limit: float) -> np.ndarray:
    """Numbers of at most k rows, each the farthest from those before it, until none has cosines under ``limit`` to all of them."""
    nearest, chosen = v @ v[0], [0]
    while len(chosen) < k:
        at = int(np.argmin(nearest))
        if nearest[at] >= limit:
            break
        chosen.append(at)
        nearest = np.maximum(nearest, v @ v[at])
    return np.array(chosen)


def shared_pivots(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many pivots each row of ``left`` shares with each of ``right``: for each pivot, one more for all pairs of its holders."""
    counts = np.zeros((len(left), len(right)), dtype=np.uint8 if near.shape[1] < 256 else np.int32)
    holders = []
    for rows in (left, right):
        owner, pivot = np.repeat(np.arange(len(rows)), near.shape[1]), near[rows].ravel()
        order = np.argsort(pivot, kind="stable")
        numbers, starts = np.unique(pivot[order], return_index=True)
        holders.append(dict(zip(numbers.tolist(), np.split(owner[order], starts[1:]), strict=True)))
    for pivot, a in holders[0].items():
        b = holders[1].get(pivot)
        if b is not None:
            counts[a[:, None], b] += 1
    return counts


def linked_in_list(v: np.ndarray, near: np.ndarray, prefix: int, pivot: int, left: np.ndarray, right: np.ndarray, shared: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs of rows (left, right) among those of one pivot's list.

    Shared pivots are counted first; only pairs that share ``shared`` of them are verified by
    cosine. A pair that meets in several lists, of pivots among the first ``prefix`` of both, is verified in that of the smallest only.
    """
    found_i, found_j = [], []
    for at in range(0, len(left), 1024):
        rows = left[at : at + 1024]
        i, j = np.nonzero(shared_pivots(near, rows, right) >= shared)
        i, j = rows[i], right[j]
        i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 20_000):
            a, b = i[part : part + 20_000], j[part : part + 20_000]
            one, two = near[a, :prefix], near[b, :prefix]
            earlier = ((one[:, :, None] == two[:, None, :]) & (one[:, :, None] < pivot)).any(axis=(1, 2))  # met in a list before this one
            a, b = a[~earlier], b[~earlier]
            linked = np.einsum("ij,ij->i", v[a], v[b]) >= threshold
            found_i.append(a[linked])
            found_j.append(b[linked])
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *found_i]), np.concatenate([empty, *found_j])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label", threshold: float = 0.93, pivots: int | None = None, nearest: int = 16, prefix: int = 8, shared: int = 3) -> DataFrame:
    """Near-duplicates among vectors of equal, non-null group.

    At most ``pivots`` reference points are fitted (PIVOTS_PER_ROOT times the square root of the number of vectors unless given, from 64
    to MOST_PIVOTS, so that lists stay short): of CANDIDATES times as many vectors, those of the smallest hash of the id, the farthest from
    one another, as long as they are more than two links' angles apart. So a group of near copies has about one pivot
    of its own, and its vectors are told by their order of far pivots as others are; a table that is one such group
    has one pivot, and all its pairs are verified. Every vector is indexed. It is described by its ``nearest`` nearest
    pivots in order, and stands in the inverted lists of the first ``prefix`` of them: linked vectors have one in common there, while those further
    back change places more. Pairs in a list that share ``shared`` of all their pivots (or all, if there are fewer) are
    verified by cosine in double precision. Lists beyond LIST_ROWS are cut into chunks, every two of which meet
    in some task, so nothing is dropped. Equal vectors of a group are
    one vector of the index, with their number as its weight; each has a number of its own, and is told by 128 bits of hashes.

    Returns a row for each row of ``vectors``: id, ``n_links`` (other rows linked directly), ``component_id`` (smallest id
    reachable by links) and ``kept`` (id = component_id). Vectors that are null, empty or zero, or have null or non-finite
    components, and rows with a null group or id link with nothing; neither do vectors of different length.
    Rows with equal ids count as several rows, each by its own vector.
    """
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    sound = F.col(id_col).isNotNull() & F.col(group_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = written(
        vectors.select(F.col(id_col).alias("id"), F.when(F.coalesce(sound, F.lit(False)), F.struct(F.xxhash64(group_col, vec_col).alias("h1"), F.xxhash64(F.lit(1), group_col, vec_col).alias("h2"), F.col(group_col).cast("string").alias("grp"), x.alias("v"))).alias("s"))
        .select("id", "s.h1", "s.h2", "s.grp", "s.v"),
        "vectors",
    )
    classes = written(rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("size")).withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    firsts = rows.where("h1 is not null").select("id", "h1", "h2", "grp", "v").join(classes, ["h1", "h2"]).where("id = rep").dropDuplicates(["cid"]).select("cid", "size", F.concat_ws(":", F.size("v"), "grp").alias("grp"), "v")
    firsts = written(firsts, "vector-firsts")
    pivots = pivots or min(MOST_PIVOTS, max(64, PIVOTS_PER_ROOT * math.isqrt(firsts.count())))
    # not the numbers, which depend on where rows stand, but the vectors decide which are candidates
    fitted = [c.values.to_numpy() for c in firsts.orderBy(F.xxhash64("v"), "cid").limit(CANDIDATES * pivots).select("v").toArrow()["v"]]
    if not fitted:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    width = max(map(len, fitted))
    reference = unit(np.array([np.pad(v, (0, width - len(v))) for v in fitted]))
    apart = math.cos(min(math.pi, 2 * math.acos(max(-1.0, min(1.0, threshold)))))
    reference = reference[spread(reference, pivots, apart)]
    nearest, prefix, least = (min(k, len(reference)) for k in (nearest, prefix, shared))
    # components of single precision are sent as such; all is computed in double precision
    single = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vs = [c.values.to_numpy() for c in batch.column(3)]
                sizes = np.array([len(v) for v in vs])
                near = np.zeros((len(vs), nearest), dtype="<i4")
                for size in np.unique(sizes):
                    same = np.flatnonzero(sizes == size)
                    for at in range(0, len(same), 512):
                        near[same[at : at + 512]] = nearest_pivots(unit(np.stack([vs[k] for k in same[at : at + 512]])), reference, nearest)
                columns = [*(batch.column(k) for k in range(3)), pa.array([v.astype(single).tobytes() for v in vs], pa.binary()), pa.array([n.tobytes() for n in near], pa.binary()), pa.array(near[:, :prefix].tolist(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["cid", "size", "grp", "data", "near", "lists"])

    described = written(firsts.mapInArrow(describe, "cid long, size long, grp string, data binary, near binary, lists array<int>"), "vector-described")
    discard(firsts)
    listed = described.withColumn("pivot", F.explode("lists")).drop("lists")
    lengths = described.select("grp", F.explode("lists").alias("pivot")).groupBy("grp", "pivot").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("chunks"))
    n = F.col("chunks")
    chunked = listed.join(lengths, ["grp", "pivot"]).withColumn("chunk", F.pmod(F.xxhash64("cid"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    blocks = chunked.select("cid", "size", "grp", "data", "near", "pivot", "chunk", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"))

    def link(key, table):
        _, pivot, c1, c2 = (k.as_py() for k in key)
        order = np.argsort(table["cid"].to_numpy(), kind="stable")
        ids, size, chunk = (table[c].to_numpy()[order] for c in ("cid", "size", "chunk"))
        data, near = (np.frombuffer(b"".join(table[c].take(pa.array(order)).to_pylist()), t).reshape(len(ids), -1) for c, t in (("data", single), ("near", "<i4")))
        v, near = unit(data.astype(np.float64)), near.astype(np.int64)
        everyone = np.arange(len(ids))
        if c1 == c2:
            i, j = linked_in_list(v, near, prefix, pivot, everyone, everyone, least, threshold)
        else:
            a, b = everyone[chunk == c1], everyone[chunk == c2]
            i, j = (np.concatenate(p) for p in zip(linked_in_list(v, near, prefix, pivot, a, b, least, threshold), linked_in_list(v, near, prefix, pivot, b, a, least, threshold), strict=True))
        n = np.bincount(i, size[j], minlength=len(ids)) + np.bincount(j, size[i], minlength=len(ids))
        low = roots(len(ids), i, j)
        some = np.flatnonzero(n > 0)
        return pa.table({"a": pa.array(ids[some], pa.int64()), "b": pa.array(ids[low[some]], pa.int64()), "n": pa.array(n[some].astype(np.int64))})

    links = written(blocks.groupBy("grp", "pivot", "c1", "c2").applyInArrow(link, "a long, b long, n long"), "vector-links")
    discard(described)
    joined = components(links.select("a", "b"))
    numbers = links.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    # a component goes by the smallest number in it, then by the smallest id
    counted = classes.join(numbers, "cid", "left").join(joined.withColumnRenamed("id", "cid"), "cid", "left")
    grouped = written(counted.select("h1", "h2", "rep", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component")), "vector-grouped")
    discard(classes, links)
    smallest = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    labelled = grouped.join(smallest, "component").select("h1", "h2", "n_links", "component_id")
    out = rows.select("id", "h1", "h2").join(labelled, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
