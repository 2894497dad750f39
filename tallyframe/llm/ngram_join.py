"""N-gram Jaccard join: blocked product of the document by n-gram incidence with itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from .blocks import give_back, roots
from .components import components
from .hot import hot_join
from .scratch import discard, sized_shuffles, written
from .shingles import mix, shingle_set

#: Documents of a block whose n-grams are counted together, and n-grams after which a block ends early.
BLOCK_DOCS, BLOCK_GRAMS = 4096, 500_000
#: N-grams of a block for each part, so that a row of a block and part holds some of them; at most MOST_GRAMS.
PART_GRAMS, MOST_GRAMS = 64, 8_000_000
#: Documents of a family that meet in one task; a family with more, or with more n-grams than FAMILY_GRAMS, meets in blocks of half as many documents.
FAMILY_DOCS, FAMILY_GRAMS = 1024, 2_000_000
#: Blocks that hold one n-gram up to which they are paired gram by gram.
FEW_BLOCKS = 64
#: Bytes of text for each part of the hash space; the keys of a part take about half as much.
PART_BYTES = 1 << 26
_HALF = np.uint64(1 << 63)


def least_common(n, percent: int):
    """Fewest n-grams that a set of n must share to reach the similarity with any set (Column or array)."""
    return -(-n * percent // 100)


def _signature(h: np.ndarray) -> tuple[int, int]:
    """Two sums over a set: equal sets have equal ones."""
    return tuple(int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (h, mix(h ^ np.uint64(0x5851F42D4C957F2D))))


def _parts(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys by part (low bits), and where each part begins."""
    part = (keys & np.uint64(parts - 1)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _among(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(keys), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys


def half_incidence(docs: DataFrame, id_col: str, text_col: str, words: int, parts: int) -> DataFrame:
    """Per block of documents and part of the hash space: keys of the lower half of all n-grams and their holders.

    A key that several documents of a block hold is sent once, without holder: that it is
    shared is known. So an n-gram that all documents hold costs a few bytes a block. One row a block (``ids`` not null) describes its documents.
    """
    most = max(BLOCK_GRAMS, min(MOST_GRAMS, PART_GRAMS * parts))
    most_docs = min(60_000, BLOCK_DOCS * most // BLOCK_GRAMS)  # places in a block take 16 bits

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 24

        def block(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            low = [h[: np.searchsorted(h, _HALF)] for h in sets]
            holder = np.repeat(np.arange(len(sets)), [len(h) for h in low])
            keys, first, where, counts = np.unique(np.concatenate(low), return_index=True, return_inverse=True, return_counts=True)
            local = np.bincount(holder[counts[where] > 1], minlength=len(sets))
            sent = np.where(counts > 1, 0xFFFF, holder[first]).astype("<u2")
            order, starts = _parts(keys, parts)
            short, sent = (keys >> np.uint64(31)).astype("<u4")[order], sent[order]
            used = np.flatnonzero(np.diff(starts))
            signs = [_signature(h) for h in sets]
            about = np.stack([np.array([len(h) for h in sets]), np.array([len(h) for h in low]), local, np.array([s[0] for s in signs]), np.array([s[1] for s in signs])]).astype("<i8")
            none = [None] * len(used)
            # the row that describes the block goes to a part by a hash, as blocks of all partitions have numbers with the same low bits
            home = int(mix(np.array([made], dtype=np.uint64))[0]) % parts
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([*used.tolist(), home], pa.int32()),
                    pa.array([made] * (len(used) + 1), pa.int64()),
                    pa.array([*(short[starts[p] : starts[p + 1]].tobytes() for p in used), None], pa.binary()),
                    pa.array([*(sent[starts[p] : starts[p + 1]].tobytes() for p in used), None], pa.binary()),
                    pa.array([*none, ids], pa.list_(pa.int64())),
                    pa.array([*none, about.tobytes()], pa.binary()),
                ],
                names=["part", "block", "keys", "holders", "ids", "about"],
            )

        ids: list = []
        sets: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                sets.append(shingle_set(text.as_py(), words))
                size += len(sets[-1])
                if len(ids) >= most_docs or size >= most:
                    yield block(ids, sets)
                    ids, sets, size, made = [], [], 0, made + 1
        if ids:
            yield block(ids, sets)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(incidence, "part int, block long, keys binary, holders binary, ids array<long>, about binary")


def shared_counts(incidence: DataFrame) -> DataFrame:
    """For each document: size of its set, of its lower half, n-grams of that half that others have too, signature."""

    def count(table):
        """One row for each block: places and counts of its documents' n-grams that are shared in this part, and what describes the block."""
        out: dict[str, list] = {"block": [], "places": [], "counts": [], "ids": [], "about": []}

        def row(*values):
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)

        plain = table.filter(pa.compute.is_valid(table["keys"]))
        if len(plain):
            keys, holders = ([np.frombuffer(k.as_buffer(), t) for k in plain[c]] for c, t in (("keys", "<u4"), ("holders", "<u2")))
            # sorting the keys alone takes a fraction of the memory of telling where each stands
            every = np.concatenate(keys)
            every.sort()
            shared = every[1:][every[1:] == every[:-1]]
            shared = shared[np.flatnonzero(np.r_[True, shared[1:] != shared[:-1]])] if len(shared) else shared
            del every
            for k, block in enumerate(plain["block"].to_pylist()):
                single = np.flatnonzero(holders[k] != 0xFFFF)
                own = holders[k][single[_among(keys[k][single], shared)]]
                if len(own):
                    places, n = np.unique(own, return_counts=True)
                    row(block, places.astype("<u2").tobytes(), n.astype("<u4").tobytes(), None, None)
        for r in table.filter(pa.compute.is_valid(table["ids"])).to_pylist():
            row(r["block"], None, None, r["ids"], r["about"])
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()), strict=True)})

    def total(table):
        """Sums over the parts: a row for each document of the block."""
        ids, about, found = [], None, []
        for r in table.to_pylist():
            if r["about"] is None:
                found.append((np.frombuffer(r["places"], "<u2"), np.frombuffer(r["counts"], "<u4")))
            else:
                ids, about = r["ids"], np.frombuffer(r["about"], "<i8").reshape(5, -1)
        shared = about[2].copy()
        for places, n in found:
            shared[places] += n
        return pa.table({"shared": pa.array(shared), "id": pa.array(ids, pa.int64()), **{c: pa.array(about[k]) for c, k in (("n", 0), ("half", 1), ("s1", 3), ("s2", 4))}})

    counted = incidence.groupBy("part").applyInArrow(count, "block long, places binary, counts binary, ids array<long>, about binary")
    return counted.groupBy("block").applyInArrow(total, "shared long, id long, n long, half long, s1 long, s2 long")


def candidate_blocks(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Blocks of whole n-gram sets of the wanted documents: block, reps (numbers of the classes), n, grams (one after another)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 24

        def block(reps: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
            grams = np.concatenate(found).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([reps], pa.list_(pa.int64())), pa.array([[len(h) for h in found]], pa.list_(pa.int32())), pa.array([grams.astype("<i8").tobytes()], pa.binary())], names=["block", "reps", "n", "grams"])

        reps: list[int] = []
        found: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                h = shingle_set(row[text_col], words)
                if (len(h), *_signature(h)) == (row["n"], row["s1"], row["s2"]):
                    reps.append(row["cid"])
                    found.append(h)
                    size += len(h)
                    if len(reps) >= BLOCK_DOCS or size >= BLOCK_GRAMS:
                        yield block(reps, found)
                        reps, found, size, made = [], [], 0, made + 1
        if reps:
            yield block(reps, found)

    joined = docs.select(F.col(id_col).cast("long").alias("rep"), text_col).join(wanted, "rep").select("cid", text_col, "n", "s1", "s2")
    return joined.mapInArrow(sets, "block long, reps array<long>, n array<int>, grams binary")


def block_frequencies(blocks: DataFrame, parts: int) -> DataFrame:
    """For each block the n-grams that several candidates hold and in how many (capped at 2**31): block, keys, df."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = np.unique(np.frombuffer(grams, "<u8"), return_counts=True)
                order, starts = _parts(keys, parts)
                keys, counts = keys[order].astype("<u8"), counts[order].astype("<u4")
                used = np.flatnonzero(np.diff(starts))
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()), pa.array([keys[starts[p] : starts[p + 1]].tobytes() for p in used], pa.binary()), pa.array([counts[starts[p] : starts[p + 1]].tobytes() for p in used], pa.binary())], names=["part", "block", "keys", "counts"])

    def total(table):
        keys = [np.frombuffer(k, "<u8") for k in table["keys"].to_pylist()]
        counts = np.concatenate([np.frombuffer(k, "<u4") for k in table["counts"].to_pylist()])
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        df = np.minimum(np.bincount(where, counts)[where], 1 << 31).astype("<u4")
        at = np.cumsum([0, *map(len, keys)])
        blocks_, sent, dfs = [], [], []
        for k, block in enumerate(table["block"].to_pylist()):
            own = df[at[k] : at[k + 1]]
            if (own > 1).any():
                blocks_.append(block)
                sent.append(keys[k][own > 1].tobytes())
                dfs.append(own[own > 1].tobytes())
        return pa.table({"block": pa.array(blocks_, pa.int64()), "keys": pa.array(sent, pa.binary()), "df": pa.array(dfs, pa.binary())})

    sent = blocks.select("block", "grams").mapInArrow(out, "part int, block long, keys binary, counts binary")
    return sent.groupBy("part").applyInArrow(total, "block long, keys binary, df binary")


def reachable(blocks: DataFrame, frequencies: DataFrame, percent: int) -> DataFrame:
    """Candidates that share enough n-grams with others to link at all: rep, n, grams (shared ones), prefix.

    In the order of frequency, rarest first, a linked pair shares one of the first n - least + 1
    n-grams of either set. Those that no other set has come first and need not be listed.
    """

    def keep(left, right):
        out: dict[str, list] = {"rep": [], "n": [], "grams": [], "prefix": []}
        if len(right):
            keys = np.concatenate([np.frombuffer(k, "<u8") for k in right["keys"].to_pylist()])
            df = np.concatenate([np.frombuffer(k, "<u4") for k in right["df"].to_pylist()])
            order = np.argsort(keys)
            keys, df = keys[order], df[order]
            for row in left.to_pylist():
                grams, at = np.frombuffer(row["grams"], "<u8"), 0
                for rep, n in zip(row["reps"], row["n"], strict=True):
                    h = grams[at : at + n]
                    at += n
                    k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    h, f = h[keys[k] == h], df[k[keys[k] == h]]
                    first = len(h) - least_common(n, percent) + 1
                    if first > 0:
                        out["rep"].append(rep)
                        out["n"].append(n)
                        out["grams"].append(h.astype("<u8").tobytes())
                        out["prefix"].append(h[np.lexsort((h, f))[:first]].astype(np.int64))
        return pa.table({"rep": pa.array(out["rep"], pa.int64()), "n": pa.array(out["n"], pa.int32()), "grams": pa.array(out["grams"], pa.binary()), "prefix": pa.array(out["prefix"], pa.list_(pa.int64()))})

    return blocks.groupBy("block").cogroup(frequencies.groupBy("block")).applyInArrow(keep, "rep long, n int, grams binary, prefix array<long>")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections: incidence times its transpose, n-gram by n-gram.

    N-grams in few sets add to the pairs of their holders; those in many are columns of a dense matrix, multiplied some at a time.
    """
    n = len(sets)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    holder = np.repeat(np.arange(n, dtype=np.int32), [len(h) for h in sets])[order]
    every = every[order]
    del order
    starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1], True]) if len(every) else np.zeros(1, dtype=np.int64)
    del every
    counts = np.diff(starts)
    total = np.zeros((n, n), dtype=np.int32)  # the smaller of two sets has no more n-grams than that
    for size in range(2, min(16, n) + 1):
        rows = holder[starts[np.flatnonzero(counts == size)][:, None] + np.arange(size)].astype(np.int64)
        for a in range(size):
            for b in range(a + 1, size):
                if len(rows) > n * n // 64:
                    total += np.bincount(rows[:, a] * n + rows[:, b], minlength=n * n).reshape(n, n).astype(np.int32)
        if 0 < len(rows) <= n * n // 64:
            a, b = np.triu_indices(size, 1)
            np.add.at(total, (rows[:, a].ravel(), rows[:, b].ravel()), 1)
    total += total.T
    many = np.flatnonzero(counts > 16)
    for at in range(0, len(many), 2048):
        columns = many[at : at + 2048]
        dense = np.zeros((n, len(columns)), dtype=np.float32)
        for k, c in enumerate(columns):
            dense[holder[starts[c] : starts[c + 1]], k] = 1
        total += (dense @ dense.T).astype(np.int32)  # at most 2048 each: exact
    return total


def _chunked(member: DataFrame) -> DataFrame:
    """Sets of large families with their size class ``c`` and their chunk: sets with one least n-gram in the prefix come into one chunk, in several if they are many."""
    ratio = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))).cast("int")
    classed = member.withColumns({"c": ratio, "k": F.array_min(F.transform("prefix", lambda g: F.xxhash64(g)))})
    pieces = lambda docs, grams: F.greatest(F.ceil(docs * 2 / FAMILY_DOCS), F.ceil(grams / BLOCK_GRAMS)).cast("long")
    key, room = ["family", "c", "k"], ["family", "c"]
    by_key = written(classed.groupBy(*key).agg(pieces(F.count("*"), F.sum("n")).alias("own"), F.count("*").alias("docs"), F.sum("n").alias("grams")), "family-keys")
    # keys of few documents share as many chunks as they fill
    light = F.col("own") <= 1
    filled = lambda c: F.sum(F.when(light, F.col(c)).otherwise(0))
    shared = by_key.groupBy(*room).agg(F.greatest(pieces(filled("docs"), filled("grams")), F.lit(1)).alias("count"), F.count("*").alias("many"))
    places = hot_join(by_key, shared, room, "many", by_key.count()).select(*key, "own", "count", "docs")
    chunk = F.when(light, F.xxhash64("family", "c", F.pmod("k", "count"))).otherwise(F.xxhash64("family", "c", "k", F.pmod(F.xxhash64("rep"), F.col("own"))))
    return written(hot_join(classed, places, key, "docs", classed.count()).select("rep", "n", "grams", "prefix", "family", "c", chunk.alias("chunk")), "family-chunks")


def _chunk_pairs(chunked: DataFrame) -> DataFrame:
    """Pairs of chunks of one family (each with itself, too) that may hold a linked pair: of one size class or of neighbouring ones, and with a common n-gram among their prefixes.

    N-grams in more than FEW_BLOCKS chunks would give the same pairs again and again: chunks that have any such n-gram are all paired with each other, once, over a grid.
    """
    entries = written(chunked.select("family", "c", "chunk", F.explode("prefix").alias("gram")).distinct(), "family-entries")
    spread = entries.groupBy("family", "gram").agg(F.count("*").alias("blocks")).withColumn("many", F.col("blocks") > FEW_BLOCKS)
    marked = hot_join(entries, spread, ["family", "gram"], "blocks", entries.count())
    listed = marked.where("not many").select("family", "c", "chunk", "gram")
    one, two = (listed.select("family", "gram", F.col("c").alias(f"c{k}"), F.col("chunk").alias(x)) for k, x in ((1, "a"), (2, "b")))
    met = one.join(two, ["family", "gram"]).where("(c1 = c2 and a <= b) or c1 + 1 = c2").select("family", "a", "b")
    hubs = written(marked.where("many").select("family", "c", "chunk").distinct(), "family-hubs")
    return written(met.unionByName(_hub_pairs(hubs)).distinct(), "family-pairs")


def _hub_pairs(hubs: DataFrame) -> DataFrame:
    """Pairs of chunks of one size class, and of one with the next, over a grid: chunks of a class are dealt into groups of about FEW_BLOCKS, and a pair of groups is the key under which chunks meet.

    So the pairs of a family, whatever their number, come out of many tasks, a few thousand from each key.
    """
    sized = hubs.groupBy("family", "c").agg(F.ceil(F.count("*") / FEW_BLOCKS).cast("int").alias("groups"), F.count("*").alias("many"))
    sized = written(sized, "family-groups")
    beside = lambda by, name: sized.select("family", (F.col("c") + by).alias("c"), F.col("groups").alias(name))
    around = sized.join(beside(-1, "above"), ["family", "c"], "left").join(beside(1, "below"), ["family", "c"], "left")
    own = hot_join(hubs, around, ["family", "c"], "many", hubs.count()).withColumn("own", F.pmod(F.xxhash64("chunk"), F.col("groups")).cast("int"))
    of = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    this, below = F.col("c"), F.col("c") - 1
    left = [own.where(f"{name} is not null").select("family", this.alias("c1"), (this + up).alias("c2"), F.col("own").alias("i"), of(name).alias("j"), F.col("chunk").alias("a")) for name, up in (("groups", 0), ("above", 1))]
    right = [own.where(f"{name} is not null").select("family", first.alias("c1"), this.alias("c2"), of(name).alias("i"), F.col("own").alias("j"), F.col("chunk").alias("b")) for name, first in (("groups", this), ("below", below))]
    met = left[0].unionByName(left[1]).join(right[0].unionByName(right[1]), ["family", "c1", "c2", "i", "j"])
    return met.where("c1 < c2 or a <= b").select("family", "a", "b")


def family_blocks(alive: DataFrame, families: DataFrame) -> DataFrame:
    """Sets with the block (``family``, ``a``, ``b``) in which they meet: all of a small family in one, a large one chunk by chunk.

    Linked sets' sizes differ by less than a third, so with classes of that ratio they are of one class or
    of neighbouring ones, and they share an n-gram of both their prefixes; other pairs of chunks are never formed.
    """
    member = alive.join(families.select(F.col("id").alias("rep"), F.col("component").alias("family")), "rep")
    member = written(member, "family-sets")
    sizes = member.groupBy("family").agg(((F.count("*") > FAMILY_DOCS) | (F.sum("n") > FAMILY_GRAMS)).alias("large")).where("large").select("family")
    small = member.join(sizes, "family", "left_anti").select("rep", "n", "grams", "family", F.col("family").alias("a"), F.col("family").alias("b"))
    large = written(member.join(sizes, "family", "left_semi"), "family-large")
    with sized_shuffles(large.sparkSession, large.count()):
        chunked = _chunked(large)
        pairs = _chunk_pairs(chunked)
    left = chunked.join(pairs, (chunked["family"] == pairs["family"]) & (chunked["chunk"] == pairs["a"])).drop(chunked["family"])
    right = chunked.join(pairs.where("a <> b"), (chunked["family"] == pairs["family"]) & (chunked["chunk"] == pairs["b"])).drop(chunked["family"])
    return small.unionByName(left.select(*small.columns)).unionByName(right.select(*small.columns))


def block_links(blocks: DataFrame, percent: int) -> DataFrame:
    """Links within each block, as links of each set to the smallest id of those that it reaches there."""

    def link(table):
        order = np.argsort(table["rep"].to_numpy(), kind="stable")
        rep, n = table["rep"].to_numpy()[order], table["n"].to_numpy()[order].astype(np.int64)
        grams = table["grams"].to_pylist()
        common = overlaps([np.frombuffer(grams[k], "<u8") for k in order])
        del grams
        found = []
        for at in range(0, len(rep), 64):  # some rows of the matrix at a time: a block's task holds no second one
            some = common[at : at + 64].astype(np.int64)
            i, j = np.nonzero((some * (100 + percent) >= percent * (n[at : at + 64, None] + n[None, :])) & (some > 0))
            i += at
            found.append((i[i < j].astype(np.int32), j[i < j].astype(np.int32)))
        del common
        low = roots(len(rep), *(np.concatenate(x) for x in zip(*found, strict=True)))
        give_back()
        some = np.flatnonzero(low < np.arange(len(rep)))
        return pa.table({"a": pa.array(rep[some], pa.int64()), "b": pa.array(rep[low[some]], pa.int64())})

    return blocks.groupBy("family", "a", "b").applyInArrow(link, "a long, b long")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of their word n-grams of ``percent`` / 100 or more.

    Returns a row for each row of ``docs``: id, ``n_shingles`` and ``component_id``, the smallest id that links reach.
    No link is lost: every step drops only what cannot link.

    1. Documents with equal sets are one class. A document must share all but a quarter of its n-grams with others;
       over the lower half of the hash space, that drops most documents.
    2. Among the classes left, the same over all n-grams; then each is listed under its rarest n-grams
       (as many as a linked set cannot all miss), and classes with a common entry form a family.
    3. The sets of a family meet in blocks: those of a large one by size class and chunk, and only chunks with a common entry. There the product of the incidence matrix with its transpose gives all
       overlaps; pairs below the bound that their sizes set are dropped. Blocks return a spanning forest of their links, not the pairs.

    Words are runs of anything but six white-space characters, A-Z lower-cased; a text of fewer than ``words`` words has one
    n-gram, a text without words or null has none and links with nothing. Rows with equal id are compared
    row by row, each by its own text; a row with a null id has itself (null) as component. Sets are compared
    by 64-bit hashes of their n-grams, classes by their size and two sums of these (128 bits); each class has a number of its own.
    """
    parts = 16
    stored = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    while parts * PART_BYTES < stored:
        parts *= 2
    about = written(shared_counts(half_incidence(docs, id_col, text_col, words, parts)), "ngram-documents")
    key = ["n", "s1", "s2"]
    classes = written(about.where("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("rep"), F.first("half").alias("half"), F.max("shared").alias("shared"), F.count("*").alias("copies")).withColumn("cid", F.monotonically_increasing_id()), "ngram-classes")
    wanted = classes.where(F.col("shared") >= F.col("half") - (F.col("n") - F.ceil(F.col("n") * percent / 100))).select("rep", "cid", *key)
    blocks = written(candidate_blocks(docs, wanted, id_col, text_col, words), "ngram-blocks")
    alive = written(reachable(blocks, block_frequencies(blocks, parts), percent).dropDuplicates(["rep"]), "ngram-alive")
    discard(blocks)
    listed = alive.select("rep", F.explode("prefix").alias("gram"))
    heads = listed.groupBy("gram").agg(F.min("rep").alias("b"), F.count("*").alias("many")).where("many > 1")
    entries = alive.agg(F.sum(F.size("prefix"))).first()[0] or 0
    families = written(components(hot_join(listed, heads, ["gram"], "many", entries).select(F.col("rep").alias("a"), "b").distinct()), "ngram-families")
    links = written(block_links(family_blocks(alive, families), percent), "ngram-links")
    discard(alive, families)
    joined = components(links).withColumnRenamed("id", "cid")
    grouped = written(classes.select(*key, "rep", "cid", "copies").join(joined, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "ngram-grouped")
    smallest = grouped.groupBy("component").agg(F.min("rep").alias("smallest"))
    labelled = written(grouped.join(smallest, "component").select(*key, "copies", F.col("smallest").alias("component")), "ngram-labelled")
    discard(classes, links, grouped)
    out = hot_join(about, labelled, key, "copies", about.count(), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id")).alias("component_id"))
