"""N-gram join, embedding near-dedup, components and top-k against brute force."""

import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import hot
from tallyframe.llm.components import components
from tallyframe.llm.near_vectors import near_vectors
from tallyframe.llm.ngram_join import half_incidence, ngram_components, overlaps
from tallyframe.llm.shingles import shingle_set
from tallyframe.llm.topk import exact_top_k


def groups(ids, links):
    low = {i: i for i in ids}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def word_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i : i + min(n, len(words))]) for i in range(len(words) - min(n, len(words)) + 1)} if words else set()


def test_shingles():
    for text in ("", None, " \n", "One", "one two THREE", "a b c d e", "a b c d e f a b c d e", "É é x y z w v", "x" * 100_000 + " y"):
        assert len(shingle_set(text)) == len(word_set(text))
    assert (shingle_set("A  b\tc") == shingle_set("a b c")).all() and not np.isin(shingle_set("ab c"), shingle_set("a bc")).any()


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(70)] + [(500, k) for k in range(501, 540)] + [(900, 900)]
    want = groups({x for p in links for x in p}, links)
    got = components(spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long"))
    assert {x.id: x.component for x in got.collect()} == want


@pytest.mark.parametrize("share", [1, 20, 10_000])
def test_components_with_a_hub(spark, monkeypatch, share):
    monkeypatch.setattr(hot, "HOT_SHARE", share)
    monkeypatch.setattr(hot, "FEW_ROWS", 3)
    links = [(500, k) for k in range(300)] + [(0, k) for k in range(600, 800)] + [(900, 901), (901, 902), (950, 950)]
    got = components(spark.createDataFrame([*links, (None, 3)], "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == groups({x for ab in links for x in ab}, links)


@pytest.mark.parametrize("share", [1, 5, 10_000])
def test_hot_join(spark, monkeypatch, share):
    monkeypatch.setattr(hot, "HOT_SHARE", share)
    monkeypatch.setattr(hot, "FEW_ROWS", 3)
    rows = spark.createDataFrame([("a", k) for k in range(50)] + [("b", 50), ("c", 51), (None, 52)], "k string, v int")
    keyed = spark.createDataFrame([("a", 1, 50), ("b", 2, 1), ("d", 3, 0)], "k string, w int, many long")
    inner = sorted([(k, v, {"a": 1, "b": 2}[k]) for k, v in [*(("a", v) for v in range(50)), ("b", 50)]])
    assert sorted(map(tuple, hot.hot_join(rows, keyed, ["k"], "many", 53).collect())) == inner
    assert sorted(map(tuple, hot.hot_join(rows, keyed, ["k"], "many", 53, "left").where("w is not null").collect())) == inner
    assert hot.hot_join(rows, keyed, ["k"], "many", 53, "left").where("w is null").count() == 2


def test_overlaps():
    r = random.Random(1)
    sets = [np.unique(np.array([r.randrange(120) for _ in range(r.randrange(1, 80))], dtype=np.uint64)) for _ in range(60)]
    want = [[0 if i == j else len(np.intersect1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = overlaps(sets)
    np.fill_diagonal(got, 0)
    assert (got == np.array(want)).all()


def test_overlaps_take_little_memory():
    """A block of many documents and n-grams holds a few arrays of the n-grams and of its matrix, not a dozen."""
    r = np.random.default_rng(3)
    common = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, r.integers(0, 1 << 63, 300, dtype=np.uint64)])) for _ in range(1500)]
    tracemalloc.start()
    got = overlaps(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[3, 4] == got[4, 3] == len(np.intersect1d(sets[3], sets[4])) == 1000
    assert peak < 8 * sum(map(len, sets)) * 5  # bytes of the n-grams, five times



def test_ngram_join(spark, monkeypatch):
    from tallyframe.llm import ngram_join

    # small blocks, so that several meet; the functions are sent to workers by value of these defaults only in this process
    monkeypatch.setattr(ngram_join, "FAMILY_DOCS", 6)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 6)))
    texts, passage = [], " ".join(word() for _ in range(60))
    for _ in range(12):
        base = [word() for _ in range(r.randint(20, 90))]
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [passage + " " + " ".join(word() for _ in range(r.randint(5, 100))) for _ in range(15)] + [passage, passage.upper(), "a b", "A  b", "a b c", "", None, " \n ", "one"]
    base = [word() for _ in range(60)]
    for k in range(16):  # a chain: each differs a little from the one before
        base[(3 * k) % 60] = word()
        texts.append(" ".join(base))
    docs = [(i * 3 + 1, t, "x", 5) for i, t in enumerate(texts)] + [(None, passage, "x", 5), (1, texts[0], "x", 5)]
    twice = [(4, "this text has its own words only"), (4, "and so has this other one here")]
    sets = {i: word_set(t) for i, t, *_ in docs if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    got = ngram_components(spark.createDataFrame(docs, "doc_id long, text string, n string, rep int")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(spark.createDataFrame(twice, "doc_id long, text string")).collect()) == [(4, 3, 4), (4, 3, 4)]
    assert len(got) == len(docs)
    for row in got:
        if row.doc_id is None:
            assert row.component_id is None and row.n_shingles == len(word_set(passage))
        else:
            assert (row.n_shingles, row.component_id) == (len(sets[row.doc_id]), want[row.doc_id])


def test_blocks_of_many_partitions_are_dealt_over_parts(spark):
    docs = spark.range(640).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d e "), F.col("id").cast("string")).alias("text")).repartition(64)
    rows = half_incidence(docs, "doc_id", "text", 5, 64).where("ids is not null").groupBy("part").count().collect()
    assert sum(r["count"] for r in rows) == 64 and max(r["count"] for r in rows) <= 8 and len(rows) > 20


@pytest.mark.parametrize("few", [64, 1])
def test_ngram_join_of_a_chain_and_long_documents(spark, monkeypatch, few):
    """One long chain of near copies, families with a common rare passage, and documents of 20,000 words: small blocks, and all n-grams hubs in the second run."""
    from tallyframe.llm import ngram_join

    monkeypatch.setattr(ngram_join, "FAMILY_DOCS", 8)
    monkeypatch.setattr(ngram_join, "FAMILY_GRAMS", 30_000)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 25_000)
    monkeypatch.setattr(ngram_join, "FEW_BLOCKS", few)
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts, base = [], [word() for _ in range(70)]
    for k in range(120):  # each differs by one word from the one before; the ends have nothing in common
        base[k % 70] = word()
        texts.append(" ".join(base))
    passage = [word() for _ in range(30)]
    for _ in range(12):
        own = [word() for _ in range(40)]
        texts += [" ".join([*passage, *own]), " ".join([*passage, *own[:-1], word()]), " ".join([*own, *passage])]
    long = [word() for _ in range(20_000)]
    for _ in range(3):
        texts.append(" ".join(long))
        long[r.randrange(20_000)] = word()
    sets = {i: word_set(t) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    got = {x.doc_id: x.component_id for x in ngram_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) < 40


def test_links_of_long_documents_at_the_bound(spark):
    from tallyframe.llm.ngram_join import block_links

    # 100 * m = 75 * (size of the union) in whole numbers; 175 * m has no float32
    m, sizes = 100_011, (116_679, 116_680)
    assert 175 * m == 75 * sum(sizes)
    sets = [np.arange(m, dtype="<u8"), np.arange(m, dtype="<u8")]
    sets = [np.concatenate([x, np.arange(n - m, dtype="<u8") + 10**6 * (k + 1)]) for k, (x, n) in enumerate(zip(sets, sizes, strict=True))]
    for cut in (0, 1):
        rows = [(1, 0, 0, k, len(x), x.tobytes()) for k, x in enumerate([sets[0], np.append(sets[1][cut:], np.arange(cut, dtype="<u8") + 10**7)])]
        blocks = spark.createDataFrame(rows, "family long, a long, b long, rep long, n long, grams binary")
        assert [tuple(r) for r in block_links(blocks, 75).collect()] == ([] if cut else [(1, 0)])


def test_near_vectors(spark, monkeypatch):
    from tallyframe.llm import near_vectors as module

    monkeypatch.setattr(module, "LIST_ROWS", 40)
    rng = np.random.default_rng(2)
    rows, at = [], 0
    for label in (0, 1, 2):
        for _ in range(60):
            centre = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 4))):
                rows.append((at, (centre + rng.normal(scale=0.15, size=16)).astype(np.float32).tolist(), label))
                at += 1
    rows += [(at + k, rows[0][1], 0) for k in range(30)] + [(2000, rows[0][1], 1), (2001, rows[0][1], None), (2002, None, 0), (2003, [0.0] * 16, 0), (2004, [float("nan")] + [1.0] * 15, 0), (2005, [None] + [1.0] * 15, 0), (2006, [], 0), (None, rows[0][1], 0), (2007, rows[0][1][:8], 0)]
    rows.append(rows[5])
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, grp string")
    good = [(n, i, np.array(e, float), g) for n, (i, e, g) in enumerate(rows) if i is not None and g is not None and e and len(e) == 16 and None not in e and np.isfinite(e).all() and np.any(e)]
    v = np.stack([x[2] / np.linalg.norm(x[2]) for x in good])
    linked = (v @ v.T >= 0.93) & np.equal.outer([x[3] for x in good], [x[3] for x in good])
    np.fill_diagonal(linked, False)
    n_links = {(x[0]): int(linked[k].sum()) for k, x in enumerate(good)}
    comp = groups({r[0] for r in rows if r[0] is not None}, [(good[i][1], good[j][1]) for i, j in zip(*np.nonzero(linked))])
    got = near_vectors(table).collect()
    assert len(got) == len(rows)
    assert sum(r.n_links for r in got) >= 0.9 * sum(n_links.values())
    assert sorted((r.vec_id, r.n_links) for r in got if r.vec_id is not None) == sorted((rows[n][0], n_links.get(n, 0)) for n in range(len(rows)) if rows[n][0] is not None)
    assert all(r.component_id == comp[r.vec_id] and r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert near_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "share", "level", "rows"), [(6000, 1 / 3, 0.94, 4096), (3000, 1.0, 0.97, 500)])
def test_near_vectors_with_one_large_group_of_near_copies(spark, monkeypatch, n, share, level, rows):
    """Recall of links against brute force, with lists in one piece and in chunks."""
    from tallyframe.llm import near_vectors as module

    monkeypatch.setattr(module, "LIST_ROWS", rows)
    rng = np.random.default_rng(8)
    base, many = rng.normal(size=64), int(n * share)
    base /= np.linalg.norm(base)
    v = np.concatenate([base + rng.normal(scale=np.sqrt((1 / level - 1) / 64), size=(many, 64)), rng.normal(size=(n - many, 64))])[rng.permutation(n)]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = (v @ v.T >= 0.93).sum(axis=1) - 1
    got = near_vectors(spark.createDataFrame([(k, x.tolist(), 0) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")).collect()
    found = sum(r.n_links for r in got) / want.sum()
    print(f"recall of links {found:.4f} of {want.sum() // 2}")
    assert found >= 0.999 and all(r.n_links <= want[r.vec_id] for r in got)


def test_recall_at_the_threshold_over_chunked_lists(spark, monkeypatch):
    """Random pairs just above the threshold, in single precision: the hardest links for the order of pivots."""
    from tallyframe.llm import near_vectors as module

    monkeypatch.setattr(module, "LIST_ROWS", 64)
    rng = np.random.default_rng(3)
    a, o = rng.normal(size=(2, 1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(axis=1, keepdims=True) * a
    b = 0.932 * a + np.sqrt(1 - 0.932**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
    rows = [(k, x.astype(np.float32).tolist(), 0) for k, x in enumerate(np.concatenate([a, b]))]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    found = sum(r.n_links for r in got) / 3000
    print(f"recall of links {found:.4f}")
    assert 0.99 <= found <= 1


def test_near_vectors_of_a_tiny_table(spark):
    rows = [(0, [1.0, 0.0, 0.1], 0), (1, [1.0, 0.1, 0.0], 0), (2, [1.0, 0.0, 0.1], 0)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(0, 2, 0), (1, 2, 0), (2, 2, 0)]


@pytest.mark.parametrize(("down", "across"), [(64, 32), (1, 1), (2, 3)])
def test_top_k(spark, monkeypatch, down, across):
    from tallyframe.llm import topk

    monkeypatch.setattr(topk, "QUERY_BLOCKS", down)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCKS", across)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 50)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-3, 4, size=8) / 4).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300, None), (350, [float("inf")] + [0.0] * 7), (400, [0.0] * 8), (450, []), (500, [1.0] * 3), (501, [None] + [1.0] * 7), (None, [1.0] * 8)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    sound = {i: np.floor(256 * np.array([*e, *[0.0] * (8 - len(e))], dtype=float)).astype(int) for i, e in rows if i is not None and e is not None and None not in e and np.isfinite(e).all()}
    want = {(q, n + 1, i, -s) for q in sound if q % 50 == 0 for n, (s, i) in enumerate(sorted((-int(sound[q] @ sound[i]), i) for i in sound if i != q)[:5])}
    assert {tuple(r) for r in exact_top_k(table, table.where("vec_id % 50 = 0")).collect()} == want
    few = table.where("vec_id in (0, 1, 2)")
    assert exact_top_k(few, few.where("vec_id = 0")).count() == 2
    assert exact_top_k(table.limit(0), table.limit(0)).count() == 0


def test_top_k_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (100, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [0.5, 2.0])]
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, "vec_id long, embedding array<double>")
        found = [tuple(r) for r in exact_top_k(table, table.where("vec_id = 100")).orderBy("rank").collect()]
        assert found == [(100, 1, 2, 65536), (100, 2, 1, 0)]  # asked by [0, 1], the smallest
    twice = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [tuple(r)[2:] for r in exact_top_k(twice, twice.where("vec_id = 1")).orderBy("rank").collect()]
    assert found == [(100, 65536), (100, 32768), (2, 0), (100, 0)]


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_components(docs).count() == 0
    assert [r.component_id for r in ngram_components(spark.createDataFrame([(5, None), (6, "")], docs.schema)).collect()] in ([5, 6], [6, 5])


@pytest.mark.parametrize("percent", [75])
def test_bound_is_exact(percent):
    from tallyframe.llm.ngram_join import least_common

    for n in range(1, 200):
        fewest = min((m for m in range(1, n + 1) if 100 * m >= percent * n), default=n)
        assert least_common(n, percent) == fewest
