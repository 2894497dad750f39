"""The similarity join of two tables against brute force, its plan, and odd tables."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import similarity, skew
from tallyframe.operators.similarity import cited, similar_texts
from tallyframe.plans import queries as plans
from tallyframe.sources import shared


def words(text):
    return frozenset((text or "").lower().split())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def brute(left, right, threshold):
    out = {}
    for group, text in set(left):
        near = [jaccard(words(text), words(t)) for g, t in set(right) if g == group]
        near = [x for x in near if x > threshold]
        if near:
            out[group, text] = (len(near), round(max(near), 9))
    return out


def made(n, seed):
    r = random.Random(seed)
    common, rare = ["the", "of", "a", "lens"], [f"w{k}" for k in range(40)]
    rows = []
    for _ in range(n):
        base = r.choices(common, k=3) + r.sample(rare, r.randrange(0, 9))
        r.shuffle(base)
        rows.append((r.choice(["x", "y", None]), " ".join(base)))
    near = [(g, " ".join(w for w in t.split() if r.random() < 0.93).upper()) for g, t in rows]
    return [*rows, *rows[:9], ("x", None), ("x", ""), (None, " \t"), ("z", "only left")], [*near, *rows[: n // 3], ("x", None), ("y", "  ")]


@pytest.mark.parametrize(("threshold", "share"), [(0.8, 10_000), (0.8, 5), (0.5, 20), (0.6, 10_000)])
def test_similar_texts(spark, monkeypatch, threshold, share):
    monkeypatch.setattr(skew, "HOT_SHARE", share)
    left, right = made(120, int(threshold * 10))
    got = similar_texts(spark.createDataFrame(left, "g string, t string"), spark.createDataFrame(right, "g string, t string"), "t", "g", threshold=threshold)
    assert {(x.g, x.t): (x.matches, round(x.best, 9)) for x in got.collect()} == brute(left, right, threshold) != {}


def test_long_texts_copies_and_empty_tables(spark):
    long = " ".join(f"v{k}" for k in range(20_000))
    left = [(1, long)] * 3 + [(2, "same words here")] * 500
    right = [(1, long + " and more")] * 400 + [(2, "here same words")] * 300 + [(2, "Same words here")]
    table = lambda rows: spark.createDataFrame(rows, "g int, t string")
    got = {(x.g, x.t[:4]): x.matches for x in similar_texts(table(left), table(right), "t", "g").collect()}
    assert got == {(1, "v0 v"): 1, (2, "same"): 2}
    assert similar_texts(table([]), table(right), "t", "g").count() == similar_texts(table(left), table([]), "t").count() == 0


def test_cited(spark):
    left, right = made(150, 3)
    right += left[:40]
    want = {}
    lists = [defaultdict(set), defaultdict(set)]
    for side, rows in zip(lists, (left, right), strict=True):
        for g, t in rows:
            if t is not None:
                side[g].add(t)
    for g in {*lists[0], *lists[1]}:
        p, e = lists[0][g], lists[1][g]
        partial = sum(any(jaccard(words(x), words(y)) > 0.8 for y in e - p) for x in p - e)
        want[g] = (len(p), len(e), len(p & e), partial, round((len(p & e) + partial / 2) / len(e), 9) if e else float(not p))
    got = cited(spark.createDataFrame(left, "g string, t string"), spark.createDataFrame(right, "g string, t string"), "t", "g")
    assert {x.g: (x.num_predicted, x.num_expected, x.exact, x.partial, round(x.citation_accuracy, 9)) for x in got.collect()} == want


def test_plan_has_no_cross_join(spark):
    plan = plans.QUERIES["fuzzy_turns"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan and Counter(plan.split())["Exchange"] > 0


def test_stored_tables_are_released(spark):
    table = shared.stored(spark.range(3).withColumn("t", F.lit("x")), "kept")
    path = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert table.count() == 3 and path.is_dir() and path.parent == Path(shared.shared_dir(spark).removeprefix("file:"))
    shared.release(spark)
    assert not path.exists()


def test_texts_that_differ_by_words_of_their_own_are_one_class(spark, monkeypatch):
    """Titles of one group share their frequent words; those that end in a number each cost one comparison together, and other groups' titles none."""
    seen = []
    real = similarity.similar_classes
    monkeypatch.setattr(similarity, "similar_classes", lambda one, two, t: seen.append((one.count(), two.count(), real(one, two, t).count())) or real(one, two, t))
    start = "{} bolt brand economy size no"
    left = [(g, start.format(k)) for g in (None, 1) for k in ("hot", "cold")]
    right = [(g, f"{start.format(k)} {n}") for g in (None, 1) for k in ("hot", "cold") for n in range(100, 200)]
    got = similar_texts(spark.createDataFrame(left, "g int, t string"), spark.createDataFrame(right, "g int, t string"), "t", "g").collect()
    assert {(x.g, x.t): (x.matches, round(x.best, 9)) for x in got} == {k: (100, round(6 / 7, 9)) for k in left}
    assert seen == [(4, 4, 4)]


def test_only_numbers_of_words_move(spark):
    """A text's words go as one 64-bit number each, rarest first; words that one table alone has do not go at all."""
    rows = [(7, 4, t, df) for t, df in ((-1, 900), (5, 2), (1 << 40, 30))]
    got = similarity._by_text(spark.createDataFrame(rows, "_id long, _n int, _token long, _df long"), 0.7)
    assert dict(got.dtypes)["_tokens"] == "array<bigint>"
    tokens = got.first()["_tokens"]
    assert tokens == sorted(tokens) and [t >> 56 for t in tokens] == [4, 19, 39] and [t & ((1 << 56) - 1) for t in tokens] == [0, (1 << 40) >> 8, (1 << 56) - 1]
    assert similarity._by_text(spark.createDataFrame(rows[:2], "_id long, _n int, _token long, _df long"), 0.7).count() == 0


@pytest.mark.parametrize("longs", [1, None])
def test_few_pairs_of_long_texts_are_compared_in_vain(spark, monkeypatch, longs):
    """Long sets that share their frequent words meet under rare ones; a bitmap of 64 bits is full then, and all of them would move with their tokens."""
    if longs:
        monkeypatch.setattr(similarity, "BITMAP_LONGS", longs)
    seen = []
    real = similarity._met
    monkeypatch.setattr(similarity, "_met", lambda one, two, t: seen.append(real(one, two, t).count()) or real(one, two, t))
    r = random.Random(5)
    frequent, rare = [f"f{k}" for k in range(150)], [f"r{k}" for k in range(4000)]
    right = [(1, " ".join(r.sample(frequent, 110) + r.sample(rare, 80))) for _ in range(150)]
    left = [(1, t.split(" ", 1)[1]) for _, t in right]
    got = similar_texts(spark.createDataFrame(left, "g int, t string"), spark.createDataFrame(right, "g int, t string"), "t", "g").collect()
    assert {(x.g, x.t): (x.matches, round(x.best, 9)) for x in got} == brute(left, right, 0.8) and len(got) == 150
    assert seen[0] > 300 if longs else seen[0] < 160
