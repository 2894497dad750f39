"""Line dedup, mixing and sharding on small tables against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tallyframe.llm.line_dedup import line_dedup
from tallyframe.llm.mixing import mix_sources, repeated, source_targets
from tallyframe.llm.sharding import halves, permute, shard

LONG = "A sentence that many documents share."
ODD = [
    (1, f"{LONG}\nown line of the first document\n", "a"), (2, f"  {LONG.upper()}\t\nx", "b"), (3, f"{LONG}\n{LONG}\nthird's own line, long enough", "a"), (4, None, None), (5, "", "a"), (6, "\n\n", "b"),
    (7, "word " * 30_000 + "\n" + "twice in one document only\n" * 2, "a"), (7, "word " * 30_000 + "\n" + "twice in one document only\n" * 2, "a"), (None, f"{LONG}", "c"), (9, "é" * 19 + "\n" + "é" * 20, "a"), (10, "é" * 19 + "\n" + "é" * 20, "a"), (11, "É" * 20 + "\n" + "é" * 20 + "\r", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "extra", 1, "d", 2) for r in ODD], "doc_id long, text string, source string, n_lines string, position int, doc string, th int")


def key(line):
    return line.strip(" \t\n\x0b\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_line_dedup(spark, odd):
    holders = defaultdict(set)
    for i, t, _ in ODD:
        for line in (t or "").split("\n"):
            holders[key(line)].add(-1 if i is None else i)
    want = Counter()
    for i, t, _ in ODD:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == (-1 if i is None else i)]
        want[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    for batches, fanout in ((1, 2), (5, 2)):
        got = line_dedup(odd, batches=batches, fanout=fanout)
        assert got.columns == ["doc_id", "text", "source", "position", "doc", "th", "n_lines", "n_dropped"]
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == want


def test_levels_serve_the_last_batch(spark, odd, monkeypatch):
    """Of as many batches as a call makes by itself, the last one merges with one compacted run, not with a run for each batch."""
    from tallyframe.llm.line_dedup import LineRuns

    met = []
    real = LineRuns.add
    monkeypatch.setattr(LineRuns, "add", lambda self, counted, last=False: met.append([len(level) for level in self.levels]) or real(self, counted, last))
    line_dedup(odd)
    assert met == [[0], [1], [2], [0, 1]]


def test_merges_use_the_order_of_the_runs(spark):
    from tallyframe.llm.line_dedup import KEY, LineRuns
    from tallyframe.llm.scratch import discard, ordered_scans

    index = LineRuns(8)
    rows = lambda a, b: spark.range(a, b).selectExpr("xxhash64(id) as h1", "xxhash64(1, id) as h2", "1L as docs", "2L as lines", "id as last_doc")
    runs = [index.run(rows(0, 3000)), index.run(rows(3000, 4000))]
    batch = index.run(rows(2000, 5000))
    with ordered_scans(spark):
        fresh = index.merged(index.merged(batch, runs[0], "left_anti"), runs[1], "left_anti")
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan and "Sort [" not in plan
        assert fresh.count() == 1000
    discard(batch, *runs)
    one = LineRuns(8, fanout=2)
    for a, b in ((0, 100), (50, 150), (0, 200), (190, 210)):
        one.add(rows(a, b))
    got = {r.last_doc: r.docs for r in one.totals().collect()}
    assert got == {k: sum(a <= k < b for a, b in ((0, 100), (50, 150), (0, 200), (190, 210))) for k in range(210)}
    assert [len(level) for level in one.levels] == [0, 0, 1]


def test_hot_lines(spark, monkeypatch):
    from tallyframe.llm import line_dedup as module

    monkeypatch.setattr(module, "HOT_SHARE", 3)
    texts = {i: "\n".join(["a line that all documents hold, again and again"] + [f"a line that only some hold, number {i % 5}"] + [f"own line of document number {i}"]) for i in range(30)}
    got = line_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    for r in got:
        assert r.n_dropped == (0 if r.doc_id == 29 else 1 if r.doc_id >= 25 else 2) and r.text.endswith(f"own line of document number {r.doc_id}")


def test_a_line_repeated_often_in_few_documents_is_hot(spark, monkeypatch):
    from tallyframe.llm import line_dedup as module

    monkeypatch.setattr(module, "HOT_SHARE", 3)
    hot = "the same line of twenty characters"
    texts = {i: "\n".join([hot] * (200 if i < 3 else 0) + [f"another line, number {i % 2} of two", f"own line of document number {i}"]) for i in range(12)}
    got = line_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    for r in got.collect():
        assert r.n_dropped == (200 * (r.doc_id < 2) + (r.doc_id < 10)) and r.text.endswith(f"own line of document number {r.doc_id}")


def test_mixing(spark, odd):
    got = mix_sources(odd).collect()
    size = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, x in ODD if x == s) for s in ("a", "b", "c", None)}
    assert len(got) == len(ODD)
    for r in got:
        assert r.source_size == size[r.source] and 0 <= r.copies <= 3 and r.target <= 3 * r.source_size + 1e-9
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(min(sum(size.values()), 3 * sum(size.values())))
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(odd).collect()))
    wide = spark.createDataFrame([(i, "w " * (i % 50 + 1), f"s{i % 7 if i % 3 else 0}") for i in range(4000)], "doc_id long, text string, source string")
    for r in mix_sources(wide).groupBy("source").agg({"target": "max", "*": "count"}).collect():
        taken = mix_sources(wide).where(f"source = '{r.source}'").selectExpr("sum(copies * size)").first()[0]
        assert taken == pytest.approx(r[1] if isinstance(r[1], float) else r[2], abs=110)
        break
    assert repeated(wide).count() == mix_sources(wide).agg({"copies": "sum"}).first()[0]
    assert repeated(odd).columns == odd.columns


def test_mixing_of_null_and_repeated_ids(spark):
    rows = [(None if k % 2 else k // 8, "w " * (k % 30 + 1), f"s{k % 3}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, got = Counter(), Counter()
    for r in mix_sources(docs).collect():
        taken[r.doc_id, r.source, r.size] += r.copies
    for r in repeated(docs).collect():
        got[r.doc_id, r.source, len(r.text.split())] += 1
    assert got == +taken and sum(n for (i, *_), n in got.items() if i is None) > 100


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 1, 50], [0, 0], [5], [0, 7, 3, 1000, 2, 2, 2]])
def test_targets_fill_like_the_loop(spark, sizes):
    rows = [(f"s{k}", n) for k, n in enumerate(sizes)]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    weight, want, open_, left = {s: k % 3 + 1 for k, (s, _) in enumerate(rows)}, {}, dict(rows), float(sum(sizes))
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * open_[s]]
        if not over:
            want |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            want[s] = 3.0 * open_.pop(s)
            left -= want[s]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 1000, 4097])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    places = [r[0] for r in spark.range(n).select(permute(F.col("id"), n)).collect()]
    assert sorted(places) == list(range(n)) and (n < 24 or places != sorted(places))
    a, b = halves(n)
    assert n <= a * b < n + a + b


def plain_place(x, n, seed=11, rounds=6):
    """The permutation row by row: six rounds over a pair of residues, again until the place is below n."""
    prime, a = 2**31 - 1, 1
    while a * a < n:
        a += 1
    b = -(-n // a)
    digests = [hashlib.sha256(f"{seed}:{k}".encode()).digest() for k in range(rounds)]
    while True:
        left, right = x % a, x // a
        for k, d in enumerate(digests):
            y = ((right if k % 2 == 0 else left) * (int.from_bytes(d[:4], "big") % (prime - 1) + 1) + int.from_bytes(d[4:8], "big") % prime) % prime
            y = (y * y + y) % prime
            left, right = ((left + y) % a, right) if k % 2 == 0 else (left, (right + y) % b)
        x = right * a + left
        if x < n:
            return x


def test_permutation_row_by_row(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100, 1001, 5000):
        got = {r[0]: r[1] for r in spark.range(n).select("id", permute(F.col("id"), n)).collect()}
        assert got == {x: plain_place(x, n) for x in range(n)}


def test_shards_row_by_row(spark):
    rows = [(i * 7 % 400, f"text {i % 13}" * (i % 5)) for i in range(400)]
    got = {r.doc_id: (r.shard, r.slot) for r in shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for place, (i, _) in enumerate(sorted(rows)):
        p = plain_place(place, len(rows))
        assert got[i] == (p % 24, p // 24)


def test_shards(spark, odd):
    got = shard(odd, shards=5).collect()
    text = {(i, zlib.crc32((t or "").encode())): len((t or "").encode()) + 8 for i, t, _ in ODD}
    assert Counter((r.doc_id, r.text_crc32, r.size) for r in got) == Counter((i, zlib.crc32((t or "").encode()), text[i, zlib.crc32((t or "").encode())]) for i, t, _ in ODD)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert line_dedup(none).count() == mix_sources(none).count() == shard(none).count() == repeated(none).count() == 0


def test_query_digest(spark, tmp_path):
    from tallyframe.llm.queries import op3_line_dedup

    spark.createDataFrame([(1, "x\ny")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op3_line_dedup(spark, str(tmp_path)).first().kept_sha256 == hashlib.sha256(b"x\ny").hexdigest()
