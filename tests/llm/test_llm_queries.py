"""The queries on the driver's smallest tables: against SQL, and the pipeline stage by stage."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tallyframe.llm import queries as llm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(llm.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    got = llm.queries()[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(found.fetchall())


def test_names():
    assert [n.split("_")[0] for n in llm.queries()] == [f"op{k}" for k in range(1, 14)]


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept, last = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, last, SF).write.parquet(f"{tmp_path}/{name}")
        last = spark.read.parquet(f"{tmp_path}/{name}")
        assert last.columns == docs.columns
        kept[name] = last.collect()
    clean, lines, unique, mixed = (kept[n] for n in names[:-1])
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    ids = {r.doc_id for r in clean}
    assert {r.doc_id: r.text for r in clean}.items() <= {r.doc_id: r.text for r in docs.collect()}.items()
    assert len(ids - toxic) >= 0.95 * (docs.count() - len(toxic)) and len(ids & toxic) < len(toxic)
    # lines by brute force
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(set)
    for r in clean:
        for x in r.text.split("\n"):
            holders[key(x)].add(r.doc_id)
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == r.doc_id) for r in clean}
    assert {r.doc_id: r.text for r in lines} == want and all(r.n_chars == len(r.text) for r in lines)
    # near copies by brute force
    sets = {}
    for i, t in want.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    low = {i: i for i in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                low[max(x, y)] = min(x, y)
    assert {r.doc_id for r in unique} == {i for i in sets if root(i) == i}
    times = Counter(r.doc_id for r in mixed)
    assert set(times) <= {r.doc_id for r in unique} and max(times.values()) <= 3
    pieces = corpus_pipeline.STAGES[-1][1](spark, last, SF).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == times


def test_near_copies_with_null_and_repeated_ids(spark):
    base = [f"word{k}" for k in range(60)]
    near, other, own = " ".join([*base[:-1], "end"]), " ".join(f"other{k}" for k in range(9)), " ".join(f"own{k}" for k in range(9))
    rows = [(7, " ".join(base)), (5, near), (5, near), (None, near), (None, " ".join(base)), (None, other), (None, other), (5, own), (8, ""), (None, None)]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert Counter(map(tuple, got)) == Counter([(5, near), (None, other), (5, own), (8, ""), (None, None)])


def plain_copies(rows, seed=7, most=3):
    """Systematic sampling row by row: expected copies are target over size, an offset for each source, a copy for each integer crossed."""
    sizes = defaultdict(int)
    for _, source, size in rows:
        sizes[source] += size
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    weight, open_, left, target = {s: k % 3 + 1 for k, s in enumerate(names)}, set(names), float(sum(sizes.values())), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            open_.remove(s)
    out = {}
    for s in names:
        offset = int(hashlib.md5(f"{s or ''}:{seed}".encode()).hexdigest()[:8], 16) / 2**32
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        own = sorted(((i, n) for i, x, n in rows if x == s), key=lambda r: (-r[1], hashlib.md5(str(r[0]).encode()).hexdigest()))
        for rank, (i, _) in enumerate(own):
            out[i] = min(most, math.floor(rate * (rank + 1) + offset) - math.floor(rate * rank + offset))
    return out


def test_pipeline_toxicity_and_mixing_against_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = {r.doc_id: r.score for r in llm.queries()["op5_toxicity"](spark, SF).collect()}
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, s in scored.items() if s < 0.5}
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()]
    got = Counter(r.doc_id for r in corpus_pipeline.mix_to_weights(spark, docs, SF).select("doc_id").collect())
    assert got == +Counter(plain_copies(rows))


LINE = "A line of words that several documents have in common"
WORDS = " ".join(f"word{k}" for k in range(40))
ODD = [
    (1, f"{LINE}\n{WORDS}"), (2, f"{LINE}\n{WORDS} more"), (3, f"{LINE}\n own words of the third document, not like any other"), (3, f"{LINE}\n own words of the third document, not like any other"), (4, None), (5, ""), (6, "\n\n"), (None, None), (None, f"{LINE}\nof one without number"),
    (7, "long " * 60_000), (8, "é ñ ß " * 10), (9, "vile awful idiots " * 5), (10, "x"), (11, "x"),
]


def odd_tables(spark, path, rows):
    made = [(i, t, "en", f"s{k % 3}" if k % 5 else None, len(t or ""), k, "a", 1.5, [1], "r") for k, (i, t) in enumerate(rows)]
    made += [(100 + k, ("vile awful idiots " if k % 4 == 0 else "kind fine words ") + f"number {k * k} {k * 7}", "en", "s1", 30, k, "b", 0.5, [], "r") for k in range(120 if rows else 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, position int, score string, size double, copies array<int>, row string"
    spark.createDataFrame(made, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(100 + k, 1, int(k % 4 == 0)) for k in range(120 if rows else 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null, empty and very long texts, ties, repeated rows, null ids and columns with names that operators use: no stage crashes, each keeps the columns."""
    odd_tables(spark, tmp_path, ODD)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert after.dtypes == docs.dtypes, name
        docs, kept[name] = after, after.collect()
    clean, lines, unique, mixed = kept.values()
    assert {4, 5, 6, 7, 8, 10, 11, None} <= {r.doc_id for r in clean} and 9 not in {r.doc_id for r in clean} and Counter(r.doc_id for r in clean)[3] == 2
    assert len(lines) == len(clean) and sum(LINE in r.text for r in lines) == 2  # the document with the largest number has two rows
    assert Counter(r.doc_id for r in unique)[3] == 1 and {1, 2} & {r.doc_id for r in unique} == {1} and {10, 11} & {r.doc_id for r in unique} == {10} and {4, 5, 6, 7, 8} <= {r.doc_id for r in unique}
    assert {str(r) for r in mixed} <= {str(r) for r in unique}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed} and sum(r.start == 0 for r in packed) == len(mixed)


def test_pipeline_on_empty_tables(spark, tmp_path):
    odd_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
