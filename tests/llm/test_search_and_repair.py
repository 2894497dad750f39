"""URL filter, conversation repair and ranked search against brute force, and on odd tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import lexical_search, queries
from tallyframe.llm.conversation_repair import cheapest_edits, damaged, edit_plans, repair_conversations, repaired_turns
from tallyframe.llm.lexical_search import MaxTree, ranked_search
from tallyframe.llm.scratch import written
from tallyframe.llm.url_filter import Rule, filter_urls, train_url_filter

SF = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
needs_tables = pytest.mark.skipif(not Path(SF).is_dir(), reason="needs the driver's tables")

# ---- conversations

TURNS = "conv_id long, turn long, role string, text string"


def cheapest_by_layers(rows, roles="sua"):
    """The same as A*, by relaxing all edits layer by layer: rows are (initial, must go, truncated)."""
    put = {"": "u", "s": "u", "u": "a", "a": "u"}
    layer = {"": (0, "")}

    def inserted(layer):
        while True:
            more = dict(layer)
            for state, (cost, audit) in layer.items():
                new = (cost + 5, audit + "I")
                if new < more.get(put[state], (math.inf, "")):
                    more[put[state]] = new
            if more == layer:
                return layer
            layer = more

    for initial, gone, cut in rows:
        below = {}
        for state, (cost, audit) in inserted(layer).items():
            edits = [(state, cost + 2, audit + "D")]
            if not gone:
                stay = cost + 5 * cut
                edits.append((put[state], stay + 1, audit + "R"))
                if (state + initial) in ("s", "u", "su", "ua", "au"):
                    edits.append((initial, stay, audit + "K"))
            for to, c, a in edits:
                below[to] = min(below.get(to, (math.inf, "")), (c, a))
        layer = below
    ends = inserted(layer)
    return min(ends[g] for g in ("", "a") if g in ends)


def cheapest_of_all(rows):
    """Every sequence of edits, with up to two rows put in at each place."""
    puts = [p for n in range(3) for p in itertools.product("ua", repeat=n)]
    best = None
    for edits in itertools.product(*([puts, "KuaD"] * len(rows) + [puts])):
        cost, audit, made, at = 0, "", "", 0
        for e in edits:
            if isinstance(e, tuple):
                cost, audit, made = cost + 5 * len(e), audit + "I" * len(e), made + "".join(e)
                continue
            initial, gone, cut = rows[at]
            at += 1
            if e == "D":
                cost, audit = cost + 2, audit + "D"
            elif gone:
                break
            else:
                cost, audit, made = cost + 5 * cut + (e != "K"), audit + ("K" if e == "K" else "R"), made + (initial if e == "K" else e)
        else:
            if re.fullmatch("(s?(ua)+)?", made) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def coded(rows):
    return [("sua".index(i) if i in "sua" and i else 3) | 4 * gone | 8 * (cut and not gone) for i, gone, cut in rows]


def test_a_star_takes_the_cheapest_edits():
    r = random.Random(5)
    row = lambda: (r.choice("suax"), r.random() < 0.2, r.random() < 0.3)
    some = [[row() for _ in range(n)] for n in (0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3)]
    for rows in some:
        rows = [(i, g, c and not g) for i, g, c in rows]
        assert cheapest_by_layers(rows) == cheapest_of_all(rows)
    for n in [*range(60), 300]:
        rows = [(i, g, c and not g) for i, g, c in (row() for _ in range(n))]
        assert min(cheapest_edits(coded(rows)).values()) == cheapest_by_layers(rows)


def plain_repair(turns):
    """Rows (turn, role, text) of a conversation: everything that op12 returns but the id."""
    turns = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in turns]
    turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()))
    seen, rows, counts = set(), [], Counter()
    for _, role, text in turns:
        end = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        rows.append((role[:1] or "?", fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = cheapest_by_layers(rows)
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum((a[0] + b[0]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    made, left, state = [], iter(turns), ""
    for e in audit:
        if e != "I":
            _, role, text = next(left)
        if e in "IR":
            role, text = ("assistant" if state == "u" else "user"), "" if e == "I" else text
        if e != "D":
            made.append(f"{role}:{text}")
            state = role[0]
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


def odd_turns():
    r = random.Random(8)
    texts = ["Well.", "well", "No!", "Why?  \n", " \t\n", "", None, "É.", "cut off", "long " * 30_000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "Undo"]
    rows = [(c, r.choice([None, *range(9)]) if c % 3 else n, r.choice(roles), r.choice(texts)) for c in range(40) for n in range(r.randrange(9))]
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (99, None, "user", "x"), (99, None, None, None)]
    rows += [(77, n, ("user", "assistant")[n % 2] if r.random() < 0.8 else r.choice(roles), f"Row {n if r.random() < 0.9 else 1}" + r.choice((".", ".", ""))) for n in range(0, 700)]
    return rows + [rows[0]] * 3


@pytest.mark.parametrize("piece", [4, 1024])
def test_conversations_against_brute_force(spark, piece):
    rows = odd_turns()
    turns = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], TURNS + ", digest int").repartition(5)
    wanted = defaultdict(list)
    for c, *x in rows:
        wanted[c].append(tuple(x))
    plans = written(edit_plans(turns, piece=piece), "plans")
    got = {p.conv_id: tuple(p)[1:] for p in plans.collect()}
    assert got == {c: plain_repair(x)[:-1] for c, x in wanted.items()}
    made = defaultdict(list)
    for x in repaired_turns(turns, plans).orderBy("place").collect():
        made[x.conv_id].append(x)
    assert all("".join(x.edit for x in v) == got[c][-1] and re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in v if x.role)) for c, v in made.items())


def test_digests_and_absent_rows(spark):
    rows = odd_turns()
    turns = spark.createDataFrame(rows, TURNS)
    wanted = defaultdict(list)
    for c, *x in rows:
        wanted[c].append(tuple(x))
    ids = spark.createDataFrame([(c, "x") for c in [*wanted, *wanted, 5000]], "conv_id long, text string")
    got = {p.conv_id: tuple(p)[1:] for p in repair_conversations(turns, ids).collect()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: plain_repair(x) for c, x in wanted.items()} | {5000: none}
    empty = spark.createDataFrame([], TURNS)
    assert repair_conversations(empty).count() == 0
    assert [tuple(p)[1:] for p in repair_conversations(empty, ids.limit(1)).collect()] == [none]


def test_one_row_for_many_equal_ones(spark):
    """A conversation whose rows are all equal: its rows are spread by their numbers."""
    turns = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Same.").alias("text"))
    got = edit_plans(turns, piece=64).first()
    assert (got.duplicate, got.illegal, got.cost, got.gaps) == (2999, 2999, 2 * 3000, 0) and got.audit == "D" * 3000


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three? four") for c in range(60) for t in (0, 1, None)] + [(None, 3, None, None)]
    got = defaultdict(list)
    for x in damaged(spark.createDataFrame(rows, TURNS)).collect():
        got[x.conv_id, x.turn].append((x.role, x.text))
    want = {}
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        word = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{word(c)}:{word(t)}".encode()) % 20
        made = {0: [], 1: [(role, "")], 2: [(role, re.sub("[.!?]", "", text))], 3: [(role, text)] * 2, 4: [("user", text)]}.get(fault, [(role, text)])
        if made:
            want[c, t] = made
    assert got == want


@needs_tables
def test_op12_on_the_tables(spark):
    wanted = defaultdict(list)
    for x in damaged(spark.read.parquet(f"{SF}/conversations.parquet")).collect():
        wanted[x.conv_id].append((x.turn, x.role, x.text))
    got = {p.conv_id: tuple(p)[1:] for p in queries.op12_conversation_repair(spark, SF).collect()}
    assert {c: got[c] for c in wanted} == {c: plain_repair(x) for c, x in wanted.items()}
    assert set(got) == {r.conv_id for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}


# ---- search


def plain_search(docs, queries, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    counted = [(i, Counter(split(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = Counter()
    for item, text in queries:
        scored = []
        for doc, c in counted:
            mean = 100 - 90 + (90 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * mean)) for t in set(split(text)) if c[t])
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        out.update((item, rank + 1, doc, -score) for rank, (score, doc) in enumerate(sorted(scored)[:k]))
    return out


@pytest.mark.parametrize(("blocks", "terms"), [(16_384, 400_000), (7, 400_000), (7, 60)])
def test_search_against_brute_force(spark, monkeypatch, blocks, terms):
    monkeypatch.setattr(lexical_search, "PASS_TERMS", terms)
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", blocks)
    r = random.Random(2)
    words = [f"w{n}" for n in range(12)] + ["É", "Ab", "x1", "--", "_", "日本"]
    docs = [(n if n % 9 else n // 2, " ".join(r.choices(words, k=r.randrange(1, 12)))) for n in range(150)]
    docs += [(None, "w1 w2 w3"), (500, None), (501, ""), (502, " ,.\n"), (503, "\x00w1\x00"), (504, "w1 " * 50_000), (600, docs[3][1]), (601, docs[3][1]), *docs[:5]]
    asked = [(1, "w1 W1 w2"), (2, "é É ab"), (3, None), (4, "none of these"), (5, " ".join(words)), (None, "x1-ab_w3"), (1, "w4"), (7, docs[3][1])]
    got = ranked_search(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(3), spark.createDataFrame(asked, "item_id long, text string"), k=4)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain_search(docs, asked, 4)


def test_search_of_empty_tables(spark):
    docs, asked = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for d, q in ((docs, asked), (some, asked.limit(0)), (some.withColumn("text", F.lit(" ")), asked), (some, asked.withColumn("text", F.lit("?")))):
        assert ranked_search(d, q).collect() == []


def test_tree_of_maxima():
    """Ties of scores within and between ranges, floors, and fewer documents than asked for."""
    r = np.random.default_rng(1)
    for n, vocabulary, most in ((1, 3, 5), (16, 4, 2), (17, 4, 2), (300, 6, 3), (5000, 8, 2), (5000, 40, 1000)):
        lengths = r.integers(1, 4, n)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        terms = np.concatenate([np.sort(r.choice(vocabulary, k, replace=False)) for k in lengths]).astype(np.int32)
        values = r.integers(0, most, len(terms))
        tree = MaxTree(starts, terms, values)
        for _ in range(8):
            asked = r.random(vocabulary) < 0.5
            scores = np.add.reduceat(np.where(asked[terms], values, 0), starts[:-1])
            every = sorted((-int(s), p) for p, s in enumerate(scores) if s > 0)
            for floor in (0, 1, 3):
                assert [(-s, p) for s, p in tree.best(asked, 10, floor)] == [x for x in every if -x[0] >= floor][:10]


# ---- URLs

RULES = [Rule("allow", "org"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
ODD_URLS = (None, "", "example.org/es/1", "http://", "://", "http://example.org", "http://EXAMPLE.org/es/", "http://www.Example.ORG/en/1?x=/es/", "http://notexample.org/es/", "http://example.org?x=/es/", "http://example.org#/es/", "a://b://example.org/es/", "http://com/de/", "http://x.com/DE/", "http://org/", "http://É.org/en/1", "http://x.com/fr/#a?b", "http://" + "long" * 20_000 + ".com/de/" + "9" * 50_000, "http://example.org/en/1")


def plain_rule(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(ASCII)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_rules_on_odd_urls(spark):
    pages = spark.createDataFrame([(n, u, "x", None) for n, u in enumerate(ODD_URLS)] + [(0, "http://x.net/a", "", 1), (None, "http://x.net/a", "", 1)], "page_id long, url string, host string, verdict int")
    got = filter_urls(pages, RULES).collect()
    assert len(got) == len(ODD_URLS) + 2 and all(0 <= x.score <= 1 for x in got)
    for n, x in enumerate(got[: len(ODD_URLS)]):
        host, path, rule, verdict = plain_rule(ODD_URLS[n], RULES)
        assert (x.page_id, x.host, x.path, x.rule) == (n, host, path, rule) and x.verdict == (verdict or ("block" if x.score >= 0.5 else "allow"))
    assert filter_urls(pages.limit(0), RULES).collect() == []
    assert {x.verdict for x in filter_urls(pages, []).collect()} == {"allow"}
    only = filter_urls(pages, [Rule("block", "org")]).collect()
    assert {x.verdict for x in only} == {"block"}
    longest = filter_urls(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), [Rule("allow", "b", "/c"), Rule("block", "a.b", "/"), Rule("allow", "a.b", "/")]).first()
    assert (longest.rule, longest.verdict) == ("a.b/", "block")
    with pytest.raises(ValueError, match="rules"):
        filter_urls(pages, [Rule("allow", f"h{n}") for n in range(501)])


def made_urls(n, seed):
    """Blocked: hosts of many digits and hyphens, or long queries; the rest is plain. One host has a third of all."""
    r = random.Random(seed)
    word = lambda k=6: "".join(r.choice("abcdefghijklmnop") for _ in range(k))
    rows = []
    for k in range(n):
        bad = r.random() < 0.4
        host = f"{word(3)}-{r.randrange(10**6)}-{word(3)}{r.randrange(100)}.info" if bad else r.choice(["news.big.org", f"{word()}.net"])
        query = "?" + "&".join(f"{word(2)}={r.randrange(10**5)}" for _ in range(r.randint(2, 6))) if bad and r.random() < 0.7 else ""
        rows.append((k, f"https://{host}/{word()}/{r.randrange(99)}{query}", int(bad) if r.random() < 0.97 else 1 - int(bad)))
    return rows


def test_trees_on_held_out_urls(spark):
    rows = made_urls(3000, 4)
    table = spark.createDataFrame(rows, "page_id long, url string, label int")
    got = filter_urls(table.where("page_id >= 2000"), [], labelled=table.where("page_id < 2000")).collect()
    right = sum((x.verdict == "block") == bool(rows[x.page_id][2]) for x in got)
    assert len(got) == 1000 and right >= 940
    again = train_url_filter(table.repartition(7))
    host, path = F.lit("x.net"), F.lit("/a")
    one = [spark.range(1).select(m.score(F.lit("http://x.net/a"), host, path).alias("s")).first().s for m in (again, train_url_filter(table))]
    assert one[0] == one[1] < 0.5


@needs_tables
def test_op11_on_the_tables(spark):
    """Rules by brute force; labels that the rules give to hosts held out of the training are found by the trees."""
    pages = spark.read.parquet(f"{SF}/../sf0.1/pages.parquet").select("page_id", "url")
    got = {x.page_id: x for x in queries.op11_url_filter(spark, f"{SF}/../sf0.1").collect()}
    labels = {}
    for p in pages.collect():
        host, path, rule, verdict = plain_rule(p.url, RULES)
        x = got[p.page_id]
        assert (x.host, x.path, x.rule) == (host, path, rule) and x.verdict in ("allow", "block") and (verdict is None or x.verdict == verdict)
        if verdict:
            labels[p.page_id] = (p.url, int(verdict == "block"))
    held = {i for i in labels if zlib.crc32(labels[i][0].encode()) % 5 == 0}
    known = spark.createDataFrame([labels[i] for i in labels if i not in held], "url string, label int")
    judged = filter_urls(pages, [], labelled=known).collect()
    right = [(x.verdict == "block") == bool(labels[x.page_id][1]) for x in judged if x.page_id in held]
    assert len(right) > 100 and sum(right) / len(right) > 0.9
