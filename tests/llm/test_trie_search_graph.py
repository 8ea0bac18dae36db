"""Prefix trie, lexical search and the vector graph against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.llm import lexical_search, prefix_trie, vector_graph

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_trie(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(vs)] for c, vs in by.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:])
    return brute_nodes(built)


def brute_nodes(built):
    members, kids = defaultdict(list), defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return {
        (min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    }


def as_nodes(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def test_trie_of_odd_conversations(spark):
    rng = np.random.default_rng(2)
    rows = [(c, int(t), "user" if t % 2 else "bot", f"say {rng.integers(0, 3)}") for c in range(-12, 60) for t in range(rng.integers(1, 12))]
    rows += [(100 + i, t, "user", "the same for all ä") for i in range(5) for t in range(70 + i)]  # several blocks, one inside the other
    rows += [(200, t, "user", f"alone {t}") for t in range(40)] + [(205, 3, "user", "short"), (206, 1, "a", None), (206, 1, "a", ""), (206, None, None, None), (206, None, "z", "first"), (207, 0, "ab", "c"), (207, 0, "a", "bc")]
    rows += [(None, 1, "user", "of nobody"), (210, 1, "user", "long " * 200_000), (211, 1, "user", "long " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.withColumns({"conv": F.lit(1), "entry": F.lit(2), "t1": F.lit(3), "d": F.lit(4), "pos": F.lit(5), "path": F.lit("p")})
    assert as_nodes(prefix_trie.rebuilt_trie(df)) == brute_trie(rows)
    assert prefix_trie.rebuilt_trie(df.limit(0)).count() == 0


def test_trie_of_given_turns(spark):
    """The operator by itself: plain turns, conversations without any, and members over several spans of ids."""
    built = {c: tuple(("", x) for x in text) for c, text in [(-5000, "abc"), (1, "abc"), (9000, "abd"), (9001, "abc"), (20_000, ""), (20_001, "x"), (4097, "abc")]}
    turns = spark.createDataFrame([(c, i + 1, x) for c, v in built.items() for i, (_, x) in enumerate(v)], "conv long, pos long, x string").select("conv", "pos", prefix_trie.turn_id(F.lit(""), F.col("x")).alias("tid"))
    convs = spark.createDataFrame([(c,) for c in built], "conv long")
    assert as_nodes(prefix_trie.trie(convs, turns)) == brute_nodes(built)


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_search(docs, items, k):
    cut = lambda s: TERM.findall((s or "").translate(LOWER))
    bags = [(i, Counter(cut(t))) for i, t in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    n, length = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    asked = defaultdict(list)
    for i, t in items:
        asked[i] += cut(t)
    out = []
    for item, terms in asked.items():
        found = []
        for i, c, size in bags:
            m = 25 + (75 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0 and i is not None and item is not None:
                found.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("few_terms", [False, True])
def test_search_as_by_brute_force(spark, monkeypatch, few_terms):
    if few_terms:
        monkeypatch.setattr(lexical_search, "TERMS_PER_PASS", 3)
        monkeypatch.setattr(lexical_search, "ITEMS_PER_PASS", 2)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)] + ["ÄÖ", "naïve", "漢字", "x1y2"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 25))) for _ in range(300)]
    docs = list(enumerate(texts)) + [(1000 + i, "W1,w2;w3 copies") for i in range(40)] + [(7, "w1 w2"), (7, "w1 w2"), (None, "w1 w1 w1"), (2000, None), (2001, ""), (2002, " ,.;\x00\x7f"), (2003, "w1\x01W2\x7fw3_w4`w5{w6")]
    docs += [(3000, "w1 " * 900_000 + "filler " * 900_000 + "w5")]  # cut into pieces
    items = [(1, "w1 w2 w2 W3"), (2, "ÄÖ äö naïve!"), (3, None), (4, "unknown"), (5, ""), (6, "w5"), (6, "w6 w5"), (None, "w1"), (7, " ".join(words))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns({"id": F.lit(1), "n": F.lit(2), "terms": F.lit("t"), "m": F.lit(3)})
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit("x"))
    got = [tuple(r) for r in lexical_search.search(d, q, k=10).collect()]
    assert sorted(got) == brute_search(docs, items, 10)
    assert sorted(got) == sorted(tuple(r) for r in lexical_search.search(d.repartition(1), q, k=10).collect())
    assert lexical_search.search(d.limit(0), q).count() == lexical_search.search(d, q.limit(0)).count() == 0


def brute_links(rows, least):
    good = [(i, label, np.array(v, float) / max(map(abs, v))) for i, label, v in rows if i is not None and label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max(len(v) for _, _, v in good)
    x = np.array([np.append(v, np.zeros(width - len(v))) / np.linalg.norm(v) for _, _, v in good])
    near = (x @ x.T >= least) & np.equal.outer([g[1] for g in good], [g[1] for g in good])
    np.fill_diagonal(near, False)
    return [g[0] for g in good], near


def reach(ids, near):
    low = np.arange(len(ids))
    while True:
        new = np.array([min(low[i], *low[near[i]]) if near[i].any() else low[i] for i in range(len(ids))])
        if (new == low).all():
            return [min(i for i, other in zip(ids, low) if other == mine) for mine in low]
        low = new


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(0, 3)), rng.normal(size=16).tolist()) for i in range(600)]
    for g in range(12):  # groups of near copies from 2 to 90
        v = rng.normal(size=16)
        v /= np.linalg.norm(v)
        for _ in range(2 + g * 8):
            rows.append((len(rows), g % 3, (v + rng.normal(size=16) * 0.012 * (1 + g % 3)).tolist()))
    a = rows[0]
    rows += [(5000, a[1], a[2]), (5001, a[1], [2 * x for x in a[2]]), (5002, a[1] + 1, a[2]), (5003, None, a[2]), (None, a[1], a[2]), (5003, a[1], a[2]), (5004, 1, None), (5005, 1, []), (5006, 1, [0.0] * 16), (5007, 1, [1.0, None, 2.0]), (5008, 1, [1.0, float("nan")]), (5009, 1, [float("inf")]), (5010, 1, [1e200, 1e200]), (5011, 1, [1e-200, 1e-200])]
    return rows


@pytest.mark.parametrize("block", [2048, 40])
def test_links_as_by_brute_force(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(vector_graph, "BLOCK", block)
    monkeypatch.setattr(vector_graph, "SHARD", 200)
    df = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>").withColumns({"u": F.lit(1), "node": F.lit(2), "first": F.lit("f")})
    groups = vector_graph.near_groups(df)
    got = groups.rows.collect()
    assert groups.recall >= 0.97 and len(got) == len(vectors)
    ids, near = brute_links(vectors, 0.93)
    want = Counter(zip(ids, near.sum(axis=1).tolist(), reach(ids, near)))
    for i, _, _ in [r for r in vectors if Counter(r[0] for r in vectors)[r[0]] == 1]:
        if i is not None and i not in ids:
            want[(i, 0, i)] += 1
    have = Counter((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None)
    true = dict(zip(ids, near.sum(axis=1).tolist()))
    assert all(r.n_links <= true.get(r.vec_id, 0) for r in got if r.vec_id is not None)
    assert sum((have & want).values()) >= 0.97 * sum(want.values())
    assert {(r.n_links, r.component_id) for r in got if r.vec_id is None} == {(0, None)}
    assert [(r.n_links, r.component_id) for r in got if r.vec_id in (5004, 5005, 5006, 5007, 5008, 5009)] and all(r.n_links == 0 and r.component_id == r.vec_id for r in got if r.vec_id in (5004, 5005, 5006, 5007, 5008, 5009))


def test_links_of_none(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>")
    assert vector_graph.near_groups(df.limit(0)).rows.count() == 0
    assert [tuple(r) for r in vector_graph.near_groups(df.where("vec_id = 5004")).rows.collect()] == [(5004, 0, 5004)]


def test_graph_search_finds_what_is_in_range():
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(40, 32))
    x = np.vstack([centre, np.repeat(centre[:10], 60, axis=0) + rng.normal(size=(600, 32)) * 0.12, rng.normal(size=(900, 32))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    edges = vector_graph.build_graph(x)
    assert vector_graph._reached(edges, vector_graph._medoid(x)).all()
    q, y = vector_graph.range_search(x, x, edges, 0.93)
    true = x @ x.T >= 0.93
    assert true[q, y].all() and len(q) >= 0.97 * true.sum() and len(set(zip(q.tolist(), y.tolist()))) == len(q)
