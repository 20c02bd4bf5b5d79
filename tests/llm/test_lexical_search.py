"""Ranked lexical search against brute force over all documents and against its SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from colloquy.llm import lexical_search
from colloquy.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, n int, term string, tf long, m int, item int"
ITEMS = "item_id long, text string, item int, least int"
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(t):
    return [x.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for x in TERM.findall((t or "").encode())]


def brute(docs, items, top=50):
    vectors = [(i, Counter(w), len(w)) for i, t in docs if (w := split(t))]
    n_docs, n_terms = len(vectors), sum(n for _, _, n in vectors)
    df = Counter(t for _, c, _ in vectors for t in c)
    wanted = {}
    for i, t in items:
        if t is not None and split(t):
            wanted.setdefault(i, set()).update(split(t))
    out = []
    for item, found in wanted.items():
        scored = []
        for i, c, n in vectors:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in found if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def tables(rng, n=400):
    vocabulary = [f"w{k}" for k in range(60)] + ["Ünï", "ÀB", "漢字", "X1", "x1"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    prose = lambda k: " ".join(rng.choices(vocabulary, weights, k=k))
    docs = [(i, prose(rng.choice([1, 3, 10, 60, 200]))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,;\x00"), (None, prose(20)), (7, docs[7][1]), (7, docs[7][1]), (n + 3, "no-such\twords'here"), (n + 4, "w3 " * 30_000), *((1000 + k, docs[2][1] + " w9 w9") for k in range(120))]
    items = [(k, prose(rng.randint(1, 25))) for k in range(12)] + [(3, "w50 W51"), (20, None), (21, " .!"), (22, "unknown terms"), (None, "w1 w2"), (23, "w3")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x", 2, 3, 4) for i, t in docs], DOCS).repartition(5)
    return d, spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS)


@pytest.mark.parametrize("cells", [lexical_search.TREE_CELLS, 70 * 40])
def test_best_documents(spark, monkeypatch, cells):
    monkeypatch.setattr(lexical_search, "TREE_CELLS", cells)
    docs, items = tables(random.Random(2))
    got = lexical_search.best_documents(*frames(spark, docs, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 20)
    docs, items = tables(random.Random(4), 60)
    items = items[4:9] + [(30, " ".join(f"w{k}" for k in range(50)))]
    got = lexical_search.best_documents(*frames(spark, docs, items), top=5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, 5)


def test_branches_are_cut():
    """A document that holds the whole item cuts the branches that can't reach it; what is found stays the same."""
    rng = np.random.default_rng(3)
    terms, rows = 300, 2000
    tf = (rng.random((rows, terms)) < 0.05).astype(np.int64) * rng.integers(1, 4, (rows, terms))
    item = np.arange(100, 112)
    tf[77, item] = 3
    row, term = np.nonzero(tf)
    weight = np.sort(rng.integers(100, 9000, terms))
    m = rng.integers(60, 200, rows)
    tree = lexical_search.DocumentTree(np.arange(rows), m, row, term, tf[row, term], weight)
    assert sorted(tree.doc_id.tolist()) == list(range(rows)) and [0, rows] == list(tree.span[0])
    offered = []

    class Counting(lexical_search.Best):
        def offer(self, score, doc_id):
            offered.append(len(doc_id))
            super().offer(score, doc_id)

    best = Counting(0, 1)
    tree.search(item, weight, best)
    score = (np.where(tf > 0, lexical_search.saturated(tf, m[:, None]), 0) * weight)[:, item].sum(1)
    assert best.doc_id.tolist() == [77] and best.score.tolist() == [score.max()]
    assert sum(offered) < rows / 4
    top = lexical_search.Best(0, 50)
    tree.search(item, weight, top)
    want = sorted((-s, d) for d, s in enumerate(score.tolist()) if s)[:50]
    assert list(zip((-top.score).tolist(), top.doc_id.tolist(), strict=True)) == want


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(ORACLE_SQL["op13_lexical_search"]).fetchall()
    assert want and sorted(tuple(r) for r in QUERIES["op13_lexical_search"](spark, sf).collect()) == sorted(want)


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    assert lexical_search.best_documents(docs.limit(0), items).collect() == []
    assert lexical_search.best_documents(docs, items.limit(0)).collect() == []
