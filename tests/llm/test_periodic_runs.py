"""Periodic runs against a brute-force version, appended at once and piece by piece, and through Spark on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from colloquy.llm import common, periodic_runs
from colloquy.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, n_runs int, start string, runs int, collapsed int, h long"


def brute(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and not any(w[i : i + length - k] == w[i + k : i + length] for k in range(1, q)):
                out.append((i, length, q))
            i = max(i + 1, j)
    return sorted(out)


def looped(doc_id, w):
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is None or not n or h % 10:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(w):
    runs = brute(w)
    lost = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    s, n, q = best or (None, None, None)
    said = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in lost)
    return len(runs), s, n, q, 1000 * n // q if runs else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def random_words(rng):
    k, w = rng.choice([1, 2, 2, 3, 5]), []
    while len(w) < rng.randint(1, 120):
        if rng.random() < 0.5:
            w += [rng.randrange(k) for _ in range(rng.randint(1, 9))]
        else:
            p = [rng.randrange(k) for _ in range(rng.randint(1, 14))]
            w += (p * rng.randint(2, 9))[: rng.randint(1, 9 * len(p))]
    return w


@pytest.mark.parametrize("seed", range(6))
def test_catcher(seed):
    rng = random.Random(seed)
    for _ in range(120):
        w = random_words(rng)
        h = common.mix(np.array(w, np.uint64) + np.uint64(77))
        whole, pieces, at = periodic_runs.SquareCatcher(), periodic_runs.SquareCatcher(), 0
        whole.append(h)
        while at < len(h):
            step = rng.choice([1, 1, 2, 5, 30])
            pieces.append(h[at : at + step])
            at += step
        assert whole.runs() == pieces.runs() == brute(w), w


def test_a_long_stretch_is_one_run():
    c = periodic_runs.SquareCatcher()
    c.append(np.arange(300_000, dtype=np.uint64) % np.uint64(777))
    assert c.runs() == [(0, 300_000, 777)]


def texts(rng):
    made = [" ".join(map(str, random_words(rng))) for _ in range(60)]
    return [*made, made[0], None, "", " \t\n", "one", "a a a a a", "a a a a a a", "x y\tx  y x\ny x y z", "ab " * 5000, "no\x85break\xa0here " * 7, "é 漢 " * 9]


def test_operator(spark):
    rows = [(i, t, 1, "x", 2, 3, 4) for i, t in enumerate(texts(random.Random(3)))]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(d, texts=True).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        r, want = got[i], expected(w)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want
        assert [tuple(x) for x in r.runs] == brute(w) and r.n_words == len(w) and hashlib.sha256(r.collapsed.encode()).hexdigest() == want[-1] and len(r.collapsed.split(" ")) >= r.n_words - r.n_dropped


def test_planted_loops(spark):
    rng = random.Random(5)
    rows = [(i, t, 1, "x", 2, 3, 4) for i in range(300) for t in [rng.choice(["q  w e\tr " * rng.randint(1, 40), "word", " ", None, " ".join(str(rng.randrange(9)) for _ in range(rng.randint(1, 200)))])]]
    rows += [(None, "z " * 20, 1, "x", 2, 3, 4), rows[7], rows[7]]
    d = spark.createDataFrame(rows, SCHEMA)
    out = periodic_runs.with_planted_loops(d)
    assert out.columns == d.columns
    assert sorted(((r.doc_id, (r.text or "").split()) for r in out.collect()), key=str) == sorted(((i, looped(i, (t or "").split())) for i, t, *_ in rows), key=str)
    got = periodic_runs.periodic_runs(out).collect()
    assert len(got) == len(rows) and [r.n_runs for r in got if r.doc_id is None] == [1]
    assert len({r.runs_sha256 + r.collapsed_sha256 for r in got if r.doc_id == 7}) == 1


def test_query_equals_brute_force(spark, sf):
    d = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op11_periodic_runs"](spark, sf).collect()
    assert len(got) == len(d)
    checked = 0
    for r in got:
        w = looped(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", d[r.doc_id] or ""))
        if len(w) < 1500:
            checked += 1
            assert tuple(r[:8])[1:] == expected(w), r.doc_id
    assert checked > 100


def test_empty_table(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []
