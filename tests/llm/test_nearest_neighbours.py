"""Nearest neighbours: exact parts against brute force, recall of the whole on the tables, odd rows, hot cells."""

from __future__ import annotations

import random

import numpy as np
import pytest

from colloquy.llm import nearest_neighbours as nn
from colloquy.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, place int, score double, query_id long"


def usable(rows):
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]


def brute(rows, queries, top=5):
    rows, out = usable(rows), {}
    width = max(len(v) for _, v in rows)
    pad = lambda v: np.pad(v, (0, width - len(v)))
    for qi in sorted({i for i, _ in usable(queries)}):
        best = {}
        for i, q in usable(queries):
            for j, v in rows if i == qi else []:
                if j != qi:
                    c = float(pad(q) @ pad(v) / np.linalg.norm(q) / np.linalg.norm(v))
                    best[j] = max(best.get(j, -2), c)
        out[qi] = sorted(((-round(c, 12), j) for j, c in best.items()))[:top]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 0.5, 3) for i, v in rows], SCHEMA).repartition(4)


def found(d):
    out = {}
    for r in sorted(d.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((-round(r.score, 12), r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({j for _, j in got.get(q, [])} & {j for _, j in w}) for q, w in want.items()) / max(1, sum(len(w) for w in want.values()))


def odd_rows(rng):
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # equal vectors: ties to the smallest ids
    rows += [(2000, [2 * x for x in rows[3][1]]), (50, None), (100, [0.0] * 12), (None, rows[1][1]), (400, [1.0, None] + [0.0] * 10), (401, [float("nan")] * 12), (402, [float("inf")] + [1.0] * 11), (403, []), (404, [1.0, 2.0, 3.0]), rows[7], rows[7], (9, rows[10][1]), (150, rows[11][1])]
    return rows


def test_hadamard():
    h = nn.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and set(np.round(np.abs(h).ravel(), 9)) == {0.25}


@pytest.mark.parametrize("parts", [1, 2])
def test_probes_begin_at_the_own_cell_and_reach_all(parts):
    h = nn.Hashing(8, parts, tables=3)
    x = np.random.default_rng(1).standard_normal((20, 8))
    table, cell = h.probes(x)
    own = h.cells(x)
    assert table.shape == (20, 3 * 16**parts)
    for k in range(20):
        first = {}
        for t, c in zip(table[k].tolist(), cell[k].tolist(), strict=True):
            first.setdefault(t, c)
        assert [first[t] for t in range(3)] == own[k].tolist()
        assert len(set(zip(table[k].tolist(), cell[k].tolist(), strict=True))) == 3 * 16**parts
    few = h.probes(x, 10)
    for k in range(20):  # equal sums may change places
        assert set(zip(few[0][k].tolist(), few[1][k].tolist(), strict=True)) <= set(zip(table[k, :16].tolist(), cell[k, :16].tolist(), strict=True))


def test_near_vectors_share_cells_more_often():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    h = nn.Hashing(64, 1)
    same = [(h.cells(x) == h.cells(x + a * rng.standard_normal(x.shape))).mean() for a in (0.1, 0.5, 2.0)]
    assert same[0] > 0.8 and same[0] > same[1] > same[2]


def test_nearest_rows_is_exact():
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (200, 4)).astype(float)
    x = x[np.abs(x).sum(1) > 0]
    ids = rng.integers(0, 90, len(x))
    q, own = x[:30], ids[:30]
    qi, row, score = nn.nearest_rows(own, q, ids, x, 5)
    for k in range(30):
        best = {}
        for i, v in zip(ids.tolist(), x, strict=True):
            if i != own[k]:
                best[i] = max(best.get(i, -2), float(nn.cosines(q[k : k + 1], v[None])[0]))
        want = sorted((-s, i) for i, s in best.items())[:5]
        assert list(zip((-score[qi == k]).tolist(), ids[row[qi == k]].tolist(), strict=True)) == want


def test_all_probes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nn, "RECALL", 1.0)
    rows = odd_rows(random.Random(1))
    queries = [r for r in rows if r[0] is not None and r[0] % 50 == 0 or r[0] in (3, 7, 1003, 404)]
    want = brute(rows, queries)
    assert len(want) > 8
    got = nn.nearest_neighbours(frame(spark, rows), frame(spark, queries))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert found(got) == want


def test_hot_cells_are_dealt_out(spark, monkeypatch):
    """A third of all rows nearly alike, and many queries in one cell: the same result in slices and blocks of ten."""
    monkeypatch.setattr(nn, "RECALL", 1.0)
    rng = random.Random(2)
    base = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, [x + 0.01 * rng.gauss(0, 1) for x in base]) for i in range(120)] + [(200 + i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(900, base)] * 60
    queries = rows[:25] + rows[130:150]
    whole = found(nn.nearest_neighbours(frame(spark, rows), frame(spark, queries)))
    monkeypatch.setattr(nn, "SLICE", 10)
    monkeypatch.setattr(nn, "BLOCK", 10)
    assert found(nn.nearest_neighbours(frame(spark, rows), frame(spark, queries))) == whole == brute(rows, queries)


def test_cells_of_two_parts(spark, monkeypatch):
    monkeypatch.setattr(nn, "CELL_ROWS", 4)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(600)]
    queries = rows[::20]
    assert recall(found(nn.nearest_neighbours(frame(spark, rows), frame(spark, queries))), brute(rows, queries)) >= 0.9


def test_fewer_candidates_than_asked(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])]
    assert found(nn.nearest_neighbours(frame(spark, rows), frame(spark, rows[:1]))) == brute(rows, rows[:1])
    assert found(nn.nearest_neighbours(frame(spark, rows[:1]), frame(spark, rows[:1]))) == {}


def test_empty_tables(spark):
    some, none = frame(spark, [(0, [1.0, 2.0])]), spark.createDataFrame([], SCHEMA)
    assert nn.nearest_neighbours(some, none).collect() == nn.nearest_neighbours(none, some).collect() == nn.nearest_neighbours(none, none).collect() == []


def test_query_s_recall_and_scores(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0])
    got = found(QUERIES["op12_nearest_neighbours"](spark, sf))
    assert set(got) == set(want) and recall(got, want) >= 0.9
    vectors = dict(usable(rows))
    for q, best in got.items():
        for c, j in best:
            a, b = vectors[q], vectors[j]
            assert abs(-c - float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))) < 1e-9
