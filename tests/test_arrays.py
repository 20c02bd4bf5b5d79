"""Running totals and parts of texts against plain Python."""

from __future__ import annotations

import random
from itertools import accumulate

from pyspark.sql import functions as F

from colloquy.functions import arrays


def test_running(spark):
    rng = random.Random(1)
    rows = [(k, [rng.randint(-5, 9) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 31, 32, 33, 64, 1023, 1024, 1025, 3000])] + [(99, None)]
    d = spark.createDataFrame(rows, "k int, v array<int>")
    got = d.select("k", arrays.running(F.col("v"), lambda a, b: a + b, F.lit(0)).alias("s"), arrays.running(F.col("v"), lambda a, b: F.greatest(a, b), F.lit(-100)).alias("m")).collect()
    want = {k: v for k, v in rows}
    for r in got:
        v = want[r.k]
        assert (r.s, r.m) == ((None, None) if v is None else (list(accumulate(v)), list(accumulate(v, max))))


def test_parts(spark):
    t = "".join(chr(97 + k % 26) if k % 5 else "é😀"[k % 2] for k in range(2100))
    d = spark.createDataFrame([(a, b) for a in (0, 1, 511, 512, 513, 1500, 2100) for b in (0, 1, 512, 513, 1024, 1600, 2100)], "a int, b int")
    got = d.select("a", "b", arrays.part(arrays.pieces(F.lit(t)), F.col("a"), F.col("b")).alias("t")).collect()
    assert all(r.t == t[r.a : r.b] for r in got)
    assert spark.range(1).select(arrays.pieces(F.lit("")).alias("p")).first().p == []
