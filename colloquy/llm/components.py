"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MOST_ROUNDS = 40


def _least(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each node's least neighbour or itself; partial minima are taken before the shuffle, so a hub costs no more than others."""
    return edges.groupBy(F.col(a).alias("n")).agg(F.min(b).alias("m")).withColumn("m", F.least("n", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    j = both.join(_least(both, "a", "b"), both["a"] == F.col("n"))
    return j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    j = down.join(_least(down, "a", "b"), down["a"] == F.col("n"))
    return j.select("b", "m").union(j.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link, root being the least node reachable; links has columns a and b of one ordered type.

    Every round is written to the shared folder; the table shrinks to one row per node. Self links and repeats are ignored.
    """
    edges = written(links.select("a", "b").where("a != b").distinct(), "links")
    seen = None
    for _ in range(MOST_ROUNDS):
        edges = written(_small_star(_large_star(edges)), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
