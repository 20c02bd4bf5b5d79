"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a share of all words by its weight, at most CAP times its own words, and what a cap cuts off is
shared again by weight. A source is taken in complete epochs first. The rest of its target is filled in the order
of u ** (1 / w), the largest first, where u is a document's hash in (0, 1) and w its quality weight; the document
at which the running sum passes the rest gives only the words still wanted.

Null text has size 0. Null source is a source of its own, after all others. Documents of size 0 take 0. Repeated rows
count as often as they stand there; equal keys are ordered by doc_id and text hash. An empty table gives an empty result.
A source of any size spreads over buckets of its keys: only bucket sums are added up by source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, written

#: Weights in the order of the sources by code point, repeating; fixed by the contract.
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Key buckets of one source; a bucket of a source of N rows holds about N / BUCKETS.
BUCKETS = 4096


def quality_weight(text: Column, size: Column) -> Column:
    """0.5 to 1.5: documents whose mean word length is near that of prose weigh more than symbol runs or single letters."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.lit(0.5) + F.exp(-F.abs(F.log(F.greatest(mean, F.lit(0.1)) / F.lit(6.5))))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: float = CAP) -> DataFrame:
    """source, source_size, target from source, source_size. The sources are few next to the documents.

    Capped shares solve sum(min(cap * size, x * weight)) = share * sum(size) for x. Sources reach their caps in the
    order of size / weight, so x follows from running sums in that order: no loop, no collected rows.
    """
    s = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    s = s.withColumn("top", cap * F.col("source_size")).withColumn("all", share * F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("top_before", F.coalesce(F.sum("top").over(before), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("x", (F.col("all") - F.col("top_before")) / (F.col("all_w") - F.col("w_before")))
    # The first source in this order that its cap doesn't bind fixes x for itself and all after it.
    free = F.min(F.when(F.col("top") >= F.col("x") * F.col("w"), F.struct(F.col("top") / F.col("w"), F.col("x")).alias("f"))).over(everything)
    return s.withColumn("level", free["x"]).select("source", "source_size", F.coalesce(F.least(F.col("top"), F.col("level") * F.col("w")), F.col("top")).cast("double").alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: float = CAP, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken and source, one row per document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    d = d.withColumn("size", size).withColumn("th", F.xxhash64("text"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "th"), 11) + F.lit(0.5)) / F.lit(float(2**53))
    d = d.withColumn("key", F.pow(u, 1 / quality_weight(F.col("text"), F.col("size")))).select("doc_id", "source", "size", "th", "key")
    d = written(d, "mix-sizes")
    t = written(targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "mix-targets")
    d = d.withColumn("bucket", F.least(F.floor(F.col("key") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.alias("b").join(t.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "b.bucket", "before", "source_size", "target")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sums = sums.withColumn("epochs", full).withColumn("rest", (F.round(F.col("target")).cast("long") - full * F.col("source_size")))
    within = Window.partitionBy("d.source", "d.bucket").orderBy(F.col("key").desc(), "doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)
    # A running sum is needed only where the rest ends inside the bucket, but one window over all buckets costs no more passes.
    j = d.alias("d").join(sums.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket")))
    j = j.withColumn("sum_before", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("sum_before")))
    return j.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), F.col("d.source").alias("source"), "th")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).drop("th")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: float = CAP) -> DataFrame:
    """The documents that the mix takes, with their own columns and size, source_size, target and taken (which replace columns of those names)."""
    new = ("size", "source_size", "target", "taken")
    turn = Window.partitionBy("mixing__id", "mixing__text").orderBy(F.lit(0))
    m = mix_sources(docs, weights, share, cap).where("taken > 0").select(F.col("doc_id").alias("mixing__id"), F.col("th").alias("mixing__text"), *new).withColumn("mixing__turn", F.row_number().over(turn))
    m = m.select(*(F.col(c).alias(f"mix__{c}") for c in m.columns))
    d = docs.drop(*new).withColumns({"mixing__id": F.col("doc_id").cast("long"), "mixing__text": F.xxhash64("text")}).withColumn("mixing__turn", F.row_number().over(turn))
    keys = ("mixing__id", "mixing__text", "mixing__turn")
    same = [F.col(k).eqNullSafe(F.col(f"mix__{k}")) for k in keys]
    return d.join(m, same[0] & same[1] & same[2]).select(*(c for c in d.columns if c not in keys), *(F.col(f"mix__{c}").alias(c) for c in new))
