"""Queries on folds; tests hold some of the folds against row-at-a-time models, and all of them at several sizes of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import evidence_norm
from ..operators import clean, fold
from ..sources.tables import document_lines, signals, table, turns
from .registry import query


@query()
def replay_burst_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as captions of four and more words; an hour stands in for the burst's 100 ms."""
    s = signals(spark, sf_dir).select("session", F.col("event_id").alias("ord"), F.col("kind").alias("speaker"), F.lit("caption").alias("kind"), F.concat(F.lit("one two three "), "kind").alias("text"), F.col("ms").alias("start_ms"))
    return fold.drop_bursts(clean.recent_replays(s, 43_200_000), 3_600_000).select("session", "ord", "candidate")


@query()
def caption_related_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.merge_related(document_lines(spark, sf_dir))


@query()
def turn_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.assemble_turns(turns(spark, sf_dir).withColumn("speaker", F.when(F.col("speaker") == "system", "assistant").otherwise(F.col("speaker"))), 9_000, 90_000)


@query()
def periodic_repetition_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.drop_periodic(document_lines(spark, sf_dir).select("session", "ord", evidence_norm(F.col("text")).alias("phrase"), "start_ms"))


@query()
def ledger_greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of an order's customer, near-equal by construction of their parts."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    items = o.select(
        F.col("o_custkey").alias("session"), k.alias("item_id"), F.when(k % 2 == 0, "decision").otherwise("proposal").alias("type"), F.lit("open").alias("status"), F.concat_ws(" ", F.lit("ship order of"), "o_orderpriority", F.date_format("o_orderdate", "MMMM")).alias("claim"),
        F.lit("").alias("deadline"), (k % 1000).cast("long").alias("source_order"), F.array(F.concat(F.lit("clerk "), k % 5)).alias("owners"), F.array(F.concat(F.lit("quote number "), k)).alias("quotes"),
    )
    d = fold.greedy_dedup(items)
    return d.select("session", "item_id", "type", "source_order", "merged", F.size("owners").alias("n_owners"), F.size("quotes").alias("n_quotes"))


@query()
def theme_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return fold.diverse_selection(o.select(F.col("o_custkey").alias("session"), k.alias("item_id"), F.when(k % 3 == 0, "fact").otherwise("proposal").alias("type"), F.when(k % 2 == 0, "high").otherwise("low").alias("confidence"),
                                           F.concat_ws(" ", "o_orderpriority", F.date_format("o_orderdate", "MMMM yyyy EEEE")).alias("claim"), (k % 1000).cast("long").alias("source_order"), F.array(F.concat(F.lit("q"), k)).alias("quotes")))


@query()
def chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.pack_lines(document_lines(spark, sf_dir).select("session", "ord", "text"), 2000).select("session", "ord", "chunk")
