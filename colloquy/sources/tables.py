"""Relational tables in the roles of transcript entries, timed signals and dimensions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a temporary one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-shared-")
    return f"{folder}/{what}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as transcript entries: session, ord, speaker, kind, text, start_ms, end_ms."""
    start = (F.col("turn") * 4000).alias("start_ms")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("ord"), F.col("role").alias("speaker"),
        F.when(F.col("role") == "system", "chat").otherwise("caption").alias("kind"), "text", start,
        (start + F.least(F.length("text") * 10, F.lit(3500))).alias("end_ms"),
    )


TURNS_SQL = """turns as (select conv_id as session, turn as ord, role as speaker, case when role = 'system' then 'chat' else 'caption' end as kind,
    text, turn * 4000 as start_ms, turn * 4000 + least(length(text) * 10, 3500) as end_ms from conversations)"""


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One meeting a conversation: session, meeting_date, title, participants."""
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session")).agg(F.array_sort(F.collect_set("role")).alias("participants")).select(
        "session", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("session"), F.lit(365)).cast("int")), "yyyy-MM-dd").alias("meeting_date"),
        F.concat(F.lit("Meeting "), F.col("session")).alias("title"), "participants",
    )


MEETINGS_SQL = """meetings as (select conv_id as session, strftime(date '2024-01-01' + cast(conv_id % 365 as integer), '%Y-%m-%d') as meeting_date,
    'Meeting ' || conv_id as title, list_sort(list(distinct role)) as participants from conversations group by conv_id)"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as entries 25 s apart: session, ord, speaker, kind, text, start_ms, end_ms."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session"), F.col("source").alias("speaker"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return d.select("session", F.col("ord").cast("long").alias("ord"), "speaker", F.lit("caption").alias("kind"), "text", (F.col("ord") * 25000).cast("long").alias("start_ms"), (F.col("ord") * 25000 + 5000).cast("long").alias("end_ms"))


LINES_SQL = """split_docs as (select doc_id, source, string_split(text, chr(10)) as l from documents),
  doc_lines as (select session, speaker, 'caption' as kind, ord - 1 as ord, text, (ord - 1) * 25000 as start_ms, (ord - 1) * 25000 + 5000 as end_ms from
    (select doc_id as session, source as speaker, unnest(l) as text, unnest(range(1, len(l) + 1)) as ord from split_docs))"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed signals of a session: session, event_id, kind, ms, value."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "event_id", F.col("event_type").alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "value")


SIGNALS_SQL = "signals as (select user_id as session, event_id, event_type as kind, epoch_us(ts) // 1000 as ms, value from events)"
