"""Queries on reading and writing: exports, transcripts, page metadata, packets, levels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import exports as X
from ..sources import notes as N
from ..sources import packets as P
from ..sources.tables import SIGNALS_SQL, TURNS_SQL, signals, table, turns
from .registry import query


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as exports: lines are entries; some break a rule by construction."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    entry = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.col("source").alias("speaker"), x.alias("text"), F.lit(None).cast("string").alias("kind"), (i * 1000).cast("string").alias("startMs"), (i * 1000 + 500).cast("string").alias("endMs")))
    health = F.from_json(F.when(k % 9 == 0, '{"decodeFailures": 2}').otherwise('{"decodeFailures": 0}'), X.HEALTH)
    return d.select(
        "doc_id", F.when(k % 17 == 0, 2).otherwise(1).alias("schemaVersion"), F.when(k % 19 == 0, "other").otherwise(X.SOURCES[0]).alias("source"), F.col("source").alias("meetingCode"), F.when(k % 23 == 0, "soon").otherwise("2024-05-01T10:00:00Z").alias("startedAt"),
        (k % 9 == 0).alias("diagnosticOnly"), health.alias("captureHealth"), F.when(k % 3 == 0, F.slice(entry, 1, F.when(k % 6 == 0, 0).otherwise(1000).cast("int"))).otherwise(entry).alias("entries"), F.lit(None).cast("string").alias("_corrupt_record"),
    )


@query("""with e as (select doc_id, case when doc_id % 6 = 0 then [] else string_split(text, chr(10)) end as l from documents),
 r as (select doc_id, case when doc_id % 17 = 0 then 'schema_version' when doc_id % 19 = 0 then 'unknown_source' when doc_id % 23 = 0 then 'started_at' when len(l) = 0 and doc_id % 9 <> 0 then 'no_entries' when len(l) > 30 then 'too_many_entries'
  when list_sum(list_transform(l, lambda x: least(length(x), 20000))) > 5000 then 'too_much_text' end as reason, len(l) as n_entries from e) select doc_id, coalesce(reason, 'valid') as reason, n_entries from r""")
def export_validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of the split, limits scaled to these texts."""
    ok, bad = X.split_valid(_exports(spark, sf_dir), max_entries=30, max_total_chars=5000)
    return ok.withColumn("reason", F.lit("valid")).unionByName(bad).select("doc_id", "reason", F.size("entries").cast("long").alias("n_entries"))


@query(f"""with {TURNS_SQL} select session, row_number() over (partition by session order by start_ms, ord) as line, strftime(timestamp '2024-05-01 10:00:00' + to_milliseconds(start_ms), '%H:%M:%S') as timestamp, speaker, kind = 'chat' as is_chat, trim(regexp_replace(text, '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g')) as text from turns""")
def transcript_render_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as transcript text and read back from it."""
    from ..functions.text import clean_text

    t = turns(spark, sf_dir)
    line = X.transcript_line(F.lit("2024-05-01 10:00:00").cast("timestamp"), F.col("start_ms"), F.col("speaker"), F.col("kind"), clean_text(F.col("text")))
    texts = t.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return N.transcript_rows(texts)


@query(f"""with {TURNS_SQL}, p as (select session, ord, case when ord % 2 = 0 then upper(speaker) else speaker end as name from turns), f as (select session, lower(name) as k, arg_min(name, ord) as name, min(ord) as ord from p group by 1, 2)
select session, string_agg(name, ',' order by ord) as participants from f group by 1""")
def participants_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that differ in case are one participant."""
    rows = turns(spark, sf_dir).select("session", "ord", F.when(F.col("ord") % 2 == 0, F.upper("speaker")).otherwise(F.col("speaker")).alias("name"))
    return X.participants(rows).select("session", F.array_join("participants", ",").alias("participants"))


@query(r"""select page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) as title, len(regexp_extract_all(html, '<a\s[^>]*href=')) as links, len(regexp_extract_all(html, '<p[\s>]')) as paragraphs from pages""")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"), count(r"<a\s[^>]*href=").alias("links"), count(r"<p[\s>]").alias("paragraphs"))


@query(f"""with {SIGNALS_SQL} select '@dev' || session as device_id, event_id || '/@dev' || session as message_id, event_id % 5 as version, 1 as n from signals where event_id % 7 <> 0""")
def packet_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events encoded as caption packets and decoded again; every seventh one is cut off and gives nothing."""
    @F.pandas_udf(T.BinaryType())
    def packet(session: pd.Series, event: pd.Series, kind: pd.Series) -> pd.Series:
        whole = [P.encode((1, P.encode((1, f"dev{s}"), (2, int(e)), (3, int(e) % 5), (6, k), (8, 1)))) for s, e, k in zip(session, event, kind, strict=True)]
        return pd.Series([w[:-3] if e % 7 == 0 else w for w, e in zip(whole, event, strict=True)])

    d = signals(spark, sf_dir).select(P.decode_captions(packet("session", "event_id", "kind")).alias("c")).where("c.text is not null")
    return d.select("c.device_id", "c.message_id", "c.version", F.lit(1).alias("n"))


@query(f"""with {SIGNALS_SQL} select session, round(20 * log10(greatest(sqrt(avg(v * v)), 1e-12)), 6) as rms_dbfs, round(20 * log10(greatest(max(abs(v)), 1e-12)), 6) as peak_dbfs from (select session, (value % 2) - 1 as v from signals) group by 1""")
def level_dbfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample levels of a track as one aggregation."""
    v = (F.col("value") % 2) - 1
    db = lambda x: F.round(20 * F.log10(F.greatest(x, F.lit(1e-12))), 6)
    return signals(spark, sf_dir).groupBy("session").agg(db(F.sqrt(F.avg(v * v))).alias("rms_dbfs"), db(F.max(F.abs(v))).alias("peak_dbfs"))
