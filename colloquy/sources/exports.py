"""Caption exports: nested JSON documents, one a session, read with a fixed schema, validated, exploded and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import UNKNOWN, clean_inline, clean_speaker

#: Fixed values of the format and its limits.
SOURCES = ("google-meet-live-captions",)
MAX_BYTES, MAX_ENTRIES, MAX_CHARS, MAX_TOTAL_CHARS = 10 * 1024 * 1024, 20_000, 20_000, 2_000_000
HEALTH = "rtcOpenedAtMs double, firstCaptionMs double, lastCaptionMs double, decodedCaptions long, decodeFailures long, rtcPackets long, disconnectCount long, channelState string, hadRtcUnavailable boolean, recovered boolean, lastFailureReason string, exportedAt string"
SCHEMA = (
    "schemaVersion int, source string, meetingCode string, meetingTitle string, participants array<string>, language string, startedAt string, endedAt string, diagnosticOnly boolean, "
    f"captureHealth struct<{', '.join(':'.join(f.split()) for f in HEALTH.split(', '))}>, entries array<struct<speaker:string,text:string,kind:string,startMs:string,endMs:string>>, _corrupt_record string"
)


def read_exports(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """One row a file, with path, bytes and modified; unreadable JSON keeps _corrupt_record and nulls."""
    d = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", pattern).json(path)
    return d.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modified"))


def stream_exports(spark: SparkSession, path: str, pattern: str = "*.json", files: int = 256) -> DataFrame:
    """The same as a file stream: files are seen once, however often the stream restarts from its checkpoint."""
    return spark.readStream.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).json(path)


def is_diagnostic(d: str = "") -> Column:
    """An export without entries that says so and shows a failure."""
    health = F.col(f"{d}captureHealth")
    failed = (F.coalesce(health["decodeFailures"], F.lit(0)) > 0) | F.coalesce(health["hadRtcUnavailable"], F.lit(False))
    return F.coalesce(F.col(f"{d}diagnosticOnly"), F.lit(False)) & health.isNotNull() & (F.size(f"{d}entries") == 0) & failed


def started_at(c: Column) -> Column:
    """ISO 8601; without a zone it is UTC; null where it doesn't parse."""
    return F.try_to_timestamp(F.replace(clean_inline(c), F.lit("Z"), F.lit("+00:00")))


def refusal(sources: tuple[str, ...] = SOURCES, max_entries: int = MAX_ENTRIES, max_total_chars: int = MAX_TOTAL_CHARS, max_bytes: int = MAX_BYTES) -> Column:
    """Why an export is refused, by the first rule it breaks; null if it is valid."""
    e = F.col("entries")
    chars = F.aggregate(F.transform(e, lambda x: F.least(F.coalesce(F.length(x["text"]), F.lit(0)), F.lit(MAX_CHARS)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    rules = [
        (F.coalesce(F.col("bytes") > max_bytes, F.lit(False)), "too_large"),
        (F.col("_corrupt_record").isNotNull(), "not_json"),
        (~F.col("schemaVersion").eqNullSafe(F.lit(1)), "schema_version"),
        (~F.coalesce(F.col("source").isin(*sources), F.lit(False)), "unknown_source"),
        (started_at(F.col("startedAt")).isNull(), "started_at"),
        (e.isNull() | ((F.size(e) == 0) & ~is_diagnostic()), "no_entries"),
        (F.size(e) > max_entries, "too_many_entries"),
        (chars > max_total_chars, "too_much_text"),
    ]
    return F.coalesce(*(F.when(on, F.lit(why)) for on, why in rules))


def split_valid(exports: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(valid exports, refused ones with reason)."""
    sized = exports if "bytes" in exports.columns else exports.withColumn("bytes", F.lit(None).cast("long"))
    d = sized.withColumn("reason", refusal(**limits)).select(*exports.columns, "reason")
    return d.where("reason is null").drop("reason"), d.where("reason is not null")


def fullest(exports: DataFrame) -> DataFrame:
    """Of the exports of one session the one with the most entries, then the latest end; of equal ones the one modified first. With session, n_entries, last_ms."""
    d = exports.withColumn("session", session_id(started_at(F.col("startedAt")), F.col("meetingCode")))
    end = F.coalesce(F.array_max(F.transform("entries", lambda e: e["endMs"].try_cast("double"))), F.lit(0.0))
    d = d.withColumn("n_entries", F.size("entries")).withColumn("last_ms", end)
    best = Window.partitionBy("session").orderBy(F.desc("n_entries"), F.desc("last_ms"), "modified", "path")
    return d.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def session_id(started: Column, code: Column) -> Column:
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(clean_inline(code)), "[^a-z0-9-]+", "-"), "^-+|-+$", ""), 1, 40)
    return F.concat(F.date_format(started, "yyyy-MM-dd_HH-mm-ss"), F.lit("_meet-"), F.when(slug == "", "meet").otherwise(slug))


def entries(exports: DataFrame) -> DataFrame:
    """session, ord and the raw entry of every export: what clean.project_entries() takes."""
    d = exports.select(session_id(started_at(F.col("startedAt")), F.col("meetingCode")).alias("session"), F.posexplode("entries").alias("ord", "e"))
    return d.select("session", "ord", "e.*")


def participants(rows: DataFrame) -> DataFrame:
    """session and participants: known names once each whatever their case, first spelling and order kept; rows have session, ord, name."""
    d = rows.select("session", "ord", clean_speaker(F.col("name")).alias("name")).where(F.col("name") != UNKNOWN)
    one = d.groupBy("session", F.lower("name").alias("k")).agg(F.min(F.struct("ord", "name")).alias("first"))
    return one.groupBy("session").agg(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["name"]).alias("participants"))


def transcript_line(started: Column, start_ms: Column, speaker: Column, kind: Column, text: Column) -> Column:
    """[HH:MM:SS] speaker: text, with (chat) behind the names of chat messages."""
    at = F.timestamp_millis(F.unix_millis(started) + start_ms)
    return F.concat(F.lit("["), F.date_format(at, "HH:mm:ss"), F.lit("] "), speaker, F.when(kind == "chat", " (chat)").otherwise(""), F.lit(": "), text)


def signature(rows: DataFrame) -> DataFrame:
    """session and a hash of what an export says; its end and health don't count. rows: session, ord, speaker, kind, text, start_ms."""
    line = F.to_json(F.struct("speaker", "kind", "text", "start_ms"))
    return rows.groupBy("session").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n"), 256).alias("signature"))


def write_transcripts(lines: DataFrame, path: str) -> None:
    """One text a session as partitions of a table; a session written again replaces its own partition only."""
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(path)
