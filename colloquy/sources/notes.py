"""Transcripts and notes as text: lines, metadata, sections, and JSON inside model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, lines

LINE = r"^\[([^\]]+)\]\s+(.+?):\s*(.*)$"


def transcript_rows(texts: DataFrame, text: str = "text") -> DataFrame:
    """session, line (from 1), timestamp, speaker, is_chat, text of every line that has the transcript form."""
    d = texts.select("session", F.posexplode(lines(F.col(text))).alias("i", "raw")).withColumn("raw", F.trim("raw")).where(F.col("raw").rlike(LINE))
    who = F.regexp_extract("raw", LINE, 2)
    return d.select("session", (F.col("i") + 1).cast("long").alias("line"), F.trim(F.regexp_extract("raw", LINE, 1)).alias("timestamp"), F.trim(F.regexp_replace(who, r"\s+\(chat\)$", "")).alias("speaker"), who.rlike(r"\s\(chat\)$").alias("is_chat"), F.trim(F.regexp_extract("raw", LINE, 3)).alias("text"))


def title(markdown: Column) -> Column:
    return F.trim(F.regexp_extract(markdown, r"(?m)^#\s+(.+)$", 1))


def field(markdown: Column, label: str) -> Column:
    """The value of a line "- **Label:** value"; empty if there is none."""
    return F.trim(F.regexp_extract(markdown, rf"(?m)^-\s+\*\*\Q{label}\E:\*\*\s*(.*)$", 1))


def section(markdown: Column, heading: str) -> Column:
    """What stands under a second-level heading, up to the next one."""
    return F.regexp_replace(F.regexp_extract(markdown, rf"(?ms)^##\s+\Q{heading}\E\s*$\n(.*?)(?=^##\s|\z)", 1), r"^\s+|\s+$", "")


def bullets(markdown: Column, label: str) -> Column:
    """The bullet points right below a bold label on a line of its own."""
    block = F.regexp_extract(markdown, rf"(?m)^\*\*\Q{label}\E:\*\*\s*$\n((?:-\s+.*\n?)*)", 1)
    return F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^-\s+(.*)$"), F.lit(1)), lambda x: F.trim(x))


def newest_note(notes: DataFrame) -> DataFrame:
    """One note a session: path, modified; the newest, of equally new ones the last by path."""
    return notes.groupBy("session").agg(F.max_by("path", F.struct("modified", "path")).alias("path"), F.max("modified").alias("modified"))


def json_object(answer: Column, schema: str) -> Column:
    """The object between the first brace and the last one of a model's answer; null where it doesn't parse."""
    return F.from_json(F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit("")), schema, {"mode": "PERMISSIVE"})


#: What a session may be called, what follows it in a note's name, and the labels and headings of a note.
SESSION, NAME_TAIL = r"[A-Za-z0-9][A-Za-z0-9_.-]*", " — "
DATE, TIME, TYPE, QUALITY = "Дата", "Час", "Тип зустрічі", "Якість"
PEOPLE = ("**Присутні:**", "**Учасники:**")
SUMMARY, NOBODY = "TL;DR", "—"


def scan(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """session, path, modified and text of the newest note of each session; files with other names don't count."""
    d = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))
    stem = F.regexp_replace(F.element_at(F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/"), -1), r"\.[^.]*$", "")
    d = d.withColumn("session", F.element_at(F.split(stem, NAME_TAIL), 1)).where(F.col("session").rlike(f"^{SESSION}$"))
    return d.join(newest_note(d), ["session", "path", "modified"], "left_semi").select("session", "path", "modified", "text")


def people(markdown: Column) -> Column:
    """Names under the first of the headings PEOPLE, once each, up to a blank line, a heading or a line that is no bullet."""
    block = F.regexp_extract(markdown, r"(?dm)^[ \t]*(?:" + "|".join(rf"\Q{x}\E" for x in PEOPLE) + r")[ \t]*\n(?:[ \t]*\n)*((?:[ \t]*-.*(?:\n|\z))*)", 1)
    names = F.transform(F.split(block, "\n"), lambda x: clean_text(F.regexp_replace(F.trim(x), "^-", "")))
    return F.array_distinct(F.filter(names, lambda x: (x != "") & (x != NOBODY)))


def summary(markdown: Column) -> Column:
    """The chapter SUMMARY as one line: bullets without their dashes, an empty bullet left out."""
    body = F.regexp_extract(markdown, rf"(?dms)^##[ ]\Q{SUMMARY}\E\s*\n(.*?)(?=^##\s|^---\s*$|\z)", 1)
    return clean_text(F.array_join(F.transform(F.filter(F.split(body, "\n"), lambda x: (F.trim(x) != "") & (F.trim(x) != f"- {NOBODY}")), lambda x: F.regexp_replace(F.trim(x), "^- ", "")), " "))


def meetings(notes: DataFrame) -> DataFrame:
    """The meeting that each note tells of: session, title, meeting_date, meeting_time, meeting_type, quality, participants, tldr and note_path."""
    n = F.col("text")
    known = lambda c, other: F.when(c != "", c).otherwise(other)
    return notes.select(
        "session", known(clean_text(title(n)), F.col("session")).alias("title"), known(field(n, DATE), F.substring("session", 1, 10)).alias("meeting_date"), field(n, TIME).alias("meeting_time"),
        field(n, TYPE).alias("meeting_type"), field(n, QUALITY).alias("quality"), people(n).alias("participants"), summary(n).alias("tldr"), F.col("path").alias("note_path"),
    )
