"""Cleaning of caption and speech entries by window functions.

Entries have session, ord, speaker, kind, text, start_ms, end_ms; (start_ms, ord) is their order. Every window is partitioned by
session and a further key where there is one, so work spreads with the sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MAX_TEXT, clean_inline, clean_speaker, long_text, word_tokens

REPLAY_MS, BURST_WORDS = 90_000, 4


def project_entries(raw: DataFrame) -> DataFrame:
    """Cleaned speaker and text, kind caption or chat, non-negative whole times with end >= start; empty texts go.

    Times that are no number make `bad_time` true: the whole export is refused then (see refuse_bad_times).
    """
    number = lambda c, default: F.when(F.col(c).isNull(), default).otherwise(F.expr(f"try_cast({c} as double)"))
    start, end = number("startMs", F.lit(0.0)), number("endMs", F.lit(None).cast("double"))
    d = raw.withColumns({"s__": start, "e__": end})
    bad = F.col("s__").isNull() | F.isnan("s__") | (F.abs("s__") == float("inf")) | (F.col("endMs").isNotNull() & (F.col("e__").isNull() | F.isnan("e__") | (F.abs("e__") == float("inf"))))
    whole = lambda c: F.expr(f"cast(try_cast({c} as decimal(38,6)) as bigint)")
    begin = F.greatest(F.lit(0).cast("long"), whole("s__"))
    d = d.select(
        "session", "ord", clean_speaker(F.col("speaker")).alias("speaker"), F.substring(clean_inline(F.col("text")), 1, MAX_TEXT).alias("text"),
        F.when(F.col("kind") == "chat", "chat").otherwise("caption").alias("kind"), begin.alias("start_ms"), F.greatest(begin, F.coalesce(whole("e__"), begin)).alias("end_ms"), bad.alias("bad_time"),
    )
    return d.where("text != ''")


def refuse_bad_times(entries: DataFrame) -> DataFrame:
    w = Window.partitionBy("session")
    return entries.withColumn("any_bad", F.max("bad_time").over(w)).where("not any_bad").drop("any_bad", "bad_time")


def recent_replays(entries: DataFrame, within_ms: int = REPLAY_MS, key: tuple[str, ...] = ("kind", "speaker")) -> DataFrame:
    """entries with candidate: a caption said again by the same speaker within within_ms of the last time, dropped or not."""
    said = Window.partitionBy("session", *key, F.lower("text")).orderBy("start_ms", "ord")
    again = F.col("start_ms") - F.lag("start_ms").over(said) <= within_ms
    return entries.withColumn("candidate", F.coalesce((F.col("kind") == "caption") & again, F.lit(False)))


def exact_replay_batches(entries: DataFrame, is_long: Column | None = None) -> DataFrame:
    """entries without replayed batches.

    Rows of one start time are a batch; it is a replay if a long row of it repeats one of an earlier start. Its rows that have
    been said before, earlier or in it, are dropped.
    """
    is_long = long_text(F.col("text")) if is_long is None else is_long
    same = Window.partitionBy("session", "kind", "speaker", "text")
    d = entries.withColumn("first_ms", F.min("start_ms").over(same)).withColumn("nth", F.row_number().over(same.orderBy("start_ms", "ord")))
    d = d.withColumn("replay", F.max(is_long & (F.col("first_ms") < F.col("start_ms"))).over(Window.partitionBy("session", "start_ms")))
    return d.where(~(F.col("replay") & (F.col("nth") > 1))).drop("first_ms", "nth", "replay")


def exact_dedup(entries: DataFrame, text: Column | None = None) -> DataFrame:
    """The first of chat or long entries that agree in kind, speaker and text (case counts); short captions all stay."""
    text = F.col("text") if text is None else text
    nth = F.row_number().over(Window.partitionBy("session", "kind", "speaker", text).orderBy("start_ms", "ord"))
    return entries.withColumn("nth", nth).where((F.col("nth") == 1) | ~((F.col("kind") == "chat") | long_text(F.col("text")))).drop("nth")


def merge_consecutive(rows: DataFrame, gap_ms: int) -> DataFrame:
    """Runs of one speaker whose pauses are at most gap_ms, as one row: session, run, speaker, text, start_ms, end_ms, parts."""
    by_time = Window.partitionBy("session").orderBy("start_ms", "ord")
    d = rows.withColumn("turned", (~F.col("speaker").eqNullSafe(F.lag("speaker").over(by_time))).cast("int")).withColumn("span", F.sum("turned").over(by_time))
    so_far = Window.partitionBy("session", "span").orderBy("start_ms", "ord").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("late", F.coalesce((F.col("start_ms") > F.max("end_ms").over(so_far) + gap_ms).cast("int"), F.lit(0)))
    d = d.withColumn("run", F.sum(F.col("turned") + F.col("late") - F.col("turned") * F.col("late")).over(by_time))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "ord", "text"))), lambda x: x["text"]), " ")
    return d.groupBy("session", "run").agg(F.min("speaker").alias("speaker"), texts.alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("parts"))


def latest_versions(events: DataFrame) -> DataFrame:
    """One row a key: events with session, key, arrival (unique order), version, text, at_ms.

    A version is accepted if it is above all before it; start is the first accepted arrival, text the last accepted one's.
    """
    before = Window.partitionBy("session", "key").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    ok = events.withColumn("top", F.max("version").over(before)).where("version >= 0 and (top is null or version > top)")
    return ok.groupBy("session", "key").agg(F.max("version").alias("version"), F.max_by("text", "version").alias("text"), F.min("at_ms").alias("start_ms"), F.max("at_ms").alias("end_ms"), F.count(F.lit(1)).alias("accepted"))


def closing_excerpt(rows: DataFrame, least_ms: int, last_ms: int, jump_ms: int) -> DataFrame:
    """The last last_ms of sessions of at least least_ms; a jump back of more than jump_ms is a midnight passed."""
    by = Window.partitionBy("session").orderBy("ord")
    d = rows.withColumn("rolled", F.coalesce((F.lag("ms").over(by) - F.col("ms") > jump_ms).cast("long"), F.lit(0)))
    d = d.withColumn("abs_ms", F.col("ms") + 86_400_000 * F.sum("rolled").over(by))
    all_ = Window.partitionBy("session")
    d = d.withColumns({"from_ms": F.min("abs_ms").over(all_), "to_ms": F.max("abs_ms").over(all_)})
    return d.where((F.col("to_ms") - F.col("from_ms") >= least_ms) & (F.col("abs_ms") >= F.col("to_ms") - last_ms)).drop("rolled", "from_ms", "to_ms")


def split_at_last(rows: DataFrame, mark: Column) -> DataFrame:
    """rows with part: prefix up to the last row where mark holds, suffix after it; all suffix where it holds nowhere."""
    last = F.max(F.when(mark, F.col("ord"))).over(Window.partitionBy("session"))
    return rows.withColumn("part", F.when(F.col("ord") <= last, "prefix").otherwise("suffix"))


def burst_words() -> Column:
    return F.size(word_tokens(F.col("text")))


#: What a report in the right language has at least.
CYRILLIC_LETTERS, CYRILLIC_SHARE = 300, 0.45


def in_ukrainian(report: Column) -> Column:
    """Whether a report's own words, its quoted lines aside, have enough Cyrillic letters and a large enough share of them."""
    own = F.array_join(F.filter(F.split(F.coalesce(report, F.lit("")), "\n"), lambda x: ~F.ltrim(x).startswith(">")), "\n")
    cyrillic, latin = F.regexp_count(own, F.lit("[А-Яа-яІіЇїЄєҐґ]")), F.regexp_count(own, F.lit("[A-Za-z]"))
    return (cyrillic >= CYRILLIC_LETTERS) & (cyrillic / (cyrillic + latin) >= CYRILLIC_SHARE)


def compact_chats(entries: DataFrame) -> DataFrame:
    """Entries of two characters and more, of chat messages with one speaker and text (its case aside) the first only."""
    key = F.when(F.col("kind") == "chat", F.lower("text")).otherwise(F.col("ord").cast("string"))
    nth = F.row_number().over(Window.partitionBy("session", "kind", F.when(F.col("kind") == "chat", F.col("speaker")), key).orderBy("ord"))
    return entries.where(F.length("text") >= 2).withColumn("compact__nth", nth).where("compact__nth = 1").drop("compact__nth")
