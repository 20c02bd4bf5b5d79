"""Speech segments and speaker turns: clipping, time lines, overlap attribution, cross-track duplicates, speaker clusters."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed limits of the speech model's own scores.
NO_SPEECH_SURE, NO_SPEECH, LOW_LOGPROB, LOOP_LOGPROB, LOOP_RATIO = 0.75, 0.60, -0.5, -1.0, 2.8
UNKNOWN = "UNKNOWN"


def clip_and_reject(segments: DataFrame, duration: Column) -> DataFrame:
    """Segments cut to [0, duration]; empty ones, silence and loops by the model's scores go. Missing scores accuse nobody."""
    d = segments.withColumns({"start": F.greatest(F.lit(0.0), F.col("start")), "end": F.least(duration, F.col("end"))})
    silent = (F.col("no_speech_prob") >= NO_SPEECH_SURE) | ((F.col("no_speech_prob") > NO_SPEECH) & (F.col("avg_logprob") < LOW_LOGPROB))
    loop = (F.col("compression_ratio") > LOOP_RATIO) & (F.col("avg_logprob") < LOOP_LOGPROB)
    empty = (F.trim("text") == "") | (F.col("start") >= duration) | (F.col("end") <= F.col("start"))
    return d.where(~(F.coalesce(silent, F.lit(False)) | F.coalesce(loop, F.lit(False)) | F.coalesce(empty, F.lit(True))))


def affine_timeline(segments: DataFrame, offset: Column, scale: Column, until: Column) -> DataFrame:
    """Times moved to offset + t * scale and cut to [0, until]; what has no length left goes."""
    d = segments.withColumns({"start": F.greatest(F.lit(0.0), offset + F.col("start") * scale), "end": F.least(until, offset + F.col("end") * scale)})
    return d.where(F.col("end") > F.col("start"))


def local_speakers(speaker: Column) -> Column:
    """Labels of the local track: SPEAKER_n and unknown ones get names of their own."""
    s = F.coalesce(speaker, F.lit(UNKNOWN))
    return F.when(s.startswith("SPEAKER_"), F.concat(F.lit("LOCAL_"), F.substring(s, 9, 100))).when(s == UNKNOWN, "LOCAL_UNKNOWN").otherwise(s)


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long")))


def overlap_speakers(segments: DataFrame, turns: DataFrame, width: float) -> DataFrame:
    """segments (session, seg_id, start, end) with the speaker that overlaps longest, UNKNOWN where none does.

    turns: session, turn_ord, start, end, speaker. A range join as an equi-join: both sides are dealt into time buckets of `width`, and
    a pair counts in the bucket where its overlap begins only. Ties go to the speaker whose first overlapping turn comes first.
    """
    a = segments.select("session", "seg_id", F.col("start").alias("s0"), F.col("end").alias("s1"), _buckets(F.col("start"), F.col("end"), width).alias("bucket"))
    b = turns.select("session", "turn_ord", "speaker", F.col("start").alias("t0"), F.col("end").alias("t1"), _buckets(F.col("start"), F.col("end"), width).alias("bucket"))
    hit = a.join(b, ["session", "bucket"]).where((F.col("s0") < F.col("t1")) & (F.col("t0") < F.col("s1")) & (F.floor(F.greatest("s0", "t0") / width) == F.col("bucket")))
    by = hit.groupBy("session", "seg_id", "speaker").agg(F.sum(F.least("s1", "t1") - F.greatest("s0", "t0")).alias("overlap"), F.min("turn_ord").alias("first_turn"))
    best = by.groupBy("session", "seg_id").agg(F.max_by(F.struct("speaker", "overlap"), F.struct("overlap", (-F.col("first_turn")).alias("o"))).alias("best"))
    return segments.join(best, ["session", "seg_id"], "left").select(segments["*"], F.coalesce("best.speaker", F.lit(UNKNOWN)).alias("speaker"), F.coalesce("best.overlap", F.lit(0)).alias("overlap"))


def leaks(mic: DataFrame, system: DataFrame, window_ms: int, same: Column, slow: Column | None = None) -> DataFrame:
    """mic without rows that also stand in system at about the same time: both have at least four words, mine sixteen characters.

    Columns session, id, start_ms, end_ms, norm (normalised text), tokens. `same` compares m.* with o.*, `slow` those pairs that same lets pass.
    Buckets of time make the band an equi-join.
    """
    wide = 10 * window_ms
    bucket = lambda pad: F.explode(F.sequence(F.floor((F.col("start_ms") - pad) / wide), F.floor((F.col("end_ms") + pad) / wide)))
    m = mic.where((F.size("tokens") >= 4) & (F.length("norm") >= 16)).withColumn("bucket", bucket(window_ms)).alias("m")
    o = system.where(F.size("tokens") >= 4).withColumn("bucket", bucket(0)).alias("o")
    near = (F.col("m.session") == F.col("o.session")) & (F.col("m.bucket") == F.col("o.bucket")) & (F.col("o.end_ms") >= F.col("m.start_ms") - window_ms) & (F.col("o.start_ms") <= F.col("m.end_ms") + window_ms)
    if slow is None:
        gone = m.join(o, near & same, "left_semi").select("session", "id").distinct()
    else:
        # A pair may share several buckets; the one where both have begun is enough.
        once = F.greatest(F.floor((F.col("m.start_ms") - window_ms) / wide), F.floor(F.col("o.start_ms") / wide)) == F.col("m.bucket")
        gone = m.join(o, near & once & same).where(slow).select("m.session", "m.id").distinct()
    return mic.join(gone, ["session", "id"], "left_anti")


def may_agree(a: Column, b: Column, least: float) -> Column:
    """Whether the lengths of two texts allow that sequence ratio: it is at most twice the shorter over both."""
    return 2 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))


def sequences_agree(a: Column, b: Column, least: float) -> Column:
    """Whether the Ratcliff-Obershelp ratio of two texts reaches least; the order of the arguments matters.

    Shared letters bound the ratio from above and are counted first.
    """

    @F.pandas_udf(T.BooleanType())
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        made = (difflib.SequenceMatcher(None, p or "", q or "") for p, q in zip(x, y, strict=True))
        return pd.Series([m.quick_ratio() >= least and m.ratio() >= least for m in made], dtype="bool")

    return agree(a, b)


def collapse_speakers(segments: DataFrame) -> DataFrame:
    """Sessions with three labels and more of which one has 95 % of the time and every other at most 15 s or 1 % become one speaker."""
    d = segments.where(F.coalesce("speaker", F.lit(UNKNOWN)) != UNKNOWN).groupBy("session", "speaker").agg(F.sum(F.greatest(F.lit(0.0), F.col("end") - F.col("start"))).alias("t"))
    per = d.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("total"), F.max("t").alias("top"), F.array_sort(F.collect_list("t")).alias("each"))
    others = F.slice("each", F.lit(1), F.greatest(F.size("each") - 1, F.lit(0)))
    small = F.forall(others, lambda x: x <= F.greatest(F.lit(15.0), F.col("total") * 0.01))
    yes = (F.col("n") >= 3) & (F.col("total") > 0) & (F.col("top") >= 0.95 * F.col("total")) & small
    return segments.join(per.where(yes).select("session", F.lit(True).alias("collapse")), "session", "left").withColumn("speaker", F.when(F.col("collapse"), "SPEAKER_00").otherwise(F.coalesce("speaker", F.lit(UNKNOWN)))).drop("collapse")


def merge_words(words: DataFrame, gap: float = 1.0) -> DataFrame:
    """Words of one speaker with pauses up to gap joined to segments; a word list comes in input order (ord).

    Punctuation closes up to the word before it.
    """
    w = Window.partitionBy("session").orderBy("ord")
    d = words.withColumn("turned", (~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))).cast("int")).withColumn("span", F.sum("turned").over(w))
    before = F.max("end").over(Window.partitionBy("session", "span").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("cut", F.when(F.col("turned") == 1, 1).when(F.col("start") - before > gap, 1).otherwise(0)).withColumn("run", F.sum("cut").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.trim("text").alias("t")))), lambda x: x["t"]), " ")
    out = d.where(F.trim("text") != "").groupBy("session", "run").agg(F.min("speaker").alias("speaker"), F.min("start").alias("start"), F.max("end").alias("end"), F.regexp_replace(text, r"\s+([,.;:!?])", "$1").alias("text"))
    return out
