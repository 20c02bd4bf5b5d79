"""Capture and summary quality: metrics, issues, report status; session classifiers; report rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, n_words, says

#: Fixed limits.
UNKNOWN_ERROR, UNKNOWN_WARNING, DRIFT = 0.35, 0.15, 0.005
#: Names that stand for an unknown speaker.
UNKNOWN_SPEAKER = r"(?iuU)^(?:невідомий|unknown|local_unknown|учасник(?:\s+\S+)?)$"


def capture_metrics(entries: DataFrame, unknown: Column | None = None) -> DataFrame:
    """One row a session: captions, chats, unknown_ratio (1 without captions), max_gap_ms between caption starts."""
    unknown = F.coalesce(clean_text(F.col("speaker")).rlike(UNKNOWN_SPEAKER), F.lit(False)) if unknown is None else unknown
    caption = F.col("kind") != "chat"
    starts = Window.partitionBy("session", caption).orderBy("start_ms")
    d = entries.withColumn("gap", F.when(caption, F.col("start_ms") - F.lag("start_ms").over(starts)))
    ratio = F.coalesce(F.avg(F.when(caption, unknown.cast("double"))), F.lit(1.0))
    return d.groupBy("session").agg(F.count_if(caption).alias("captions"), F.count_if(~caption).alias("chats"), ratio.alias("unknown_ratio"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap_ms"))


def issues(rows: DataFrame, rules: Sequence[tuple[str, str, Column]], keep: Sequence[str] = ("session",)) -> DataFrame:
    """(keep, code, severity) for every rule that holds, in one pass."""
    each = F.filter(F.array(*(F.when(on, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, on in rules)), lambda x: x.isNotNull())
    return rows.select(*keep, F.explode(each).alias("i")).select(*keep, "i.code", "i.severity")


def capture_rules() -> list[tuple[str, str, Column]]:
    """Over capture_metrics with health counters (null where there is no health record)."""
    c = F.col
    return [
        ("capture_health_missing", "warning", ~c("has_health")),
        ("no_captions", "error", c("captions") == 0),
        ("rtc_unavailable", "error", c("unavailable") & ~c("recovered")),
        ("rtc_recovered", "warning", c("unavailable") & c("recovered")),
        ("rtc_disconnects", "warning", c("disconnects") > 0),
        ("decode_failures", "warning", c("decode_failures") > 0),
        ("slow_rtc_start", "warning", c("open_ms") > 30_000),
        ("unknown_speakers_high", "error", c("unknown_ratio") > UNKNOWN_ERROR),
        ("unknown_speakers", "warning", (c("unknown_ratio") > UNKNOWN_WARNING) & (c("unknown_ratio") <= UNKNOWN_ERROR)),
    ]


def status(errors: Column, all_issues: Column) -> Column:
    return F.when(errors > 0, "review").when(all_issues > 0, "medium").otherwise("high")


def report(sessions: DataFrame, found: DataFrame) -> DataFrame:
    """session, status, n_issues, n_errors; sessions without issues are high."""
    per = found.groupBy("session").agg(F.count(F.lit(1)).alias("n_issues"), F.count_if(F.col("severity") == "error").alias("n_errors"))
    d = sessions.join(per, "session", "left").fillna(0, ["n_issues", "n_errors"])
    return d.select("session", status(F.col("n_errors"), F.col("n_issues")).alias("status"), "n_issues", "n_errors")


def union_issues(parts: Sequence[DataFrame]) -> DataFrame:
    """All issues once each, the first source's row kept: (session, code, severity, source)."""
    tagged = [p.select("session", "code", "severity", F.lit(k).alias("source")) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, tagged).groupBy("session", "code", "severity").agg(F.min("source").alias("source"))


def audio_status(unknown_ratio: Column, scale: Column) -> Column:
    """review over the error limit, medium over the warning limit or with a drifting clock, else high."""
    drift = F.abs(scale - 1) > DRIFT
    return F.when(unknown_ratio > UNKNOWN_ERROR, "review").when((unknown_ratio > UNKNOWN_WARNING) | drift, "medium").otherwise("high")


def confidence_cap(situations: Column, strong: Column) -> Column:
    return F.when(situations == 0, "Low").when((situations >= 3) & strong, "High").otherwise("Medium")


#: Title and text cues of meeting types, in order of precedence.
MEETING_TYPES: tuple[tuple[str, str], ...] = (
    ("one_on_one", r"1\s*[:x]\s*1|one[- ]on[- ]one|ван[- ]ту[- ]ван"),
    ("standup", r"stand[- ]?up|daily|стендап\w*|дейл[іи]|щоденн\w*\s+(?:зустріч|синк)"),
    ("design_review", r"design\s+(?:review|critique)|дизайн[- ]?рев['’]?ю|рев['’]?ю\s+дизайн|дизайн\w*\s+(?:макет|дашборд)|макет\w*\s+дизайн"),
    ("discovery", r"discovery|user\s+interview|customer\s+interview|research\s+interview|дослідженн\w*|кастдев\w*|інтерв['’]?ю\s+(?:з\s+)?(?:користувач\w*|клієнт\w*)"),
    ("planning", r"sprint\s+planning|roadmap|refinement|grooming|плануванн\w*|планування\s+спринту|роадмап\w*|беклог\w*"),
)
SAMPLE_CHARS = 80_000


def meeting_type(title: Column, transcript: Column, cues: Sequence[tuple[str, str]] = MEETING_TYPES) -> Column:
    """The first type whose cue is in the title, else the first found twice in the first SAMPLE_CHARS characters, else general."""
    whole = [(t, rf"(?iuU)\b(?:{p})\b") for t, p in cues]
    sample = F.substring(transcript, 1, SAMPLE_CHARS)
    by_title = [F.when(title.rlike(p), t) for t, p in whole]
    by_text = [F.when(F.regexp_count(sample, F.lit(p)) >= 2, t) for t, p in whole]
    return F.coalesce(*by_title, *by_text, F.lit("general"))


#: Cues of interviews that did not take place or ended early.
EARLY = r"краще\s+не\s+витрачати\s+час|не\s+(?:буду|хочу|варто)\s+продовж|не\s+розглядаю\s+для\s+себе|не\s+співпадає.+професійн|(?:let'?s|we\s+should)\s+(?:stop|end)\s+here|(?:withdraw|not\s+interested|not\s+a\s+fit)"
CANCELLED = r"не\s+прийш(?:ов|ла)|не\s+з['’]?явив|no[- ]show|перенес(?:емо|ти)\s+зустріч|reschedul|cancelled"
TECHNICAL = r"не\s+(?:чути|видно)|проблем\w*\s+з\s+(?:мікрофон|камер|звук|інтернет)|technical\s+(?:issue|problem)|зв['’]?язок\s+обірвав"


def interview_outcome(rows: DataFrame, early: str = EARLY, cancelled: str = CANCELLED, technical: str = TECHNICAL) -> DataFrame:
    """session, outcome, lines, words, candidate_lines, candidate_words from session, ord, text, is_candidate.

    Per session one aggregation: the first row of each cue family and the last three rows decide with the counts.
    """
    cue = lambda p: F.col("text").rlike(f"(?iuU){p}")
    first = lambda p: F.min(F.when(cue(p), F.struct("ord", "text", "is_candidate")))
    nth_last = F.row_number().over(Window.partitionBy("session").orderBy(F.col("ord").desc()))
    w = n_words(F.col("text"))
    s = rows.withColumn("from_end", nth_last).groupBy("session").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(w).alias("words"), F.count_if("is_candidate").alias("candidate_lines"), F.coalesce(F.sum(F.when(F.col("is_candidate"), w)), F.lit(0)).alias("candidate_words"),
        first(early).alias("early"), first(cancelled).alias("cancelled"), first(technical).alias("technical"), F.min(F.when(F.col("from_end") <= 3, F.col("ord"))).alias("tail"),
    )
    c = F.col
    limited = (c("candidate_lines") < 4) | (c("candidate_words") < 180)
    outcome = (
        F.when(c("early").isNotNull() & c("early.is_candidate") & (c("early.ord") >= c("tail")) & limited, "early_terminated")
        .when(c("cancelled").isNotNull() & (c("lines") <= 20), "cancelled_no_show")
        .when(c("technical").isNotNull() & (c("words") < 180), "technical_failure")
        .when((c("candidate_lines") == 0) & (c("lines") >= 8) & (c("words") >= 180), "identity_unresolved")
        .when((c("candidate_lines") < 2) | (c("candidate_words") < 40), "insufficient_content")
        .otherwise("completed")
    )
    return s.select("session", outcome.alias("outcome"), "lines", "words", "candidate_lines", "candidate_words")


#: Cyrillic letters and what they become; the first three strings are letter by letter.
SINGLE = ("абвгґдезиіїйклмнопрстуфыэ", "abvhgdezyiiiklmnoprstufye")
SEVERAL = {"є": "ie", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ь": "", "ю": "iu", "я": "ia", "ъ": "", "ё": "io"}
#: Openings of a first name that spellings disagree on; they lose their first letter.
LOOSE_OPENINGS = ("ie", "ye", "iu", "yu", "ia", "ya", "yi")


def name_key(name: Column) -> Column:
    """Latin letters and digits of a name in either script."""
    out = F.translate(F.lower(name), *SINGLE)
    for a, b in SEVERAL.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, "[^a-z0-9]+", "")


def name_parts(name: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(name), r"(?U)\s+"), name_key), lambda x: x != "")


def person_keys(parts: Column) -> Column:
    """What two names must share to mean one person: all parts in order, or first (loosely) and last name either way round."""
    first = lambda k: F.when(F.substring(k, 1, 2).isin(*LOOSE_OPENINGS), F.substring(k, 2, 200)).otherwise(k)
    a, b = F.element_at(parts, 1), F.element_at(parts, -1)
    pairs = F.array(F.concat_ws("|", F.lit("pair"), first(a), b), F.concat_ws("|", F.lit("pair"), first(b), a))
    whole = F.array(F.concat_ws("|", F.lit("all"), F.array_join(parts, " ")))
    return F.when(F.size(parts) >= 2, F.array_union(whole, pairs)).when(F.size(parts) == 1, whole).otherwise(F.array().cast("array<string>"))


def same_person(left: Column, right: Column) -> Column:
    return F.arrays_overlap(person_keys(name_parts(left)), person_keys(name_parts(right)))


def role_level(spec: Column, levels: Sequence[str]) -> tuple[Column, Column]:
    """(role, level) of a target: the level if exactly one of the level words is in it, and the rest; else all of it and nothing."""
    found = F.array_distinct(F.filter(F.split(F.upper(spec), r"\s+"), lambda x: x.isin(*levels)))
    one = F.size(found) == 1
    rest = F.trim(F.regexp_replace(F.array_join(F.filter(F.split(spec, r"\s+"), lambda x: ~F.array_contains(found, F.upper(x))), " "), r"\s+", " "))
    return F.when(one, rest).otherwise(spec), F.when(one, F.element_at(found, 1)).otherwise("")


def keyword(c: Column, words: Sequence[str]) -> Column:
    return says(c, "|".join(words))
