"""Summaries and report files as text: what a ledger says in sections, whether a summary is whole, and reports kept by marker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound
from ..functions.text import evidence_norm
from .ledger import ledger_order

#: Headings of a summary in their order, and what its sentences say.
TLDR, THESES, DECISIONS, ACTIONS, QUESTIONS = HEADINGS = ("## TL;DR", "## Основні тези", "## Рішення", "## Action items", "## Відкриті питання")
THESIS_PREFIX = {"recommendation": "Рекомендація: ", "hypothesis": "Гіпотеза: ", "proposal": "Пропозиція: "}
THESIS_TYPES = ("fact", "participant_claim", "recommendation", "hypothesis", "proposal")
NO_OWNER, DEADLINE, STILL_OPEN = "Власник не визначений", " — дедлайн: ", "Чи підтвердиться після перевірки: "
TOPICS, TOPIC_NONE, DECIDED, UNDECIDED, NEXT = "На зустрічі обговорили: ", "зміст зустрічі", "Явні рішення: ", "Явних рішень не зафіксовано.", "Наступні кроки: "
EMPTY = "- —"
#: How many decisions, actions and topics the first section names.
TOLD_DECISIONS, TOLD_ACTIONS, TOLD_TOPICS = 3, 2, 3


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"[. ]+$", "")


def representative(claims: Column) -> Column:
    """The first, middle and last claim of an array, once each whatever their spelling."""
    n = F.size(claims)
    places = F.when(n == 0, F.array().cast("array<int>")).when(n == 1, F.array(F.lit(0))).when(n == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.floor(n / 2).cast("int"), n - 1))
    told = F.filter(F.transform(places, lambda k: _bare(F.trim(F.get(claims, k)))), lambda c: c != "")
    return bound(told, lambda t: F.filter(t, lambda c, i: ~F.exists(F.slice(t, F.lit(1), i), lambda before: evidence_norm(before) == evidence_norm(c))))


def grounded_sections(items: DataFrame) -> DataFrame:
    """session, tldr, theses, decisions, actions and questions: each section's text, from evidence items only.

    items: session, item_id, type, status, claim, owners, deadline, source_order, lifecycle_reason and thematic (chosen as a theme). Of claims that
    differ in spelling only the first of a section counts. One shuffle ranks them, one gathers a session's lines.
    """
    c, key = F.col, evidence_norm(F.col("claim"))
    claim = F.trim("claim")
    owners = F.filter(F.transform("owners", lambda o: F.trim(o)), lambda o: o != "")
    action = F.concat(F.lit("["), F.when(F.size(owners) > 0, F.array_join(owners, " / ")).otherwise(NO_OWNER), F.lit("] "), claim, F.when(F.trim(F.coalesce("deadline", F.lit(""))) != "", F.concat(F.lit(DEADLINE), F.trim("deadline"))).otherwise(""))
    prefix = F.coalesce(*(F.when(c("type") == t, F.lit(p)) for t, p in THESIS_PREFIX.items()), F.lit(""))
    line = lambda on, section, text: F.when(on, F.struct(F.lit(section).alias("section"), text.alias("text")))
    lines = F.array_compact(F.array(
        line(c("type").isin(*THESIS_TYPES) & (c("status") != "superseded") & c("thematic"), "theses", F.concat(prefix, claim)),
        line((c("type") == "decision") & (c("status") == "active"), "decisions", claim),
        line((c("type") == "commitment") & (c("status") == "open"), "actions", action),
        line((c("type") == "open_question") & (c("status") == "open"), "questions", claim),
        line(c("lifecycle_reason").eqNullSafe(F.lit("conditional_decision")), "questions", F.concat(F.lit(STILL_OPEN), F.regexp_replace(claim, r"[. ?]+$", ""), F.lit("?"))),
        line(c("thematic"), "topics", claim),
    ))
    each = items.where((claim != "") & (key != "")).select("session", ledger_order().alias("o"), "item_id", key.alias("key"), F.posexplode(lines).alias("nth", "l")).select("session", "o", "item_id", "nth", "key", "l.*")
    # Topics are picked by place among all themes, so they stay whole here.
    first = F.row_number().over(Window.partitionBy("session", "section", F.when(c("section") != "topics", c("key")).otherwise(c("item_id").cast("string"))).orderBy("o", "item_id", "nth"))
    kept = each.withColumn("first", first).where("first = 1")
    by = kept.groupBy("session").agg(*(F.transform(F.array_sort(F.collect_list(F.when(c("section") == s, F.struct("o", "item_id", "nth", "text")))), lambda x: x["text"]).alias(s) for s in ("theses", "decisions", "actions", "questions", "topics")))
    every = items.select("session").distinct().join(by, "session", "left")
    none = F.array().cast("array<string>")
    every = every.select("session", *(F.coalesce(c(s), none).alias(s) for s in ("theses", "decisions", "actions", "questions", "topics")))
    told = lambda a, n: F.transform(F.slice(a, F.lit(1), F.lit(n)), _bare)
    other = told(F.when(F.size("decisions") > 0, c("decisions")).otherwise(c("actions")), TOLD_TOPICS)
    topics = bound(representative(c("topics")), lambda t: F.when(F.size(t) > 0, t).otherwise(other))
    topic = bound(topics, lambda t: F.when(F.size(t) > 0, F.array_join(t, "; ")).otherwise(TOPIC_NONE))
    decided = F.when(F.size("decisions") > 0, F.concat(F.lit(DECIDED), F.array_join(told(c("decisions"), TOLD_DECISIONS), "; "), F.lit("."))).otherwise(UNDECIDED)
    steps = F.when(F.size("actions") > 0, F.concat(F.lit(NEXT), F.array_join(F.transform(F.slice("actions", F.lit(1), F.lit(TOLD_ACTIONS)), lambda a: _bare(F.regexp_replace(a, r"^\[[^\]]+\]\s+", ""))), "; "), F.lit(".")))
    body = lambda s: F.when(F.size(s) > 0, F.array_join(F.transform(s, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(EMPTY).alias(s)
    return every.select("session", F.concat_ws(" ", F.concat(F.lit(TOPICS), topic, F.lit(".")), decided, steps).alias("tldr"), *map(body, ("theses", "decisions", "actions", "questions")))


def section(summary: Column, heading: str) -> Column:
    return F.regexp_replace(F.regexp_extract(summary, rf"(?dms)^\Q{heading}\E\s*\n(.*?)(?=^## |\z)", 1), r"(?U)^\s+|\s+\z", "")


def with_section(summary: Column, heading: str, body: Column) -> Column:
    """The summary with another text under a heading; without the heading it stays as it is."""
    safe = F.regexp_replace(F.regexp_replace(body, r"(?U)^\s+|\s+\z", ""), r"([\\$])", r"\\$1")
    out = F.regexp_replace(summary, F.lit(rf"(?dms)^\Q{heading}\E\s*\n.*?(?=^## |\z)"), F.concat(F.lit(heading + "\n"), safe, F.lit("\n\n")))
    return F.concat(F.regexp_replace(out, r"(?U)\s+\z", ""), F.lit("\n"))


def with_sections(summary: Column, sections: dict[str, Column]) -> Column:
    for heading, body in sections.items():
        summary = with_section(summary, heading, body)
    return summary


def valid_summary(summary: Column, extra_heading: Column | None = None) -> Column:
    """Whether a summary has exactly its headings in order (and one more, if given), and every action line names its owner."""
    wanted = F.array(*map(F.lit, HEADINGS))
    wanted = wanted if extra_heading is None else F.when(F.coalesce(extra_heading, F.lit("")) != "", F.concat(wanted, F.array(extra_heading))).otherwise(wanted)
    lines = F.filter(F.split(section(summary, ACTIONS), "\n"), lambda x: F.trim(x) != "")
    good = bound(lines, lambda ls: (F.size(ls) > 0) & F.forall(ls, lambda x: (x == EMPTY) | x.rlike(r"(?U)^- \[[^\]]+\]\s+\S")))
    return (F.regexp_extract_all(summary, F.lit(r"(?dm)^(## .+)$"), F.lit(1)) == wanted) & good


# Report files


def marker(evaluation: Column) -> Column:
    return F.concat(F.lit("<!-- evaluation-id: "), evaluation, F.lit(" -->"))


def with_report(existing: Column, evaluation: Column, report: Column, replace: Column) -> Column:
    """The text of a report file with one evaluation's report: appended behind a rule, or in the place of the one with its marker if it may be replaced."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    whole = F.concat(marker(evaluation), F.lit("\n"), strip(report))
    old = F.regexp_replace(existing, r"(?U)\s+\z", "")
    at = F.position(marker(evaluation), old)
    following = F.position(F.lit("\n\n---\n\n<!-- evaluation-id:"), old, at + F.length(marker(evaluation)))
    put = F.concat(F.substr(old, F.lit(1), at - 1), whole, F.when(following > 0, F.substr(old, following)).otherwise(""), F.lit("\n"))
    return F.when(existing.isNull(), F.concat(whole, F.lit("\n"))).when(at == 0, F.concat(old, F.lit("\n\n---\n\n"), whole, F.lit("\n"))).when(replace, put).otherwise(existing)


def upsert_reports(files: DataFrame, new: DataFrame) -> DataFrame:
    """file and text after new reports (file, evaluation, report, replace), one a file at a time, met by file name; other files stay."""
    return files.join(new, "file", "full").select("file", F.when(F.col("evaluation").isNull(), F.col("text")).otherwise(with_report(F.col("text"), F.col("evaluation"), F.col("report"), F.coalesce("replace", F.lit(False)))).alias("text"))
