"""Candidate reports in Markdown: their rules, one row for each that is broken, and the repairs made before they are checked.

All of it is one pass over the rows of a table of reports (report, and where known candidate, target, stage, evidence, transcript, debrief), without a
shuffle. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import evidence as E

#: Fields that a report must have.
FIELDS = (
    "Статус рішення", "Етап співбесіди", "Продемонстрований рівень", "Сигнали наступного рівня", "Цільова роль",
    "Цільовий рівень", "Відповідність цільовому рівню", "Рекомендація поточного етапу", "Фінальна рекомендація щодо найму", "Критичні компетенції перевірено",
)
STATUS, STAGE, ROLE, LEVEL, FIT, FINAL, CRITICAL = (FIELDS[k] for k in (0, 1, 4, 5, 6, 8, 9))
#: What a recommendation can say.
HIRE, REJECT = ("наймати", "скоріше наймати"), ("скоріше не наймати", "не наймати")
#: The dimensions that a report scores, and their names in evidence.
DIMENSIONS = {
    "Мотивація": ("motivation", "мотивація"),
    "Релевантність досвіду": ("experience relevance", "experience_relevance", "релевантність досвіду"),
    "Критичне мислення": ("critical thinking", "critical_thinking", "критичне мислення"),
    "Рефлексія": ("reflection", "рефлексія"),
    "Усвідомлення упереджень": ("bias awareness", "bias_awareness", "усвідомлення упереджень"),
}
REFLECTION, BIAS = "Рефлексія", "Усвідомлення упереджень"
STRONG_TYPES = ("candidate_live", "corroborated")
CHAIN = ("own_mistake", "lesson", "behavior_change")
BIAS_SIGNALS = ("bias_probe", "bias_update", "bias_mitigation", "observed_bias")
NEGATIVE_SIGNALS = ("needs_guidance", "limited_autonomy", "linear_thinking", "missed_optimization", "execution_only", "confusion")
HIGH, MEDIUM, LOW = "Висока", "Середня", "Низька"
LEVEL_WORDS = r"(?:intern|trainee|junior|middle|mid|senior|lead|staff|principal|ic\s*\d+|l\s*\d+)"
NOT_SUPPLIED = ("не задан", "not supplied", "—")
REPEATED = r"повторюван\w*\s+(?:патерн|шаблон)|стійк\w*\s+(?:патерн|шаблон)|систематичн\w*\s+(?:поведін|прояв|помил)"
AFFINITY = r"подоба\w*|сподоба\w*|понрав\w*|типаж|схож\w*\s+(?:на\s+)?(?:мене|нас)|люблю\s+таких|близьк\w*\s+(?:мені|нам)\s+люд"
NAMES_AFFINITY = r"similarity|affinity|схож|подібн|симпат|типаж"
DENIES = r"не\s+(?:виявлен|зафіксован|спостережен)|відсутн"
NO_DATA = r"не перевір|немає даних|відсутн\w+(?:\s+дан|\s+доказ)"
CONTRADICTS = r"супереч|contradict|прям\w+\s+негатив"
UNTESTED = r"не\s+перевір|не\s+підтвердж|немає\s+(?:даних|доказів)|не\s+згадан|даних\s+недостатньо"
RISKS, SELF_CHECK = "Основні ризики найму", "Самоперевірка упереджень оцінювача"
INTERVIEWERS = "Інтерв’юери"
#: What each broken rule says; %s is the field, dimension, evidence id or level.
MESSAGES = {
    "missing_field": "поле `%s`",
    "malformed_id": "некоректно відформатовані evidence ID",
    "stage_mismatch": "етап у звіті не узгоджений з метаданими зустрічі",
    "final_status_early": "фінальний статус на нефінальному етапі",
    "final_recommendation_early": "фінальна hiring-рекомендація на нефінальному етапі",
    "final_with_preliminary_status": "фінальна hiring-рекомендація має попередній статус",
    "final_without_level": "фінальна рекомендація без однозначного target level",
    "final_without_role": "фінальна рекомендація без однозначної target role",
    "final_unverified": "фінальна рекомендація з неперевіреними критичними компетенціями",
    "hire_against_fit": "позитивна hiring-рекомендація не узгоджена з target fit",
    "fit_without_target": "target fit задано без однозначних target role і level",
    "fit_missing": "target fit відсутній попри однозначні target role і level",
    "role_lost": "звіт втратив задану target role",
    "level_lost": "звіт втратив заданий target level",
    "level_invented": "звіт вигадав target level",
    "candidate_as_interviewer": "кандидат помилково вказаний серед інтерв’юерів",
    "pattern_without_examples": "повторюваний патерн заявлено без двох незалежних прикладів",
    "quote_not_in_evidence": "цитата `[E%s]` не підтверджена evidence ledger",
    "quote_not_in_transcript": "цитата `[E%s]` не знайдена у транскрипті",
    "score_without_time": "числова оцінка `%s` без таймкодованої цитати",
    "score_without_id": "числова оцінка `%s` без evidence ID",
    "unknown_id": "`%s` посилається на невідомі evidence ID",
    "confidence_too_high": "висока впевненість `%s` без трьох незалежних situations і live/corroborated evidence",
    "reflection_chain": "рефлексія 3+ без ланцюжка own_mistake → lesson → behavior_change",
    "bias_without_signal": "числова оцінка bias awareness без прямого bias-сигналу",
    "reflection_denied": "рефлексію позначено Недостатньо даних попри прямий lesson/behavior_change evidence",
    "affinity_not_named": "self-check не відобразив similarity/affinity bias з debrief",
    "below_without_data": "рівень `%s` позначено Нижче лише через відсутність даних",
    "risk_without_id": "ризик найму без evidence ID",
    "untested_as_risk": "неперевірену компетенцію помилково оформлено як ризик найму",
}
BREACH = "array<struct<code:string,subject:string>>"


def has(c: Column, pattern: str) -> Column:
    return c.rlike("(?diuU)" + pattern)


def _starts(c: Column, words: Sequence[str]) -> Column:
    return reduce(Column.__or__, ((c == w) | c.startswith(w + " ") | c.startswith(w + "—") for w in words))


def _any_of(c: Column, words: Sequence[str]) -> Column:
    return reduce(Column.__or__, (F.contains(c, F.lit(w)) for w in words))


def explicit_level(target: Column, levels: Sequence[str]) -> Column:
    """Whether the target names exactly one level, of the given ones and the common ones; mid is middle."""
    same = lambda x: F.when(x == "mid", "middle").otherwise(x)
    own = [F.when(has(target, rf"(?<!\w)\Q{x}\E(?!\w)"), same(F.lit(x.lower()))) for x in map(str.strip, levels) if len(x) >= 2]
    common = F.transform(F.regexp_extract_all(target, F.lit(rf"(?iU)(?<!\w)({LEVEL_WORDS})(?!\w)"), F.lit(1)), lambda x: same(F.lower(F.regexp_replace(x, r"\s+", ""))))
    return F.size(F.array_distinct(F.concat(F.array_compact(F.array(*own)) if own else F.array().cast("array<string>"), common))) == 1


def explicit_role(target: Column, levels: Sequence[str]) -> Column:
    """Whether the target says more than levels."""
    for x in sorted({x.strip() for x in levels if x.strip()}, key=lambda x: (-len(x), x)):
        target = F.regexp_replace(target, rf"(?iuU)(?<!\w)\Q{x}\E(?!\w)", " ")
    return F.regexp_replace(F.regexp_replace(target, rf"(?iuU)(?<!\w){LEVEL_WORDS}(?!\w)", " "), r"(?U)[\s/|,;:()\-]+", "") != ""


def final_stage(stage: Column) -> Column:
    return has(stage, r"(?<!\w)(?:final|фінальн\w*)(?!\w)")


def _situations(found: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.transform(found, lambda r: r["situation"]), lambda s: s != "")))


def _strong(found: Column) -> Column:
    return F.exists(found, lambda r: r["type"].isin(*STRONG_TYPES))


def _cap(found: Column) -> Column:
    return F.when(F.size(found) == 0, LOW).when((_situations(found) >= 3) & _strong(found), HIGH).otherwise(MEDIUM)


def evidence_caps(evidence: Column) -> Column:
    """Map of each dimension to the highest confidence that all evidence allows."""
    def caps(records: Column) -> Column:
        def of(names: Sequence[str]) -> Column:
            return F.filter(records, lambda r: F.arrays_overlap(r["dimensions"], F.array(*map(F.lit, names))))

        return F.create_map(*(x for d, names in DIMENSIONS.items() for x in (F.lit(d), _cap(of(names)))))

    return E.once(E.records(evidence), caps)


def _cited(records: Column, section: Column) -> Column:
    return E.once(E.cited_ids(section), lambda ids: F.filter(records, lambda r: F.array_contains(ids, r["id"])))


def report_caps(report: Column, evidence: Column) -> Column:
    """Map of each dimension to the highest confidence that the evidence cited in its section allows."""
    def caps(records: Column) -> Column:
        return F.create_map(*(x for d in DIMENSIONS for x in (F.lit(d), E.once(_cited(records, E.dimension_section(report, d)), _cap))))

    return E.once(E.records(evidence), caps)


def _breach(on: Column, code: str, subject: Column | str = "") -> Column:
    row = F.struct(F.lit(code).alias("code"), (F.lit(subject) if isinstance(subject, str) else subject).alias("subject"))
    return F.when(on, F.array(row)).otherwise(F.array().cast(BREACH))


def _breaches(rows: Column, of) -> Column:
    return F.flatten(F.transform(rows, of))


def _decision(levels: Sequence[str]) -> list[Column]:
    """Rules on the decision, its stage and its target; they read the columns that broken_rules() adds."""
    f = {label: F.lower(F.col("fields")[k]) for k, label in enumerate(FIELDS)}
    final = F.regexp_replace(f[FINAL], r"[.!]$", "")
    role, level, is_final = F.col("has_role"), F.col("has_level"), final_stage(F.col("stage"))
    decides, no_fit = _starts(final, (*HIRE, *REJECT)), f[FIT].startswith("не застосовується")
    return [
        _breach((F.regexp_count("report", F.lit(E.LONG_ID)) != F.regexp_count("report", F.lit(rf"(?<=\[){E.LONG_ID}(?=\])"))) | F.col("report").rlike(rf"\[{E.LONG_ID}\][A-Za-z0-9_-]+\]|\[E[A-Za-z][A-Za-z0-9_-]*\](?!\()"), "malformed_id"),
        _breach(final_stage(f[STAGE]) != is_final, "stage_mismatch"),
        _breach(F.contains(f[STATUS], F.lit("фіналь")) & ~is_final, "final_status_early"),
        _breach(~is_final & decides, "final_recommendation_early"),
        _breach(decides & ~F.contains(f[STATUS], F.lit("фіналь")), "final_with_preliminary_status"),
        _breach(decides & ~level, "final_without_level"),
        _breach(decides & ~role, "final_without_role"),
        _breach(decides & ~f[CRITICAL].startswith("так"), "final_unverified"),
        _breach(_starts(final, HIRE) & ~_any_of(f[FIT], ("відповідає", "перевищує")), "hire_against_fit"),
        _breach(~(role & level) & ~no_fit, "fit_without_target"),
        _breach(role & level & no_fit, "fit_missing"),
        _breach(role & _any_of(f[ROLE], NOT_SUPPLIED), "role_lost"),
        _breach(level & _any_of(f[LEVEL], NOT_SUPPLIED), "level_lost"),
        _breach(~level & ~_any_of(f[LEVEL], NOT_SUPPLIED), "level_invented"),
        _breach((F.trim("candidate") != "") & F.contains(F.lower(E.field(F.col("report"), INTERVIEWERS)), F.lower("candidate")), "candidate_as_interviewer"),
        _breach(has(F.col("report"), REPEATED) & (F.size(F.array_distinct(F.regexp_extract_all("report", F.lit(f"({E.CLOCK})"), F.lit(1)))) < 2), "pattern_without_examples"),
    ]


def _citations() -> Column:
    """Rules on the quotes that a report cites."""
    def of(q: Column) -> Column:
        known = F.exists("known_quotes", lambda k: (k["id"] == q["id"]) & (q["quote"] != "") & F.contains(E.quote_key(k["quote"]), q["quote"]))
        return F.concat(
            _breach((F.col("evidence") != "") & ~known, "quote_not_in_evidence", q["id"]),
            _breach((F.col("transcript") != "") & (q["quote"] != "") & ~F.contains(F.col("said"), q["quote"]), "quote_not_in_transcript", q["id"]),
        )

    return _breaches(E.cited_quotes(F.col("report")), of)


def _dimension(name: str) -> Column:
    """Rules on the section of a dimension that the table gives a score."""
    row = E.FLAGS + rf"^\|\s*\Q{name}\E\s*\|\s*([1-5])\s*\|\s*([^|]+)\|"
    report, records = F.col("report"), F.col("records")

    def checked(s: Column) -> Column:
        section, ids, found = s["section"], s["ids"], s["found"]
        signals = F.flatten(F.transform(found, lambda r: r["signals"]))
        rules = [
            _breach(~section.rlike(E.CLOCK), "score_without_time", name),
            _breach((F.col("evidence") != "") & (F.size(ids) == 0), "score_without_id", name),
            _breach((F.col("evidence") != "") & (F.size(found) < F.size(ids)), "unknown_id", name),
            _breach(has(F.regexp_extract(report, row, 2), "висок|high") & ~((_situations(found) >= 3) & _strong(found)), "confidence_too_high", name),
        ]
        if name == REFLECTION:
            of_one = lambda r: F.flatten(F.transform(F.filter(found, lambda x: x["situation"] == r["situation"]), lambda x: x["signals"]))
            whole = F.exists(found, lambda r: F.size(F.array_intersect(F.array(*map(F.lit, CHAIN)), of_one(r))) == len(CHAIN))
            rules.append(_breach((F.regexp_extract(report, row, 1) >= "3") & (F.size(found) > 0) & ~whole, "reflection_chain"))
        if name == BIAS:
            rules.append(_breach((F.size(found) > 0) & ~F.arrays_overlap(signals, F.array(*map(F.lit, BIAS_SIGNALS))), "bias_without_signal"))
        return F.concat(*rules)

    section = E.once(E.dimension_section(report, name), lambda s: F.struct(s.alias("section"), E.cited_ids(s).alias("ids"), _cited(records, s).alias("found")))
    return F.when(report.rlike(row), E.once(section, checked)).otherwise(F.array().cast(BREACH))


def _chapters() -> list[Column]:
    """Rules on the level table, the risks and the assessor's self-check."""
    report, records = F.col("report"), F.col("records")
    of_reflection = F.flatten(F.transform(F.filter(records, lambda r: F.exists(r["dimensions"], lambda d: F.contains(d, F.lit("reflection")) | F.contains(d, F.lit("рефлексія")))), lambda r: r["signals"]))
    denied = has(F.regexp_extract(report, E.FLAGS + rf"^\|\s*\Q{REFLECTION}\E\s*\|\s*([^|]+)\|", 1), "недостатньо") & F.arrays_overlap(of_reflection, F.array(F.lit("lesson"), F.lit("behavior_change")))
    check = F.lower(E.chapter(report, SELF_CHECK))
    similarity = F.regexp_extract(check, E.FLAGS + r"^-\s*\*\*Similarity:\*\*\s*(.+)$", 1)
    below = E.FLAGS + r"^\|\s*([^|]+)\|\s*(?:Нижче|Below)\s*\|([^\n]+)$"

    def level_row(x: Column) -> Column:
        rest = F.regexp_extract(x, below, 2)
        direct = F.exists(_cited(records, rest), lambda r: F.arrays_overlap(r["signals"], F.array(*map(F.lit, NEGATIVE_SIGNALS))))
        return _breach(has(rest, NO_DATA) & ~direct & ~has(rest, CONTRADICTS), "below_without_data", F.trim(F.regexp_extract(x, below, 1)))

    risks = F.filter(F.split(E.chapter(report, RISKS), "\n"), lambda x: F.ltrim(x).startswith("|") & ~F.contains(x, F.lit("---")) & ~F.contains(x, F.lit("Ризик")))
    return [
        _breach(denied, "reflection_denied"),
        _breach(has(F.col("debrief"), AFFINITY) & (~has(check, NAMES_AFFINITY) | has(similarity, DENIES)), "affinity_not_named"),
        _breaches(F.regexp_extract_all(report, F.lit(below), F.lit(0)), level_row),
        _breaches(risks, lambda x: F.concat(_breach(~x.rlike(rf"\[E{E.ID}\]"), "risk_without_id"), _breach(has(x, UNTESTED), "untested_as_risk"))),
    ]


def broken_rules(reports: DataFrame, levels: Sequence[str] = (), key: str = "report_id") -> DataFrame:
    """key, ord, code, subject and message of every rule that a report breaks, once each; a report that lacks fields gets no other rules."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in reports.columns else F.lit("")
    d = reports.select(F.col(key), *(text(c).alias(c) for c in ("report", "candidate", "target", "stage", "evidence", "transcript", "debrief")))
    d = d.withColumns({
        "fields": F.array(*(E.field(F.col("report"), label) for label in FIELDS)), "records": E.records(F.col("evidence")), "known_quotes": E.quotes(F.col("evidence")),
        "said": E.quote_key(F.col("transcript")), "has_level": explicit_level(F.col("target"), levels), "has_role": explicit_role(F.col("target"), levels),
    })
    missing = F.flatten(F.array(*(_breach(F.col("fields")[k] == "", "missing_field", label) for k, label in enumerate(FIELDS))))
    rules = F.flatten(F.array(*_decision(levels), _citations(), *map(_dimension, DIMENSIONS), *_chapters()))
    d = d.withColumn("missing", missing)
    found = d.select(key, F.posexplode(F.array_distinct(F.when(F.size("missing") > 0, F.col("missing")).otherwise(rules))).alias("ord", "breach"))
    template = F.element_at(F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv)), F.col("breach.code"))
    return found.select(key, "ord", "breach.*", F.replace(template, F.lit("%s"), F.col("breach.subject")).alias("message"))


# Repairs


def _each_match(text: Column, pattern: str, of) -> Column:
    """text with every match of a pattern replaced by of(match)."""
    return E.once(text, lambda t: F.aggregate(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))), t, lambda a, m: F.replace(a, m, of(m))))


MOST_IN_RANGE = 20


def normal_ids(report: Column) -> Column:
    """Evidence ids one to a bracket: ranges and groups taken apart, brackets that are broken, doubled or missing mended."""
    word, own = r"[A-Za-z0-9_-]", E.LONG_ID
    span = rf"\[E({word}+)\.(\d+)-E?\1\.(\d+)\]"

    def spread(m: Column) -> Column:
        prefix, low, high = F.regexp_extract(m, span, 1), F.regexp_extract(m, span, 2).cast("int"), F.regexp_extract(m, span, 3).cast("int")
        each = F.transform(F.sequence(low, F.when(high >= low, high).otherwise(low)), lambda k: F.concat(F.lit("[E"), prefix, F.lit("."), k.cast("string"), F.lit("]")))
        return F.when((high < low) | (high - low > MOST_IN_RANGE), m).otherwise(F.array_join(each, ", "))

    out = _each_match(report, span, spread)
    for pattern, better in (
        (rf"\[E({word}+)\.(\d+)-E({word}+)\.(\d+)\]", "[E$1.$2], [E$3.$4]"),
        (rf"\[({own})\]({word}+)\]", "[$1$2]"),
        (rf"\[E({word}+)\.\]({word}+)\]", "[E$1.$2]"),
        (rf"\[({own})\s*,\s*\[({own})\]", "[$1], [$2]"),
        (rf"\[(E[A-Za-z]{word}*)\](?!\()", "$1"),
    ):
        out = F.regexp_replace(out, pattern, better)
    group = rf"\[{own}(?:\s*,\s*{own})+\]"
    out = _each_match(out, group, lambda m: F.array_join(F.transform(F.regexp_extract_all(m, F.lit(f"({own})"), F.lit(1)), lambda x: F.concat(F.lit("["), x, F.lit("]"))), ", "))
    return F.regexp_replace(out, rf"(?<!\[)(?<![A-Za-z0-9._-])({own})(?![A-Za-z0-9._-]|\])", "[$1]")


def grounded_quotes(report: Column, evidence: Column) -> Column:
    """Cited quotes that their record doesn't hold give way to the record's own."""
    def better(line: Column, known: Column) -> Column:
        id_, quote, rest = (F.regexp_extract(line, E.CITED_QUOTE, k) for k in (1, 2, 3))
        own = F.get(F.filter(known, lambda k: k["id"] == id_), F.lit(0))["quote"]
        held = (E.quote_key(quote) != "") & F.contains(E.quote_key(own), E.quote_key(quote))
        return F.when(own.isNull() | held, line).otherwise(F.concat(F.lit("> [E"), id_, F.lit("] «"), own, F.lit("»"), rest))

    return E.once(E.quotes(evidence), lambda known: _each_match(report, E.CITED_QUOTE, lambda line: better(line, known)))


def capped_confidence(report: Column, evidence: Column) -> Column:
    """A high confidence that the cited evidence doesn't allow gives way to what it allows, in the table and in the headings."""
    def cap(caps: Column) -> Column:
        out = report
        for d in DIMENSIONS:
            to = F.when(caps[d] == HIGH, F.lit("$2")).otherwise(caps[d])
            for pattern in (rf"^(\|\s*\Q{d}\E\s*\|\s*[1-5]\s*\|\s*)(Висока|High)(\s*\|)", rf"^(###\s+\d+\.\s+\Q{d}\E\s+—\s+[1-5]\s*\()(Висока|High)(\))"):
                out = F.regexp_replace(out, F.lit(E.FLAGS + pattern), F.concat(F.lit("$1"), to, F.lit("$3")))
        return out

    return E.once(report_caps(report, evidence), cap)


#: The chapter on mitigation, its other names, the chapters it goes before, and its text where it is missing.
MITIGATION = "## Заходи зниження ризиків"
MITIGATION_ALIASES = ("## Заходи щодо зниження ризиків", "## Мітигація ризиків", "## Мітигації ризиків", "## Зниження ризиків")
MITIGATION_ANCHORS = ("\n## Суперечності між раундами", "\n## Самоперевірка упереджень оцінювача", "\n## Що перевірити в наступному раунді", "\n## Журнал рішень")
MITIGATION_TEXT = (
    f"\n\n{MITIGATION}\n\n- Застосувати цільові перевірки з розділу «Що перевірити в наступному раунді» до кожного наведеного ризику; "
    "не приймати остаточне рішення до отримання додаткових доказів.\n"
)


def with_mitigation(report: Column) -> Column:
    """The report with its chapter on mitigation: there already, under another name, or put in."""
    def first_replaced(c: Column, old: str, new: str) -> Column:
        at = F.instr(c, old)
        return F.concat(F.substr(c, F.lit(1), at - 1), F.lit(new), F.substr(c, at + len(old)))

    out = F.concat(F.regexp_replace(report, r"(?U)\s+\z", ""), F.lit(MITIGATION_TEXT))
    for old, new in (*((x, MITIGATION_TEXT + x) for x in reversed(MITIGATION_ANCHORS)), *((x, MITIGATION) for x in reversed(MITIGATION_ALIASES))):
        out = F.when(F.contains(report, F.lit(old)), first_replaced(report, old, new)).otherwise(out)
    return F.when(F.contains(report, F.lit(MITIGATION)), report).otherwise(out)


def repaired(reports: DataFrame) -> DataFrame:
    """reports with their report mended: ids, quotes, confidence and the chapter on mitigation, in this order."""
    return (
        reports.withColumn("report", normal_ids(F.coalesce("report", F.lit(""))))
        .withColumn("report", grounded_quotes(F.col("report"), F.col("evidence")))
        .withColumn("report", capped_confidence(F.col("report"), F.col("evidence")))
        .withColumn("report", F.regexp_replace(with_mitigation(F.col("report")), r"(?U)^\s+|\s+\z", ""))
    )
