"""Evidence texts, grounding, report rules and repairs on written examples."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colloquy.operators import grounding, reports
from colloquy.sources import evidence

LEDGER = """[E1.1] speaker=candidate | type=candidate_live | situation=migration | timestamp=00:01:10 | dimensions=reflection; critical_thinking | signals=own_mistake, lesson
> «Я помилився з Міграцією, і ми це виправили»
[E1.2] speaker=candidate | type=claim | situation=queue | timestamp=00:02:00 | dimensions=motivation | signals=interest

"мені цікаво працювати"
[E1.3] speaker=candidate | type=claim | situation=migration | timestamp=00:03:00 | dimensions=reflection | signals=behavior_change | phase=core | support=direct
тепер я роблю бекап
[E1.3] speaker=candidate | type=claim | situation=Later | timestamp=00:03:30 | dimensions=reflection | signals=behavior_change
тепер я завжди роблю бекап
"""
TRANSCRIPT = """[00:01:10] Ann: Я помилився з міграцією, і ми це виправили.
[00:02:00] Ann: Так, мені цікаво працювати тут
[00:03:30] Ann: Тепер я завжди роблю бекап"""


def report(**changes):
    fields = {
        "Статус рішення": "Попередній", "Етап співбесіди": "Технічний", "Продемонстрований рівень": "Middle", "Сигнали наступного рівня": "є", "Цільова роль": "Backend",
        "Цільовий рівень": "Senior", "Відповідність цільовому рівню": "Відповідає", "Рекомендація поточного етапу": "Далі", "Фінальна рекомендація щодо найму": "Не застосовується", "Критичні компетенції перевірено": "Так",
    }
    body = changes.pop("body", "")
    fields |= {k: v for k, v in changes.items() if v is not None}
    return "\n".join(f"**{k}:** {v}" for k, v in fields.items() if v != "") + "\n\n" + body


def broken(spark, *cases):
    """Codes of each case: a report's text, and what else differs from a plain interview."""
    plain = {"candidate": "Ann Lee", "target": "Backend Senior", "stage": "технічний", "evidence": "", "transcript": "", "debrief": ""}
    rows = [(k, text, *(plain | more).values()) for k, (text, more) in enumerate(cases)]
    d = spark.createDataFrame(rows, "report_id int, report string, candidate string, target string, stage string, evidence string, transcript string, debrief string")
    out = [[] for _ in cases]
    for r in reports.broken_rules(d, ["Junior", "Senior", "A"]).orderBy("report_id", "ord").collect():
        assert r.message and "%s" not in r.message
        out[r.report_id].append(r.code + (f":{r.subject}" if r.subject else ""))
    return out


def one(spark, c, **texts):
    return spark.createDataFrame([tuple(texts.values())], ", ".join(f"{k} string" for k in texts)).select(c.alias("x")).first().x


def test_records_and_quotes(spark):
    r = one(spark, evidence.records(F.col("e")), e=LEDGER)
    assert [(x.id, x.type, x.situation, x.timestamp, x.dimensions, x.signals, x.phase, x.support) for x in r] == [
        ("1.1", "candidate_live", "migration", "00:01:10", ["reflection", "critical_thinking"], ["own_mistake", "lesson"], "", ""),
        ("1.2", "claim", "queue", "00:02:00", ["motivation"], ["interest"], "", ""),
        ("1.3", "claim", "later", "00:03:30", ["reflection"], ["behavior_change"], "", ""),
    ]
    q = one(spark, evidence.quotes(F.col("e")), e=LEDGER)
    assert [tuple(x) for x in q] == [("1.1", "Я помилився з Міграцією, і ми це виправили"), ("1.2", "мені цікаво працювати"), ("1.3", "тепер я завжди роблю бекап")]
    assert one(spark, evidence.records(F.col("e")), e=None) == [] == one(spark, evidence.quotes(F.col("e")), e="")
    assert one(spark, reports.evidence_caps(F.col("e")), e=LEDGER) == {"Мотивація": "Середня", "Релевантність досвіду": "Низька", "Критичне мислення": "Середня", "Рефлексія": "Середня", "Усвідомлення упереджень": "Низька"}


def test_clean_report(spark):
    got = broken(spark, (report(), {}), (None, {}), (report(**{"Цільова роль": "", "Етап співбесіди": ""}, body="E9"), {}))
    assert got == [[], [f"missing_field:{f}" for f in reports.FIELDS], ["missing_field:Етап співбесіди", "missing_field:Цільова роль"]]


RULES = [
    ({"Статус рішення": "Фінальний"}, {}, ["final_status_early"]),
    ({"Етап співбесіди": "Фінальна"}, {}, ["stage_mismatch"]),
    ({"Фінальна рекомендація щодо найму": "Наймати."}, {}, ["final_recommendation_early", "final_with_preliminary_status"]),
    ({"Фінальна рекомендація щодо найму": "Скоріше наймати — з умовами", "Статус рішення": "Фінальний", "Етап співбесіди": "Final", "Критичні компетенції перевірено": "Ні", "Відповідність цільовому рівню": "Нижче"}, {"stage": "final"}, ["final_unverified", "hire_against_fit"]),
    ({}, {"target": "Senior"}, ["fit_without_target"]),
    ({}, {"target": "Backend"}, ["fit_without_target", "level_invented"]),
    ({"Відповідність цільовому рівню": "Не застосовується", "Цільовий рівень": "не задано"}, {"target": "Backend middle/Senior"}, []),
    ({"Відповідність цільовому рівню": "Не застосовується"}, {}, ["fit_missing"]),
    ({"Цільова роль": "—", "Цільовий рівень": "not supplied"}, {"target": "Backend Mid middle"}, ["role_lost", "level_lost"]),
    ({"body": "**Інтерв’юери:** Bob, ANN LEE"}, {}, ["candidate_as_interviewer"]),
    ({"body": "це повторюваний шаблон, 10:01 і 10:01"}, {}, ["pattern_without_examples"]),
    ({"body": "це повторюваний шаблон, 10:01 і 1:10:02"}, {}, []),
    ({"body": "E1.2 [E1.3]"}, {}, ["malformed_id"]),
    ({"body": "[E1.2] [Eabc](x) [E1.3]"}, {}, []),
    ({"body": "[Eabc]"}, {}, ["malformed_id"]),
    ({"body": "| Senior | Нижче | не перевірено |\n| Lead | Below | є докази |\n| Staff | Нижче | немає даних, [E1.1] прямі негативні |"}, {"evidence": LEDGER}, ["below_without_data:Senior"]),
    ({"body": "## Основні ризики найму\n| Ризик | Доказ |\n|---|---|\n| Темп | [E1.1] |\n| Тести | не перевірено |\n## Далі\n| x |"}, {}, ["risk_without_id", "untested_as_risk"]),
    ({"body": "## Самоперевірка упереджень оцінювача\n- **Similarity:** не виявлено\n"}, {"debrief": "він мені сподобався"}, ["affinity_not_named"]),
    ({"body": "## Самоперевірка упереджень оцінювача\n- **Similarity:** можлива симпатія\n"}, {"debrief": "він мені сподобався"}, []),
    ({"body": "| Рефлексія | Недостатньо даних | - |"}, {"evidence": LEDGER}, ["reflection_denied"]),
]


def test_rules(spark):
    got = broken(spark, *((report(**changes), more) for changes, more, _ in RULES))
    for found, (changes, more, codes) in zip(got, RULES, strict=True):
        assert found == codes, (changes, more)


def test_rules_on_quotes_and_dimensions(spark):
    body = """> [E1.1] «я помилився з міграцією»
> [E1.2] "мені нудно працювати"
> [E7.7] «тепер я завжди»

| Рефлексія | 4 | Висока |
| Мотивація | 3 | Середня |
| Усвідомлення упереджень | 2 | Низька |
| Критичне мислення | 3 | Низька |

### 1. Мотивація — 3 (Середня)
без часу [E8.8]
### 2. Рефлексія — 4 (Висока)
00:01:10 [E1.1] [E1.3]
### 3. Усвідомлення упереджень — 2 (Низька)
00:02:00 [E1.2]
### 4. Критичне мислення
00:02:00
"""
    fixed = LEDGER.replace("situation=Later", "situation=migration")
    got, mended = broken(spark, (report(body=body), {"evidence": LEDGER, "transcript": TRANSCRIPT}), (report(body=body), {"evidence": fixed, "transcript": TRANSCRIPT}))
    assert got == [
        "quote_not_in_evidence:1.2", "quote_not_in_transcript:1.2", "quote_not_in_evidence:7.7", "score_without_time:Мотивація", "unknown_id:Мотивація",
        "score_without_id:Критичне мислення", "confidence_too_high:Рефлексія", "reflection_chain", "bias_without_signal",
    ]
    assert mended == [x for x in got if x != "reflection_chain"]


@pytest.mark.parametrize(("raw", "want"), [
    ("[E1.2-1.4]", "[E1.2], [E1.3], [E1.4]"), ("[E1.2-E1.3] [E1.2-E1.3]", "[E1.2], [E1.3] [E1.2], [E1.3]"), ("[E1.9-1.2]", "[E1.9-1.2]"), ("[E1.1-E1.40]", "[E1.1], [E1.40]"),
    ("[E1.7-E2.3]", "[E1.7], [E2.3]"), ("[E1.2]3]", "[E1.23]"), ("[E1.]4]", "[E1.4]"), ("[E1.1, [E1.2]", "[E1.1], [E1.2]"), ("[Eabc] [Eabc](u)", "Eabc [Eabc](u)"),
    ("[E1.1, E1.2,E2.3]", "[E1.1], [E1.2], [E2.3]"), ("див. E1.4, [E1.5]", "див. [E1.4], [E1.5]"), ("xE1.4", "xE1.4"),
])
def test_normal_ids(spark, raw, want):
    assert one(spark, reports.normal_ids(F.col("t")), t=raw) == want


def test_repairs(spark):
    body = "> [E1.2] «вигадка» — так\n> [E1.1] «помилився з міграцією»\n> [E5.5] «невідоме»\n| Рефлексія | 4 | Висока |\n### 2. Рефлексія — 4 (High)\n[E1.1-1.2]\n## Журнал рішень\nx"
    d = spark.createDataFrame([(report(body=body), LEDGER)], "report string, evidence string")
    out = reports.repaired(d).first().report
    assert "> [E1.2] «мені цікаво працювати» — так" in out and "> [E1.1] «помилився з міграцією»" in out and "> [E5.5] «невідоме»" in out
    assert "| Рефлексія | 4 | Середня |" in out and "### 2. Рефлексія — 4 (Середня)" in out and "[E1.1], [E1.2]" in out
    assert out.index(reports.MITIGATION) < out.index("## Журнал рішень") and out.count(reports.MITIGATION) == 1
    again = reports.repaired(spark.createDataFrame([(out, LEDGER)], "report string, evidence string")).first().report
    assert again == out
    for alias in reports.MITIGATION_ALIASES:
        assert one(spark, reports.with_mitigation(F.col("t")), t=f"a\n{alias}\nb\n## Журнал рішень") == f"a\n{reports.MITIGATION}\nb\n## Журнал рішень"
    assert one(spark, reports.with_mitigation(F.col("t")), t="a \n") == "a" + reports.MITIGATION_TEXT


def lines(spark):
    rows = [("s", k + 1, *x) for k, x in enumerate([("00:01", "Ми спершу — зібрали дані, потім довго обговорили ризики і прийняли план"), ("00:02", "так"), ("00:02", "one two three four five"), ("00:03", "кінець рядка"), ("00:04", "і початок іншого")])]
    return spark.createDataFrame(rows, "session string, line int, timestamp string, text string")


@pytest.mark.parametrize(("timestamp", "quote", "exact"), [
    ("00:09", "потім довго обговорили", "потім довго обговорили"), ("00:09", "кінець рядка і початок", "кінець рядка і початок"),
    ("00:01", "спершу зібрали ... обговорили ризики", "спершу зібрали дані потім довго обговорили ризики"), ("00:01", "обговорили ризики … спершу зібрали", None), ("00:02", "спершу … ризики", None),
    ("00:02", "one…three", "one two three"), ("00:09", "one....two", "one....two"), ("00:01", "...", None), ("00:01", "", None), (None, "one…three", None),
])
def test_grounding(spark, timestamp, quote, exact):
    d = spark.createDataFrame([("s", 0, timestamp, quote), ("other", 0, timestamp, quote)], "session string, ord int, timestamp string, quote string")
    assert {r.session: r.exact for r in grounding.ground(d, lines(spark)).collect()} == {"s": exact, "other": None}


def test_ground_ledger(spark):
    text = '[E1.1] speaker=candidate|interviewer | type=x | timestamp=00:01 | y\n\n> «спершу зібрали … ризики»\nmore\n\n[E1.2] speaker=candidate|interviewer | type=interviewer_commentary | timestamp=00:02\n"one two"\n[E1.3] a timestamp=00:02\nnever said\n[E1.4] a timestamp=00:02\n\n'
    d = spark.createDataFrame([("s", text), ("t", "no records"), ("u", None)], "session string, evidence string")
    got = {r.session: (r.evidence, r.dropped) for r in grounding.ground_ledger(d, lines(spark)).collect()}
    assert got["t"] == ("no records", []) and got["u"] == (None, [])
    assert got["s"] == ('[E1.1] speaker=candidate | type=x | timestamp=00:01 | y\n\n"спершу зібрали дані потім довго обговорили ризики"\nmore\n\n[E1.2] speaker=interviewer | type=interviewer_commentary | timestamp=00:02\n"one two"', ["1.3", "1.4"])


def test_merged_evidence(spark):
    a = "[E1.1] situation=Queue | timestamp=00:01\n«one two»\n[E1.2] situation=q | timestamp=00:02\nx y"
    b = "[E2.1] situation=queue | timestamp=00:01 \n> «One, two»\n[E2.2] situation=queue | timestamp=00:05\none two"
    d = spark.createDataFrame([("s", 2, b), ("s", 1, a), ("t", 1, a)], "session string, part int, evidence string")
    assert sorted((r.session, r.part, r.at, r.id) for r in grounding.merged_evidence(d).collect()) == [("s", 1, 0, "1.1"), ("s", 1, 1, "1.2"), ("s", 2, 1, "2.2"), ("t", 1, 0, "1.1"), ("t", 1, 1, "1.2")]
