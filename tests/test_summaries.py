"""Summaries, report files, titles and device names on written examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import clean, identity, ledger, summaries

ITEMS = "session string, item_id int, type string, status string, claim string, owners array<string>, deadline string, source_order long, lifecycle_reason string, thematic boolean"


def value(spark, c, **texts):
    return spark.createDataFrame([tuple(texts.values())], ", ".join(f"{k} string" for k in texts)).select(c.alias("x")).first().x


def test_sections(spark):
    rows = [
        ("s", 1, "fact", "active", "Дані є. ", [], "", 1, None, True), ("s", 2, "hypothesis", "active", "може бути", [], "", 2, None, True), ("s", 3, "fact", "active", "дані є", [], "", 3, None, True), ("s", 4, "proposal", "open", "спробувати", [], "", 4, "conditional_decision", True),
        ("s", 5, "decision", "active", "так і робимо.", [], "", 9, None, False), ("s", 6, "decision", "superseded", "ні", [], "", 8, None, False), ("s", 7, "commitment", "open", "звіт", ["Оля", " "], " 5 травня", 7, None, False),
        ("s", 8, "commitment", "open", "лист", [], "", 0, None, False), ("s", 9, "open_question", "open", "коли?", [], "", 5, None, False), ("t", 1, "fact", "active", "  ", [], "", 1, None, True), ("u", 1, "commitment", "open", "лист.", [], None, 1, None, False),
    ]
    got = {r.session: r for r in summaries.grounded_sections(spark.createDataFrame(rows, ITEMS)).collect()}
    s = got["s"]
    assert s.tldr == "На зустрічі обговорили: Дані є; спробувати. Явні рішення: так і робимо. Наступні кроки: звіт — дедлайн: 5 травня; лист."
    assert s.theses == "- Дані є.\n- Гіпотеза: може бути\n- Пропозиція: спробувати" and s.decisions == "- так і робимо."
    assert s.actions == "- [Оля] звіт — дедлайн: 5 травня\n- [Власник не визначений] лист" and s.questions == "- Чи підтвердиться після перевірки: спробувати?\n- коли?"
    assert got["t"].tldr == "На зустрічі обговорили: зміст зустрічі. Явних рішень не зафіксовано." and got["t"].theses == "- —"
    assert got["u"].tldr == "На зустрічі обговорили: [Власник не визначений] лист. Явних рішень не зафіксовано. Наступні кроки: лист."


def test_sections_are_put_in_and_judged(spark):
    whole = "\n\n".join(summaries.HEADINGS) + "\n"
    c = summaries.with_sections(F.col("t"), {h: F.lit(f"- [a$1] \\{k}") for k, h in enumerate(summaries.HEADINGS)})
    out = value(spark, c, t=whole)
    assert out == "\n\n".join(f"{h}\n- [a$1] \\{k}" for k, h in enumerate(summaries.HEADINGS)) + "\n"
    assert value(spark, summaries.valid_summary(F.col("t")), t=out) is True
    assert value(spark, summaries.valid_summary(F.col("t")), t=whole) is False
    assert value(spark, summaries.valid_summary(F.col("t"), F.lit("## X")), t=out) is False
    assert value(spark, summaries.valid_summary(F.col("t"), F.lit("## X")), t=out + "## X\n") is True
    assert value(spark, summaries.with_section(F.col("t"), "## None", F.lit("x")), t="a\n") == "a\n"


def test_report_files(spark):
    def put(old, id_, report, replace=False):
        return value(spark, summaries.with_report(F.col("o"), F.col("i"), F.col("r"), F.lit(replace)), o=old, i=id_, r=report)

    one = put(None, "a", " x \n")
    assert one == "<!-- evaluation-id: a -->\nx\n" and put(one, "a", "y") == one
    two = put(one, "b", "y")
    assert two == "<!-- evaluation-id: a -->\nx\n\n---\n\n<!-- evaluation-id: b -->\ny\n"
    assert put(two, "a", "z", True) == "<!-- evaluation-id: a -->\nz\n\n---\n\n<!-- evaluation-id: b -->\ny\n" and put(two, "b", "z", True) == two.replace("\ny\n", "\nz\n")


def test_devices(spark):
    e = spark.createDataFrame([("s", "@a/x", 1, "r1"), ("s", "b/x", 5, "r2"), ("s", "a/x", 5, "r3"), ("s", "c/longtail", 1, "r4"), ("t", "a/x", 9, "r5"), ("s", None, 1, "r6")], "session string, device string, at int, row string")
    n = spark.createDataFrame([("s", "a/x", "Ann", 3), ("s", "@b/x", "Bob", 4), ("s", "a/x", " ", 9)], "session string, device string, name string, at int")
    got = {r.row: r.speaker for r in identity.with_device_names(e, n).collect()}
    assert got == {"r1": "Bob", "r2": "Bob", "r3": "Ann", "r4": "Учасник ngtail", "r5": "Учасник x", "r6": "Учасник "}


def test_weekdays(spark):
    head = "Запис 2024-02-05\n"  # the 5th is a Monday
    say = lambda t, said=head: value(spark, ledger.consistent_weekdays(F.col("claim"), F.col("t")), claim=t, t=said)
    assert say("Зустріч 5 та 6 числа (понеділок і вівторок)") == "Зустріч 5 та 6 числа (понеділок і вівторок)"
    assert say("Зустріч 5 та 7 числа (понеділок і вівторок) тут (у залі)") == "Зустріч 5 та 7 числа тут (у залі)"
    assert say("У понеділок 6 та 7 числа") == "" and say("30 та 31 числа, monday") == ""
    assert say("6 та 7 числа") == "6 та 7 числа" and say("У понеділок 6 та 7 числа", "без дати") == "У понеділок 6 та 7 числа"


def test_small_rules(spark):
    assert [value(spark, identity.session_time(F.col("s")), s=x) for x in ("2024-01-02_1011", "2024-01-02_10-11-12_meet", "x")] == ["10:11", "10:11:12", "—"]
    assert value(spark, clean.in_ukrainian(F.col("s")), s="ї" * 300 + "q" * 300) and not value(spark, clean.in_ukrainian(F.col("s")), s="> " + "ї" * 900) and not value(spark, clean.in_ukrainian(F.col("s")), s=None)
    rows = [("s", 1, "chat", "A", "Hi"), ("s", 2, "chat", "A", "hI"), ("s", 3, "chat", "B", "hi"), ("s", 4, "caption", "A", "Hi"), ("s", 5, "caption", "A", "Hi"), ("s", 6, "chat", "A", "x")]
    d = spark.createDataFrame(rows, "session string, ord int, kind string, speaker string, text string")
    assert sorted(r.ord for r in clean.compact_chats(d).collect()) == [1, 3, 4, 5]
