import json

import pytest

from colloquy.engine import Engine
from colloquy.operators import ledger, quality, state, tasks
from colloquy.sources import notes, packets
from pyspark.sql import functions as F


def export(entries, **more):
    return {"schemaVersion": 1, "source": "google-meet-live-captions", "meetingCode": "abc-def", "meetingTitle": "Sync", "participants": ["Ann Lee", "Bob"], "startedAt": "2024-05-01T10:00:00Z", "entries": entries} | more


def e(speaker, text, start, kind="caption"):
    return {"speaker": speaker, "text": text, "kind": kind, "startMs": start, "endMs": start + 500}


def test_ingest_and_search(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    docs = {
        "meet-1.json": export([e("Ann Lee & 2 others", "we use the event", 0), e("Ann Lee", "we use the event router", 600), e("Bob", "agreed", 2000), e("Bob", "http://x", 2100, "chat"), e("Bob", "http://x", 9000, "chat")]),
        "meet-2.json": export([], startedAt="2024-05-02T10:00:00"),
        "meet-3.json": export([], startedAt="2024-05-03T10:00:00", diagnosticOnly=True, captureHealth={"decodeFailures": 3}),
        "meet-4.json": export([e("A", "x", 0)], schemaVersion=2),
    }
    for name, d in docs.items():
        (src / name).write_text(json.dumps(d))
    (src / "meet-5.json").write_text("{oops")
    engine = Engine(spark, str(tmp_path / "out"))
    refused = {r.path.rsplit("/", 1)[-1]: r.reason for r in engine.ingest(str(src)).collect()}
    assert refused == {"meet-2.json": "no_entries", "meet-4.json": "schema_version", "meet-5.json": "not_json"}
    rows = [(r.session, r.speaker, r.kind, r.text) for r in engine.entries().orderBy("start_ms").collect()]
    s = "2024-05-01_10-00-00_meet-abc-def"
    assert rows == [(s, "Ann Lee", "caption", "we use the event router"), (s, "Bob", "caption", "agreed"), (s, "Bob", "chat", "http://x")]
    assert [r.text for r in engine.search("event routers router", participants=["ann"]).collect()] == ["we use the event router"]
    q = engine.quality().first()
    assert (q.captions, q.chats, q.unknown_ratio) == (2, 1, 0.0)
    assert engine.ingest(str(src)).count() == 3 and engine.entries().count() == 3


def test_fuller_export_replaces_and_large_ones_are_refused(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "out"))

    def take(folder, docs, **limits):
        (tmp_path / folder).mkdir()
        for k, d in enumerate(docs):
            (tmp_path / folder / f"meet-{k}.json").write_text(json.dumps(d))
        refused = {r.path.rsplit("/", 1)[-1]: r.reason for r in engine.ingest(str(tmp_path / folder), **limits).collect()}
        return refused, [r.text for r in engine.entries().orderBy("start_ms").collect()]

    three = [e("Ann", "first of all", 0), e("Bob", "then the second", 20_000), e("Ann", "and a third one", 40_000)]
    # Two exports of one session at once: the fuller one counts, entries of both don't mix.
    assert take("a", [export(three[:1]), export(three[:2])]) == ({}, ["first of all", "then the second"])
    assert take("b", [export(three[:1])]) == ({}, ["first of all", "then the second"])
    assert take("c", [export(three)]) == ({}, ["first of all", "then the second", "and a third one"])
    assert take("d", [export([e("Ann", "x" * 3000, 0)], startedAt="2024-06-01T10:00:00Z")], max_bytes=2000)[0] == {"meet-0.json": "too_large"}
    with pytest.raises(ValueError):
        engine.search("first", kinds=["fact", "nonsense"])


def test_quotes_of_any_length_are_found(spark):
    docs = spark.createDataFrame([(1, "We use the Event-Router; it works."), (2, "the event routers"), (3, None), (4, "")], "doc_id long, text string")
    quotes = ["use the event router", "event router", "vent rout", "se the event router it wor", "the event", "router", "...", "nowhere at all", "e"]
    got = sorted((r.quote, r.doc_id) for r in ledger.quoted_in(spark.createDataFrame([(q,) for q in [*quotes, "router"]], "quote string"), docs).collect())
    norm = {1: "we use the event router it works", 2: "the event routers"}
    assert got == sorted((q, k) for q in quotes if q != "..." for k, t in norm.items() if q in t)


@pytest.mark.parametrize("name, unknown", [("Unknown", 1), (" local_unknown ", 1), ("Учасник 3", 1), ("УЧАСНИК", 1), ("невідомий", 1), ("SPEAKER_07", 0), ("Unknown Soldier", 0), ("", 0), (None, 0), ("Учасник 3 4", 0)])
def test_unknown_speakers(spark, name, unknown):
    d = spark.createDataFrame([("s", name, "caption", 0)], "session string, speaker string, kind string, start_ms long")
    assert quality.capture_metrics(d).first().unknown_ratio == unknown


LINES = [(1, "10:00:01", "Оля", "Так, я підготую звіт до 15 травня."), (2, "10:00:09", "Ігор", "Якщо бюджет буде, залишаємо план."), (3, "10:01:00", "Оля", "Вирішили: використовуємо чергу."), (4, "10:02:00", "Ігор", "Вирішили: використовуємо чергу.")]


def ledger_of(spark, items, proofs):
    i = spark.createDataFrame([("s", k, *r) for k, r in enumerate(items)], "session string, item_id int, type string, claim string, owners array<string>, deadline string, status string, commitment_strength string, confidence string")
    p = spark.createDataFrame([("s", *r) for r in proofs], "session string, item_id int, proof_ord int, quote string, timestamp string")
    lines = spark.createDataFrame([("s", *r) for r in LINES], "session string, line long, timestamp string, speaker string, text string")
    return {r.item_id: r for r in ledger.validated(i, p, lines).collect()}


def test_ledger_validation(spark):
    items = [
        ("commitment", "Підготувати звіт (до 16 червня)", ["Ігор"], "до 15 травня", "active", "explicit", "sure"),
        ("decision", "Черга", [], "завтра", "", "soft", "high"),
        ("decision", "Вигадка", [], "", "", "", ""),
        ("fact", "Буде 99 серверів", [], "", "", "", ""),
        ("thing", "x", [], "", "", "", ""),
    ]
    proofs = [(0, 0, "я підготую звіт", "10:00:01"), (1, 0, "використовуємо чергу", "10:02:00"), (2, 0, "цього не було", None), (3, 0, "залишаємо план", None), (4, 0, "звіт", None)]
    got = ledger_of(spark, items, proofs)
    assert set(got) == {0, 1}
    a, b = got[0], got[1]
    assert (a.claim, a.owners, a.deadline, a.status, a.confidence, a.source_order, a.speaker) == ("Підготувати звіт", ["Оля"], "до 15 травня", "open", "medium", 1, "Оля")
    assert (b.status, b.deadline, b.source_order, b.speaker, b.commitment_strength) == ("active", "", 4, "Ігор", "not_applicable")


def test_tracked_tokens(spark):
    rows = [("Зустріч у п’ятницю о 12,5 та 2024x 7", ["number:12.5", "number:2024", "number:7", "weekday:friday"]), ("On Monday, ver2 of неділя", ["weekday:monday", "weekday:sunday"]), ("sundays", []), ("a12 _3", [])]
    d = spark.createDataFrame(rows, "t string, want array<string>").select(F.array_sort(ledger.tracked_tokens(F.col("t"))).alias("got"), "want")
    assert [r.got for r in d.collect()] == [r.want for r in d.collect()]


@pytest.mark.parametrize(("quotes", "kind"), [(["Погоджено"], "decision"), (["Якщо бюджет буде, залишаємо план"], "proposal"), (["Залишаємо план"], "decision"), (["Давайте так"], "proposal")])
def test_lifecycle_of_decisions(spark, quotes, kind):
    d = spark.createDataFrame([("decision", "active", "x", "", quotes)], "type string, status string, claim string, deadline string, quotes array<string>")
    assert ledger.lifecycle(d).first().type == kind


def test_lifecycle_of_commitments(spark):
    rows = [("commitment", "open", "Надіслати файл", "", ["вже надіслав файл"]), ("commitment", "open", "Надавати допомогу за потреби", "", ["якщо потрібна допомога, звертай"]), ("commitment", "open", "Звіт", "", ["я підготую звіт"])]
    d = ledger.lifecycle(spark.createDataFrame(rows, "type string, status string, claim string, deadline string, quotes array<string>"))
    assert sorted((r.type, r.status) for r in d.collect()) == [("commitment", "open"), ("completed_action", "completed")]


def test_persons(spark):
    pairs = [("Євген Коваль", "Yevhen Koval", True), ("Коваль Євген", "Ievhen Koval", True), ("Юлія Ш", "Iuliia Sh", True), ("Ann", "Ann Lee", False), ("Ann Lee", "Ann Li", False), ("", "", False)]
    d = spark.createDataFrame(pairs, "a string, b string, want boolean").withColumn("got", quality.same_person(F.col("a"), F.col("b")))
    assert d.where("got is distinct from want").count() == 0


def test_meeting_types(spark):
    rows = [("Щоденний синк", "", "standup"), ("1:1 Оля", "", "one_on_one"), ("Зустріч", "roadmap і знов roadmap", "planning"), ("Зустріч", "roadmap", "general"), ("User interview #4", "", "discovery")]
    d = spark.createDataFrame(rows, "t string, x string, want string").withColumn("got", quality.meeting_type(F.col("t"), F.col("x")))
    assert [(r.got, r.want) for r in d.collect() if r.got != r.want] == []


def test_tasks(spark):
    md = "## Action items\n- **[Ann]** Send `report`\n  with figures — без дедлайну.\n  - ask Bob\n- [Bob, Cid] Call\n- немає\n## Next\n- no"
    rows = tasks.from_bullets(spark.createDataFrame([("n", md)], "note string, markdown string")).orderBy("ord").collect()
    assert [(r.name, r.involved) for r in rows] == [("Send report with figures", "Ann"), ("ask Bob", "Ann"), ("Call", "Bob, Cid")]
    owned = spark.createDataFrame([("Ann, Bob",), ("Annie",), ("",)], "o string").where(tasks.owned_by(F.col("o"), ["ann"]))
    assert [r.o for r in owned.collect()] == ["Ann, Bob"]


def test_backoff_and_exports(spark):
    assert [r.w for r in spark.range(1, 9).select(state.backoff(F.col("id")).alias("w")).orderBy("id").collect()] == [60, 120, 240, 480, 960, 1920, 3600, 3600]
    cur = spark.createDataFrame([("a", 5, 100), ("b", 5, 100), ("c", 1, 1)], "session string, n_entries int, max_end_ms int")
    new = spark.createDataFrame([("a", 5, 100), ("b", 5, 101), ("d", 1, 1)], "session string, n_entries int, max_end_ms int")
    assert {r.session: r.action for r in state.upsert_exports(cur, new).collect()} == {"a": "duplicate", "b": "refreshed", "c": "kept", "d": "imported"}


def test_notes(spark):
    md = "# Title \n\n- **Дата:** 2024\n\n**Учасники:**\n- A\n- B\n\n## One\nx\ny\n## Two\nz"
    r = spark.range(1).select(notes.title(F.lit(md)).alias("t"), notes.field(F.lit(md), "Дата").alias("d"), notes.section(F.lit(md), "One").alias("s"), notes.bullets(F.lit(md), "Учасники").alias("b"), notes.json_object(F.lit('Sure: ```{"a": 1}``` ok'), "a int").alias("j")).first()
    assert (r.t, r.d, r.s, r.b, r.j.a) == ("Title", "2024", "x\ny", ["A", "B"], 1)
    rows = notes.transcript_rows(spark.createDataFrame([("s", "[10:00] A (chat): hi: there\nnoise\n[10:01] B: yo")], "session string, text string")).collect()
    assert [(r.line, r.speaker, r.is_chat, r.text) for r in rows] == [(1, "A", True, "hi: there"), (3, "B", False, "yo")]


def test_packets():
    import gzip

    inner = packets.encode((1, "dev"), (2, 7), (3, 300), (6, "привіт"), (8, 2))
    want = ("@dev", "7/@dev", 300, 2, "привіт")
    assert packets.caption(inner) == want and packets.caption(packets.encode((1, inner))) == want
    assert packets.caption(packets.encode((1, inner), (2, "other"))) is None
    assert all(packets.caption(inner[:k]) is None for k in range(len(inner)))
    assert packets.inflate(b"abc" + gzip.compress(inner)) == inner and packets.inflate(inner) == inner and packets.inflate(gzip.compress(inner)[:-9]) is None
    assert packets.inflate(gzip.compress(bytes(packets.MAX_INFLATED + 1))) is None
    record = packets.encode((1, "d1"), (2, "Ann"))
    assert packets.devices(packets.encode((2, packets.encode((2, packets.encode((2, record), (2, record))))))) == [("d1", "Ann")] * 2
    assert packets.devices(packets.encode((1, packets.encode((2, packets.encode((13, packets.encode((1, packets.encode((2, record)))))))))))[:1] == [("d1", "Ann")]
    assert "привіт" not in "".join(packets.shape(inner))


def test_summary_in_one_call(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    said = [("Оля", "Так, я підготую звіт до 15 травня."), ("Ігор", "Вирішили: використовуємо чергу."), ("Оля", "Погоджуюся, використовуємо чергу"), ("Ігор", "У нас вже є три сервери для тестів"), ("Оля", "Чи потрібен нам ще один сервер?")]
    (src / "meet-1.json").write_text(json.dumps(export([e(who, text, 60_000 * k) for k, (who, text) in enumerate(said)])))
    engine = Engine(spark, str(tmp_path / "out"))
    engine.ingest(str(src))
    s = "2024-05-01_10-00-00_meet-abc-def"
    items = [
        ("commitment", "Підготувати звіт", ["Оля"], "до 15 травня", "open", "explicit", "high"), ("decision", "Використовуємо чергу", [], "", "active", "", "high"), ("decision", "Використовуємо чергу.", [], "", "active", "", "low"),
        ("fact", "We have servers", [], "", "active", "", "high"), ("open_question", "Чи потрібен ще один сервер?", [], "", "open", "", "high"), ("fact", "Вигадка", [], "", "active", "", "high"),
    ]
    proofs = [(0, 0, "я підготую звіт", None), (1, 0, "Погоджуюся, використовуємо чергу", None), (2, 0, "використовуємо чергу", None), (3, 0, "вже є три сервери для тестів", None), (4, 0, "Чи потрібен нам ще один сервер", None), (5, 0, "цього не було", None)]
    i = spark.createDataFrame([(s, k, *r) for k, r in enumerate(items)], "session string, item_id int, type string, claim string, owners array<string>, deadline string, status string, commitment_strength string, confidence string")
    p = spark.createDataFrame([(s, *r) for r in proofs], "session string, item_id int, proof_ord int, quote string, timestamp string")
    out = engine.summary(i, p)
    assert sorted((r.type, r.claim) for r in out["ledger"].collect()) == [("commitment", "Підготувати звіт"), ("decision", "Використовуємо чергу"), ("fact", "Вже є три сервери для тестів"), ("open_question", "Чи потрібен ще один сервер?")]
    assert [r.code for r in out["findings"].where("severity = 'error'").collect()] == []
    r = out["sections"].first()
    assert r.tldr == "На зустрічі обговорили: Вже є три сервери для тестів. Явні рішення: Використовуємо чергу. Наступні кроки: Підготувати звіт — дедлайн: до 15 травня."
    assert (r.theses, r.decisions, r.actions, r.questions) == ("- Вже є три сервери для тестів", "- Використовуємо чергу", "- [Оля] Підготувати звіт — дедлайн: до 15 травня", "- Чи потрібен ще один сервер?")
