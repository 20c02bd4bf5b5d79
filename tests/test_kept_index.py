"""The kept index through the engine: notes, items and transcripts; replacement, removal, rebuild, and what a search reads."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from colloquy.engine import Engine
from colloquy.operators.index import SearchIndex, shard_of
from colloquy.operators.snippets import snippet

NOTE = """# Sync про Event Router

- **Дата:** 2026-08-03
- **Час:** 11:15
- **Тип зустрічі:** Планування
- **Якість:** high

**Присутні:**

- Olesia Khabliuk
- Max
- —
- Max

## TL;DR

- Router лишаємо
- —
- Café список

---
## Рішення
- щось
"""
TRANSCRIPT = "[11:15:01] Olesia Khabliuk: Привіт усім\nпорожній рядок\n[11:15:05] Max (chat): Погоджуюсь, використовуємо router лише там\n[11:16:00] Olesia Khabliuk:  \n"
ITEMS = "session string, item_id int, type string, claim string, speaker string, owners array<string>, status string, deadline string, evidence array<struct<quote:string,timestamp:string,line:int>>"
SESSION = "2026-08-03_11-15-00_meet-a"


def write(folder, session, text, tail=" — Sync", age=0):
    path = folder / f"{session}{tail}.md"
    path.write_text(text, encoding="utf-8")
    os.utime(path, (1_700_000_000 - age, 1_700_000_000 - age))


@pytest.fixture
def setting(spark, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    write(folder, SESSION, NOTE)
    write(folder, SESSION, "# Old\n", " — old", age=100)
    write(folder, "2026-07-01_x", "no heading at all", "")
    (folder / "_bad name.md").write_text("# x")
    items = [
        (SESSION, 0, "decision", "Використовуємо Event Router там, де це корисно", "Max", ["Max"], "active", "", [("q", "", 3), ("q", "11:15:05", 2)]),
        (SESSION, 1, "commitment", "Підготувати  список процесів", "Olesia", ["Olesia Khabliuk", "Olesia Khabliuk", " "], "open", "завтра", [("q", "11:16:00", 4)]),
        (SESSION, 2, "thing", "Event Router", "x", [], "", "", []), (SESSION, 3, "fact", " ", "x", [], "", "", []), ("gone", 0, "fact", "Event", "x", [], "", "", []),
    ]
    texts = [(SESSION, TRANSCRIPT), ("2026-07-01_x", "[00:01] A: nothing of note")]

    def index(engine, items=items, texts=texts, **more):
        return engine.index(str(folder), spark.createDataFrame(items, ITEMS), spark.createDataFrame(texts, "session string, text string"), **more)

    return Engine(spark, str(tmp_path / "out")), folder, index, items


def test_index_and_find(spark, setting):
    engine, folder, index, items = setting
    with pytest.raises(LookupError):
        engine.find("router")
    assert index(engine) == {"indexed": 2, "unchanged": 0, "removed": 0}
    assert index(engine) == {"indexed": 0, "unchanged": 2, "removed": 0}
    rows = engine.find("Що вирішили про Event Router?").collect()
    assert [(r.session, r.kind) for r in rows] == [(SESSION, "decision"), (SESSION, "title")] and "«Event» «Router»" in rows[0].snippet
    assert (rows[0].title, rows[0].meeting_time, rows[0].meeting_type, rows[0].quality, rows[0].participants) == ("Sync про Event Router", "11:15", "Планування", "high", ["Olesia Khabliuk", "Max"])
    assert (rows[0].timestamp, rows[0].source_line, rows[0].owners) == ("11:15:05", 2, "Max")
    one = engine.find("", participants=["Olesia"], owner="olesia", kinds=["commitment"], status="open", date_from="2026-08-01", date_to="2026-08-31").collect()
    assert [(r.text, r.deadline, r.owners, r.snippet) for r in one] == [("Підготувати список процесів", "завтра", "Olesia Khabliuk", "Підготувати список процесів")]
    assert engine.find("Event Router", participants=["Nobody"]).collect() == []
    assert [(r.kind, r.text) for r in engine.find("cafe").collect()] == [("tldr", "Router лишаємо Café список")] == [(r.kind, r.text) for r in engine.find("CAFÉ").collect()]
    assert [(r.kind, r.speaker, r.source_line) for r in engine.find("погоджуюсь").collect()] == [("chat", "Max", 3)]
    assert [r.title for r in engine.find("nothing").collect()] == ["2026-07-01_x"]
    with pytest.raises(ValueError):
        engine.find("x", kinds=["nonsense"])
    with pytest.raises(ValueError):
        engine.find("x", limit=201)


def test_changed_sessions_are_replaced_and_lost_ones_go(spark, setting):
    engine, folder, index, items = setting
    index(engine)
    changed = [(*items[0][:3], "Вирішили інакше про шину", *items[0][4:]), *items[1:]]
    assert index(engine, items=changed) == {"indexed": 1, "unchanged": 1, "removed": 0}
    assert [r.kind for r in engine.find("шину").collect()] == ["decision"]
    assert [r.kind for r in engine.find("event router").collect()] == ["title"]
    (folder / "2026-07-01_x.md").unlink()
    assert index(engine, items=changed) == {"indexed": 0, "unchanged": 1, "removed": 1}
    assert engine.find("nothing").collect() == []
    kept = SearchIndex(spark, engine._table("index"))
    assert kept.version() == 3
    assert index(engine, items=changed, rebuild=True) == {"indexed": 1, "unchanged": 0, "removed": 0}
    assert len(kept.manifest()["segments"]) == 1 and len(kept.manifest(2)["segments"]) == 2 and kept.manifest(4)["schemas"]
    assert [r.kind for r in engine.find("шину").collect()] == ["decision"]


def test_two_writers(spark, setting):
    engine, _, index, _ = setting
    index(engine)
    kept = SearchIndex(spark, engine._table("index"))
    kept._commit(2, kept.manifest())
    with pytest.raises(RuntimeError):
        kept._commit(2, kept.manifest())
    assert kept.version() == 2 and engine.find("event").count() == 2


def test_a_search_reads_the_shards_of_its_terms_only(spark, setting):
    engine, _, index, _ = setting
    index(engine)
    kept = SearchIndex(spark, engine._table("index"))
    sessions = kept.sessions()
    short = next(t for t in ("me", "we", "so") if shard_of(t) != shard_of("router"))
    plan = kept._scored(["router", short], kept.manifest(), sessions.select("session", "segment"), sessions, {})._jdf.queryExecution().executedPlan().toString()
    shards = sorted({shard_of("router"), shard_of(short)})
    assert f"IN ({','.join(map(str, shards))})" in plan and "StringStartsWith(token,router)" in plan and f"EqualTo(token,{short})" in plan
    assert "text" not in plan.split("ReadSchema:")[1].split("\n")[0]


@pytest.mark.parametrize(("text", "want"), [
    ("a b", "a b"), ("Ann: that!", "Ann: «that»!"), (None, ""), ("", ""),
    ("x " * 30 + "that", "… x x x x x x x x x x x x x x x x x x x x x x x «that»"),
    ("One. " + "x " * 30 + "that end " + "y " * 30, "… x x x x x x x x x x x «that» end y y y y y y y y y y y …"),
    ("x " * 40 + "It ends. Here is that, with more " + "y " * 40, "… Here is «that», «with» more y y y y y y y y y y y y y y y y y y y …"),
    ("that " + "x " * 30 + "with that " + "x " * 30, "… x x x x x x x x x x x «with» «that» x x x x x x x x x x x …"),
])
def test_snippets(spark, text, want):
    d = spark.createDataFrame([(text,)], "t string")
    assert d.select(snippet(F.col("t"), ["that", "with"]).alias("s")).first().s == want
