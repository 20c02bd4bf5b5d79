"""Monitors: each machine by written cases, and a stream stopped and started again between files against the batch."""

from __future__ import annotations

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.streaming import captions, monitors as M

S = 1000


def events(machine, rows, until=None):
    made, state = [], None
    for k, r in enumerate(rows):
        state = M.run(machine, state, pd.DataFrame([(r[0], k, *r[1:])], columns=["ms", "ord", *machine.reads]), made)
    if until is not None:
        made.extend(M.advance(machine, state, until + 1))
    whole = []
    last = M.run(machine, None, pd.DataFrame([(r[0], k, *r[1:]) for k, r in enumerate(rows)], columns=["ms", "ord", *machine.reads]), whole)
    if until is not None:
        whole.extend(M.advance(machine, last, until + 1))
    assert made == whole  # one by one or all at once
    return made


LOUD, QUIET = -20.0, -90.0
BOTH = [(0, "mic", LOUD), (0, "system", LOUD)]


@pytest.mark.parametrize(("rows", "until", "want"), [
    (BOTH, 89 * S, []),
    (BOTH, 90 * S, [(90 * S, "prompt", 1)]),
    (BOTH, 700 * S, [(90 * S, "prompt", 1), (690 * S, "prompt", 2)]),
    ([(0, "mic", LOUD)], 900 * S, []),
    ([(0, "mic", LOUD), (200 * S, "system", QUIET)], 200 * S, [(200 * S, "prompt", 1)]),
    ([*BOTH, (60 * S, "system", LOUD)], 160 * S, [(150 * S, "prompt", 1)]),
    ([*BOTH, (60 * S, "system", -60.5)], 100 * S, [(90 * S, "prompt", 1)]),
    ([*BOTH, (95 * S, "continue", 0.0)], 700 * S, [(90 * S, "prompt", 1), (695 * S, "prompt", 2)]),
    ([*BOTH, (95 * S, "continue", 0.0), (100 * S, "mic", LOUD)], 200 * S, [(90 * S, "prompt", 1), (190 * S, "prompt", 2)]),
    ([*BOTH, (100 * S, "unanswered", 0.0)], 900 * S, [(90 * S, "prompt", 1), (300 * S, "stop", 1)]),
    ([*BOTH, (100 * S, "unanswered", 0.0), (250 * S, "mic", LOUD)], 345 * S, [(90 * S, "prompt", 1), (340 * S, "prompt", 2)]),
    ([*BOTH, (100 * S, "unanswered", 0.0), (150 * S, "continue", 0.0)], 740 * S, [(90 * S, "prompt", 1)]),
    ([*BOTH, (400 * S, "unanswered", 0.0)], 900 * S, [(90 * S, "prompt", 1), (400 * S, "stop", 1)]),
])
def test_silence(rows, until, want):
    assert events(M.SilenceMachine(), rows, until) == want


def test_captions_come_to_rest_and_open_again():
    rows = [(0, 1, "a"), (1000, 2, "ab"), (1500, 1, "old"), (5000, 3, "abc"), (6800, 3, "same")]
    assert events(M.FinalMachine(), rows, 20_000) == [(3300, 0, 1500, 2, "ab", 1), (8600, 0, 6800, 3, "abc", 2)]


def test_health_fails_once_and_recovers():
    bad, open_, ok = (0, "closed", 0, 0), (0, "open", 0, 0), (2, "closed", 9, 0)
    assert events(M.HealthMachine(), [(0, *bad), (15 * S, *bad), (19 * S, *bad)], 60 * S) == [(20 * S, "fallback", 1)]
    assert events(M.HealthMachine(), [(0, *bad), (15 * S, *open_), (16 * S, *bad)], 30 * S) == []
    assert events(M.HealthMachine(), [(0, *bad), (25 * S, *ok), (26 * S, 0, "open", 5, 5), (60 * S, *open_)]) == [(20 * S, "fallback", 1), (25 * S, "recovered", 1), (46 * S, "fallback", 2), (60 * S, "recovered", 2)]


def test_commands():
    rows = [(0, "a", "start", 10), (1, "b", "start", 10), (2, "c", "toggle", 31_000), (3, "d", "toggle", 30_000), (4, "e", "halt", 0), (5, "f", "toggle", 0)]
    assert [r[1:] for r in events(M.CommandMachine(), rows)] == [("a", "toggled", True, 1), ("b", "already_recording", True, 2), ("c", "stale", True, 2), ("d", "toggled", False, 3), ("e", "unknown", False, 3), ("f", "toggled", True, 4)]


def test_rows_behind_the_clock_count_as_at_it():
    made, state = [], None
    for ms, version, text in [(0, 1, "a"), (5000, 2, "b"), (100, 3, "c")]:  # three micro-batches
        state = M.run(M.FinalMachine(), state, pd.DataFrame([(ms, 0, version, text)], columns=["ms", "ord", "version", "text"]), made)
    assert [*made, *M.advance(M.FinalMachine(), state, 9000)] == [(1800, 0, 0, 1, "a", 1), (6800, 0, 5000, 3, "c", 2)]


SCHEMA = "session long, at timestamp, ord long, what string, level double, ms string, clock int"


def test_a_stream_started_again_equals_the_table(spark, tmp_path):
    """Three files, a query that ends after each and starts again from its checkpoint; timers set before the restart fire after it."""
    rng, rows, at = random.Random(4), [], 0
    for k in range(240):
        at += rng.choice([1, 5, 20, 120, 400]) * S
        rows.append((rng.randrange(3), datetime.datetime.fromtimestamp(at / 1000), k, rng.choice(["mic", "system", "continue", "unanswered"]), rng.choice([LOUD, QUIET, QUIET]), "x", 1))
    out, state, folder = str(tmp_path / "out"), str(tmp_path / "state"), tmp_path / "in"
    with captions.rocksdb(spark):
        for part in range(3):
            spark.createDataFrame(rows[part * 80 : part * 80 + 80], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
            stream = spark.readStream.schema(SCHEMA).parquet(str(folder))
            M.watched(stream, M.SilenceMachine(), ["session"], "0 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or "")
    table = spark.createDataFrame(rows, SCHEMA)
    last = table.groupBy("session").agg(F.max(F.unix_millis("at")).alias("last"))
    got = spark.read.parquet(out).join(last, "session").where("ms < last").drop("last")
    want = M.watched_batch(table, M.SilenceMachine(), ["session"])
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(got) == key(want.join(last, "session").where("ms < last").drop("last")) != []
