"""Live sessions watched by timers: silence of both tracks, captions that come to rest, failing capture, and commands.

Each monitor is a small machine that takes a key's rows in order of time and may ask to be woken later. Rows move a key's clock: what was due before a row
happens before it, whatever micro-batch brings the row. A timer in event time wakes the keys that get no more rows, once the watermark has
passed; a key woken by a timer and one moved on by a row end in the same state. State is one row a key, kept in RocksDB, so a query that
starts again from its checkpoint goes on where it was. Rows behind their key's clock count as being at it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.fold import _fold

NONE = -1  # no time

#: Fixed values, in milliseconds and decibels.
SILENCE_MS, MIN_RECORD_MS, REPEAT_MS, AUTO_STOP_MS = 90_000, 90_000, 600_000, 300_000
MIC_DBFS, SYSTEM_DBFS = -55.0, -60.0
FINALISE_MS = 1800
HEALTH_DELAY_MS = 20_000
COMMAND_MAX_AGE_MS = 30_000
COMMANDS = ("toggle", "start")


@dataclass(frozen=True)
class SilenceMachine:
    """Asks when both tracks have been silent, again after a while, and stops a session whose question stays unanswered.

    Rows: what ("mic", "system", or an answer: "continue", "unanswered") and level. Any activity takes back questions, delays and stops.
    """

    silence_ms: int = SILENCE_MS
    min_record_ms: int = MIN_RECORD_MS
    repeat_ms: int = REPEAT_MS
    auto_stop_ms: int = AUTO_STOP_MS
    mic_dbfs: float = MIC_DBFS
    system_dbfs: float = SYSTEM_DBFS

    reads = ("what", "level")
    state = "clock long, start long, mic_seen boolean, system_seen boolean, mic long, system long, prompted long, snoozed long, stop_at long, stopped boolean, prompts long"
    made = "ms long, event string, nth long"

    def begin(self, ms: int) -> dict[str, Any]:
        return {"clock": ms, "start": ms, "mic_seen": False, "system_seen": False, "mic": ms, "system": ms, "prompted": NONE, "snoozed": NONE, "stop_at": NONE, "stopped": False, "prompts": 0}

    def due(self, s: dict[str, Any]) -> int:
        """When something happens next if no row comes, NONE for never."""
        if s["stopped"]:
            return NONE
        times = []
        if s["mic_seen"] and s["system_seen"]:
            quiet = max(s["mic"], s["system"])
            times.append(max(s["clock"], s["start"] + self.min_record_ms, quiet + self.silence_ms, s["snoozed"], s["prompted"] + self.repeat_ms if s["prompted"] != NONE else NONE))
            if s["stop_at"] != NONE:
                times.append(max(s["clock"], s["stop_at"], quiet + self.auto_stop_ms))
        return min(times, default=NONE)

    def wake(self, s: dict[str, Any], ms: int) -> Iterator[tuple]:
        quiet = max(s["mic"], s["system"])
        if s["stop_at"] != NONE and ms >= max(s["stop_at"], quiet + self.auto_stop_ms):
            s["stopped"] = True
            yield ms, "stop", s["prompts"]
        else:
            s["prompted"], s["prompts"] = ms, s["prompts"] + 1
            yield ms, "prompt", s["prompts"]

    def take(self, s: dict[str, Any], ms: int, what: str, level: float) -> Iterator[tuple]:
        if what in ("mic", "system"):
            s[f"{what}_seen"] = True
            if level >= (self.mic_dbfs if what == "mic" else self.system_dbfs):
                s[what] = ms
                s["prompted"] = s["snoozed"] = s["stop_at"] = NONE
        elif what == "continue":
            s["prompted"], s["snoozed"], s["stop_at"] = ms, ms + self.repeat_ms, NONE
        elif what == "unanswered":
            s["stop_at"] = ms + max(0, self.auto_stop_ms - (ms - max(s["mic"], s["system"])))
        return iter(())


@dataclass(frozen=True)
class FinalMachine:
    """A caption is final once no update has come for a while; one that comes later opens it again, and its next rest is a revision of the row.

    Rows: version and text; an update of no newer version still keeps a caption open.
    """

    delay_ms: int = FINALISE_MS

    reads = ("version", "text")
    state = "clock long, start long, end long, version long, text string, open boolean, revision long"
    made = "ms long, start_ms long, last_ms long, version long, text string, revision long"

    def begin(self, ms: int) -> dict[str, Any]:
        return {"clock": ms, "start": ms, "end": ms, "version": NONE, "text": "", "open": False, "revision": 0}

    def due(self, s: dict[str, Any]) -> int:
        return s["end"] + self.delay_ms if s["open"] else NONE

    def wake(self, s: dict[str, Any], ms: int) -> Iterator[tuple]:
        s["open"], s["revision"] = False, s["revision"] + 1
        yield ms, s["start"], s["end"], s["version"], s["text"], s["revision"]

    def take(self, s: dict[str, Any], ms: int, version: int, text: str) -> Iterator[tuple]:
        s["end"], s["open"] = ms, True
        if version > s["version"]:
            s["version"], s["text"] = int(version), text
        return iter(())


@dataclass(frozen=True)
class HealthMachine:
    """A capture that stays unhealthy fails once: the deadline is set when it turns unhealthy, is never moved, and goes with the first sign of health.

    Rows: decoded, channel, packets, failures. Nothing decoded and either a channel that isn't open or packets that all fail: unhealthy.
    """

    delay_ms: int = HEALTH_DELAY_MS

    reads = ("decoded", "channel", "packets", "failures")
    state = "clock long, deadline long, failed boolean, failures long"
    made = "ms long, event string, nth long"

    def begin(self, ms: int) -> dict[str, Any]:
        return {"clock": ms, "deadline": NONE, "failed": False, "failures": 0}

    def due(self, s: dict[str, Any]) -> int:
        return NONE if s["failed"] else s["deadline"]

    def wake(self, s: dict[str, Any], ms: int) -> Iterator[tuple]:
        s["failed"], s["failures"] = True, s["failures"] + 1
        yield ms, "fallback", s["failures"]

    def take(self, s: dict[str, Any], ms: int, decoded: int, channel: str, packets: int, failures: int) -> Iterator[tuple]:
        healthy = decoded > 0 or (channel == "open" and not (packets > 0 and failures > 0))
        if healthy:
            if s["failed"]:
                yield ms, "recovered", s["failures"]
            s["deadline"], s["failed"] = NONE, False
        elif s["deadline"] == NONE:
            s["deadline"] = ms + self.delay_ms


@dataclass(frozen=True)
class CommandMachine:
    """Commands in order of their names: stale and unknown ones are refused, a start while recording changes nothing.

    Rows: name, command and age_ms (how old the command was when it was read).
    """

    max_age_ms: int = COMMAND_MAX_AGE_MS

    reads = ("name", "command", "age_ms")
    state = "clock long, recording boolean, handled long"
    made = "ms long, name string, outcome string, recording boolean, nth long"

    def begin(self, ms: int) -> dict[str, Any]:
        return {"clock": ms, "recording": False, "handled": 0}

    def due(self, s: dict[str, Any]) -> int:
        return NONE

    def wake(self, s: dict[str, Any], ms: int) -> Iterator[tuple]:
        return iter(())

    def take(self, s: dict[str, Any], ms: int, name: str, command: str, age_ms: int) -> Iterator[tuple]:
        if age_ms > self.max_age_ms:
            outcome = "stale"
        elif command not in COMMANDS:
            outcome = "unknown"
        elif command == "start" and s["recording"]:
            outcome = "already_recording"
        else:
            outcome, s["recording"] = "toggled", not s["recording"]
        s["handled"] += outcome in ("toggled", "already_recording")
        yield ms, name, outcome, s["recording"], s["handled"]


Machine = SilenceMachine | FinalMachine | HealthMachine | CommandMachine


def advance(machine: Machine, s: dict[str, Any], ms: int) -> Iterator[tuple]:
    """All that is due before ms, in order."""
    while (at := machine.due(s)) != NONE and at < ms:
        s["clock"] = at
        yield from machine.wake(s, at)


def run(machine: Machine, s: dict[str, Any] | None, rows: pd.DataFrame, made: list[tuple]) -> dict[str, Any] | None:
    """The state after some rows (ms, ord and what the machine reads), to which what happens is added."""
    for ms, *values in rows.sort_values(["ms", "ord"], kind="stable")[["ms", *machine.reads]].itertuples(index=False):
        s = machine.begin(int(ms)) if s is None else s
        at = max(int(ms), s["clock"])
        made.extend(advance(machine, s, at))
        s["clock"] = at
        made.extend(machine.take(s, at, *values))
    return s


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


class Monitor(StatefulProcessor):
    """A machine for each key of a stream."""

    def __init__(self, machine: Machine, keys: list[str]):
        self.machine, self.keys = machine, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("machine", self.machine.state)

    def _load(self) -> dict[str, Any] | None:
        return dict(zip(_names(self.machine.state), self.held.get(), strict=True)) if self.held.exists() else None

    def _save(self, key: tuple, s: dict[str, Any], made: list[tuple]) -> Iterator[pd.DataFrame]:
        self.held.update(tuple(s.values()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if (at := self.machine.due(s)) != NONE:
            self.handle.registerTimer(at)
        if made:
            yield pd.DataFrame([(*key, *m) for m in made], columns=[*self.keys, *_names(self.machine.made)])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        made: list[tuple] = []
        s = run(self.machine, self._load(), pd.concat(list(rows)), made)  # a key's rows of one micro-batch
        yield from self._save(key, s, made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        made: list[tuple] = []
        s = self._load()
        made.extend(advance(self.machine, s, expiredTimerInfo.getExpiryTimeInMs() + 1))
        yield from self._save(key, s, made)

    def close(self) -> None:
        pass


def watched(rows: DataFrame, machine: Machine, keys: list[str], late: str) -> DataFrame:
    """What happens to each key of a stream: keys and the machine's columns. rows: keys, at (time), ord, and what the machine reads.

    Start the query with the RocksDB state store (rocksdb()). Rows later than `late` are let go.
    """
    spark = rows.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = ", ".join([*(f"{k} {kinds[k]}" for k in keys), machine.made])
    d = rows.withWatermark("at", late).select(*keys, "at", F.unix_millis("at").alias("ms"), "ord", *machine.reads)
    schema = spark.createDataFrame([], out).schema
    return d.groupBy(*keys).transformWithStateInPandas(Monitor(machine, keys), schema, "Append", "EventTime")


def watched_batch(rows: DataFrame, machine: Machine, keys: list[str]) -> DataFrame:
    """The same for a table that is all there, each key's rows taken in order batch by batch: what happens up to the key's last row."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = ", ".join([*(f"{k} {kinds[k]}" for k in keys), machine.made])
    columns = [*keys, *_names(machine.made)]

    def of_key(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = None
        for frame in parts:
            made: list[tuple] = []
            s = run(machine, s, frame, made)
            key = tuple(frame[keys].iloc[0])
            yield pd.DataFrame([(*key, *m) for m in made], columns=columns)

    return _fold(rows.select(*keys, F.unix_millis("at").alias("ms"), "ord", *machine.reads), keys, out, ["ms", "ord"], of_key)
