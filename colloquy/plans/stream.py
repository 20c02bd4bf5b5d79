"""Streaming queries over the event table as a file stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import SIGNALS_SQL, table
from ..streaming import captions as C
from ..streaming import monitors as M
from .clean import VERSIONS_SQL
from .registry import query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.file_stream(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session"), F.col("event_type").alias("key"), F.col("event_id").alias("ord"), F.floor(F.col("value") * 100).cast("long").alias("version"), F.col("event_id").cast("string").alias("text"), F.col("ts").cast("timestamp").alias("at"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))


@query(VERSIONS_SQL)
def stream_version_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed state of a stream gives what the batch window gives."""
    return C.latest(C.drained(C.version_upserts(_events(spark, sf_dir).drop("at")), "upserts", "update"))


@query(f"with {SIGNALS_SQL} select session, kind as key, count(*) as n from (select distinct session, kind, ms // 86400000 as day from signals) group by 1, 2")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event a user, type and day."""
    e = _events(spark, sf_dir).withColumn("day", F.floor(F.col("at_ms") / 86_400_000))
    return C.drained(C.first_seen(e, ["session", "key", "day"], "40 days").select("session", "key", "day"), "seen").groupBy("session", "key").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {SIGNALS_SQL}, u as (select user_id as session, event_type as key, epoch_us(ts) as us from events), a as (select *, case when us - lag(us) over (partition by session, key order by us) < 43200000000 then 0 else 1 end as cut from u),
 b as (select *, sum(cut) over (partition by session, key order by us rows unbounded preceding) as run from a) select session, key, count(*) as events, min(us) // 1000 as first_ms, max(us) // 1000 as last_ms from b group by session, key, run""")
def stream_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve hours of inactivity close an utterance."""
    d = C.drained(C.finalised(_events(spark, sf_dir), "12 hours", "40 days"), "utterances", "complete")
    return d.select("session", "key", "events", F.unix_millis("first_at").alias("first_ms"), F.unix_millis("last_at").alias("last_ms"))


HOUR, DAY = 3_600_000, 86_400_000


def _watched(spark: SparkSession, sf_dir: str, machine: M.Machine, keys: list[str], *columns: Column) -> DataFrame:
    """What a monitor makes of the event stream, up to each key's last event: where a key's clock ends then differs from stream to table."""
    e = _events(spark, sf_dir)
    with C.rocksdb(spark):
        seen = C.drained(M.watched(e.select("session", "key", "ord", "at", *columns), machine, keys, "40 days"), "watched").drop("batch")
    last = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).groupBy(*keys).agg(F.max("ms").alias("last"))
    return seen.join(last, keys).where("ms <= last").drop("last")


_TRACKS_SQL = f"""with {SIGNALS_SQL}, s as (select session, ms, event_id as id, case when kind in ('click', 'view') then 'mic' else 'system' end as track, value > 20 as active from signals),
 b as (select *, min(ms) over (partition by session) as st, max(ms) over (partition by session) as en, count(*) filter (track = 'mic') over w > 0 and count(*) filter (track = 'system') over w > 0 as both_seen from s window w as (partition by session order by ms, id rows between unbounded preceding and current row)),
 r as (select *, min(ms) filter (both_seen) over (partition by session) as ready from b),
 quiet as (select session, st, ready, ms as a, coalesce(lead(ms) over (partition by session order by ms, id), en) as z from r where active
   union all select session, any_value(st), any_value(ready), any_value(st), coalesce(min(ms) filter (active), any_value(en)) from r group by session),
 p as (select session, unnest(range(greatest(st + {DAY}, a + {DAY}, ready), z, {3 * DAY})) as ms from quiet where greatest(st + {DAY}, a + {DAY}, ready) < z)
select session, ms, 'prompt' as event, row_number() over (partition by session order by ms) as nth from (select distinct session, ms from p)"""


def _silence_rows() -> list[Column]:
    return [F.when(F.col("key").isin("click", "view"), "mic").otherwise("system").alias("what"), (F.col("version") / 100).alias("level")]


def _silence() -> M.SilenceMachine:
    return M.SilenceMachine(silence_ms=DAY, min_record_ms=DAY, repeat_ms=3 * DAY, mic_dbfs=20.01, system_dbfs=20.01)


@query(_TRACKS_SQL)
def stream_silence_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions asked when both tracks are silent, again every three days: timers over a stream, days in place of minutes."""
    return _watched(spark, sf_dir, _silence(), ["session"], *_silence_rows())


@query(_TRACKS_SQL)
def silence_monitor_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the table at once."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("key"), F.col("event_id").alias("ord"), F.floor(F.col("value") * 100).cast("long").alias("version"), F.col("ts").cast("timestamp").alias("at"))
    return M.watched_batch(e.select("session", "key", "ord", "at", *_silence_rows()), _silence(), ["session"])


@query(f"""with {SIGNALS_SQL}, v as (select session, kind as key, ms, event_id as id, floor(value * 100)::bigint as version from signals), g as (select *, case when ms - lag(ms) over w > {12 * HOUR} then 1 else 0 end as cut, max(version) over (partition by session, key order by ms, id) as top,
  lag(ms) over w as last_ms, min(ms) over (partition by session, key) as start_ms from v window w as (partition by session, key order by ms, id)),
 f as (select *, case when version > coalesce(lag(top) over (partition by session, key order by ms, id), -1) then id end as fresh from g), t as (select *, last_value(fresh ignore nulls) over (partition by session, key order by ms, id rows between unbounded preceding and 1 preceding) as text, lag(top) over (partition by session, key order by ms, id) as was from f)
select session, key, last_ms + {12 * HOUR} as ms, start_ms, last_ms, was as version, text::varchar as text, row_number() over (partition by session, key order by ms, id) as revision from t where cut = 1""")
def stream_caption_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions final after twelve hours of rest, opened again by later updates: one revision for each rest."""
    return _watched(spark, sf_dir, M.FinalMachine(12 * HOUR), ["session", "key"], F.col("version"), F.col("text"))


@query(f"""with {SIGNALS_SQL}, h as (select session, ms, event_id as id, kind = 'purchase' or (kind in ('click', 'view') and event_id % 2 = 0) as ok from signals), g as (select *, count(*) filter (ok) over (partition by session order by ms, id) as run from h),
 a as (select session, run, min(ms) filter (not ok) + {DAY} as due, min(ms) filter (ok) as began from g group by 1, 2), n as (select *, lead(began) over (partition by session order by run) as healed from a), e as (select session, max(ms) as en from h group by 1),
 f as (select session, due, healed, row_number() over (partition by session order by due) as nth from n join e using (session) where due < coalesce(healed, en))
select session, due as ms, 'fallback' as event, nth from f union all select session, healed, 'recovered', nth from f where healed is not null""")
def stream_capture_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures that stay unhealthy for a day fail once, and recover with the first sign of health."""
    k = F.col("key")
    return _watched(spark, sf_dir, M.HealthMachine(DAY), ["session"], F.when(k == "purchase", 1).otherwise(0).cast("long").alias("decoded"), F.when(k.isin("click", "view"), "open").otherwise("closed").alias("channel"), F.lit(1).cast("long").alias("packets"), (F.col("ord") % 2).alias("failures"))


@query(f"""with {SIGNALS_SQL}, c as (select session, ms, event_id as id, case kind when 'click' then 'toggle' when 'view' then 'start' else kind end as command, value > 30 as stale from signals), v as (select *, not stale and command in ('toggle', 'start') as valid from c),
 g as (select *, count(*) filter (valid and command = 'start') over w as starts, count(*) filter (valid) over w as nth from v window w as (partition by session order by ms, id rows unbounded preceding)),
 t as (select *, (starts > 0) <> (count(*) filter (valid and command = 'toggle') over (partition by session, starts order by ms, id rows unbounded preceding) % 2 = 1) as recording from g), l as (select *, coalesce(lag(recording) over (partition by session order by ms, id), false) as before from t)
select session, ms, id::varchar as name, case when stale then 'stale' when not valid then 'unknown' when command = 'start' and before then 'already_recording' else 'toggled' end as outcome, recording, nth from l""")
def stream_command_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands to a recorder in order: stale and unknown ones refused, a second start without effect."""
    k = F.col("key")
    return _watched(spark, sf_dir, M.CommandMachine(), ["session"], F.col("text").alias("name"), F.when(k == "click", "toggle").when(k == "view", "start").otherwise(k).alias("command"), F.when(F.col("version") > 3000, 30_001).otherwise(F.col("version") * 10).cast("long").alias("age_ms"))
