"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_speaker
from ..operators import clean as C
from ..sources.tables import LINES_SQL, SIGNALS_SQL, TURNS_SQL, document_lines, signals, table, turns
from .registry import query

HOURS = 3_600_000
CLEAN = "trim(regexp_replace(regexp_replace({}, '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g'), '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


@query(f"""with {TURNS_SQL} select session, ord, case when speaker = 'user' then 'User' else speaker end as speaker, {CLEAN.format("text")} as text, kind,
 greatest(0, start_ms - 4000) as start_ms, greatest(greatest(0, start_ms - 4000), end_ms - 4000) as end_ms from turns where {CLEAN.format("text")} <> ''""")
def entry_projection_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw entries with speaker tails, number texts and negative times through the entry projection."""
    t = turns(spark, sf_dir)
    raw = t.select("session", "ord", F.when(F.col("speaker") == "user", " User  & 3 others ").otherwise(F.col("speaker")).alias("speaker"), F.concat(F.lit("  "), "text", F.lit("\t")).alias("text"), "kind",
                   F.concat((F.col("start_ms") - 4000).cast("string"), F.lit(".75")).alias("startMs"), (F.col("end_ms") - 4000).cast("string").alias("endMs"))
    raw = raw.withColumn("startMs", F.when(F.col("startMs").startswith("-"), "-4000").otherwise(F.col("startMs")))
    return C.refuse_bad_times(C.project_entries(raw))


@query("""select c_custkey, case c_custkey % 4 when 0 then c_name when 1 then c_name when 2 then c_name else 'Невідомий' end as speaker from customer""")
def speaker_suffix_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    forms = [name, F.concat(name, F.lit("  & 12 Others")), F.concat(name, F.lit(" та ще 3 учасники")), F.lit(" \n ")]
    raw = F.element_at(F.array(*forms), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", clean_speaker(raw).alias("speaker"))


@query(r"""select page_id, case when s = '' then 'default' else s end as code, strftime(timestamp '2024-01-01' + to_seconds(page_id), '%Y-%m-%d_%H-%M-%S') || '_meet-' || case when s = '' then 'default' else s end as session
from (select page_id, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) as s from pages)""")
def meeting_code_session_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.substring(F.regexp_replace(F.regexp_replace(F.lower("url"), "[^a-z0-9-]+", "-"), "^-+|-+$", ""), 1, 40)
    d = table(spark, sf_dir, "pages").select("page_id", F.when(code == "", "default").otherwise(code).alias("code"))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("page_id"))
    return d.withColumn("session", F.concat(F.date_format(at, "yyyy-MM-dd_HH-mm-ss"), F.lit("_meet-"), F.col("code"))).where(F.col("session").rlike("^[A-Za-z0-9][A-Za-z0-9_.-]*$"))


@query(f"""with {SIGNALS_SQL}, l as (select *, lag(ms) over (partition by session, kind order by ms, event_id) as p from signals)
select session, event_id, coalesce(ms - p <= {6 * HOURS}, false) as candidate from l""")
def replay_recent_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).select("session", F.col("event_id").alias("ord"), F.col("kind").alias("speaker"), F.lit("caption").alias("kind"), F.col("kind").alias("text"), F.col("ms").alias("start_ms"))
    return C.recent_replays(s, 6 * HOURS).select("session", F.col("ord").alias("event_id"), "candidate")


_BATCHES = """b as (select session, speaker, kind, text, ord, ord // 4 * 60000 as start_ms from doc_lines),
 f as (select *, min(start_ms) over (partition by session, kind, speaker, text) as first_ms, row_number() over (partition by session, kind, speaker, text order by start_ms, ord) as nth from b),
 r as (select *, max(case when (length(text) >= 80 or len(string_split(trim(regexp_replace(text, '[\\s\\x{85}\\p{Z}]+', ' ', 'g')), ' ')) >= 12) and first_ms < start_ms then 1 else 0 end) over (partition by session, start_ms) as replay from f)"""


@query(f"with {LINES_SQL}, {_BATCHES} select session, ord, start_ms from r where not (replay = 1 and nth > 1)")
def replay_exact_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lines of a document share a start."""
    d = document_lines(spark, sf_dir).withColumn("start_ms", (F.floor(F.col("ord") / 4) * 60000).cast("long"))
    return C.exact_replay_batches(d).select("session", "ord", "start_ms")


@query(f"""with {LINES_SQL}, n as (select session, ord, text, row_number() over (partition by session, kind, speaker, text order by start_ms, ord) as nth from doc_lines)
select session, ord from n where nth = 1 or not (length(text) >= 80 or len(string_split(trim(regexp_replace(text, '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g')), ' ')) >= 12)""")
def chat_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exact_dedup(document_lines(spark, sf_dir)).select("session", "ord")


@query(f"""with {SIGNALS_SQL}, a as (select session, event_id, ms, kind, ms + 1000 as e, case when lag(kind) over w = kind then 0 else 1 end as turned from signals window w as (partition by session order by ms, event_id)),
 b as (select *, sum(turned) over (partition by session order by ms, event_id) as span from a),
 c as (select *, case when turned = 1 or ms > max(e) over (partition by session, span order by ms, event_id rows between unbounded preceding and 1 preceding) + {12 * HOURS} then 1 else 0 end as cut from b),
 d as (select *, sum(cut) over (partition by session order by ms, event_id) as run from c)
select session, run::bigint as run, min(kind) as speaker, string_agg(event_id::varchar, ' ' order by ms, event_id) as text, min(ms) as start_ms, max(e) as end_ms, count(*) as parts from d group by session, run""")
def turns_merge_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).select("session", F.col("event_id").alias("ord"), F.col("kind").alias("speaker"), F.col("event_id").cast("string").alias("text"), F.col("ms").alias("start_ms"), (F.col("ms") + 1000).alias("end_ms"))
    return C.merge_consecutive(s, 12 * HOURS)


VERSIONS_SQL = f"""with {SIGNALS_SQL}, v as (select session, kind as key, event_id, ms, cast(floor(value * 100) as bigint) as version from signals),
 t as (select *, max(version) over (partition by session, key order by ms, event_id rows between unbounded preceding and 1 preceding) as top from v),
 ok as (select * from t where version >= 0 and (top is null or version > top))
select session, key, max(version) as version, arg_max(event_id::varchar, version) as text, min(ms) as start_ms, max(ms) as end_ms, count(*) as accepted from ok group by 1, 2"""


@query(VERSIONS_SQL)
def version_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = signals(spark, sf_dir).select("session", F.col("kind").alias("key"), F.struct("ms", "event_id").alias("arrival"), F.floor(F.col("value") * 100).cast("long").alias("version"), F.col("event_id").cast("string").alias("text"), F.col("ms").alias("at_ms"))
    return C.latest_versions(e)


@query(f"""with {SIGNALS_SQL}, day as (select session, event_id, ms % 86400000 as ms, ms as real, row_number() over (partition by session order by ms, event_id) as ord from signals),
 r as (select *, coalesce((lag(ms) over (partition by session order by ord) - ms > {12 * HOURS})::int, 0) as rolled from day),
 a as (select *, ms + 86400000 * sum(rolled) over (partition by session order by ord) as abs_ms from r), m as (select *, min(abs_ms) over (partition by session) as lo, max(abs_ms) over (partition by session) as hi from a)
select session, event_id, abs_ms::bigint as abs_ms from m where hi - lo >= {10 * HOURS} and abs_ms >= hi - {8 * HOURS}""")
def closing_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only times of day are known; hours stand in for minutes."""
    s = signals(spark, sf_dir).withColumn("ord", F.row_number().over(Window.partitionBy("session").orderBy("ms", "event_id"))).withColumn("ms", F.col("ms") % 86_400_000)
    return C.closing_excerpt(s, 10 * HOURS, 8 * HOURS, 12 * HOURS).select("session", "event_id", "abs_ms")


@query(f"""with {TURNS_SQL} select session, ord, case when ord <= max(case when speaker = 'assistant' then ord end) over (partition by session) then 'prefix' else 'suffix' end as part from turns""")
def prefix_suffix_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_at_last(turns(spark, sf_dir), F.col("speaker") == "assistant").select("session", "ord", "part")
