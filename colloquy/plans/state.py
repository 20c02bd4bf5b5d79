"""State-table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state as S
from ..sources.tables import SIGNALS_SQL, signals, table
from .registry import query

HOUR, DAY = 3_600_000, 86_400_000


@query(f"""with {SIGNALS_SQL}, e as (select session, event_id as id, ms as t, case when event_id % 3 = 0 then 'empty_response' else 'other' end as kind from signals where kind = 'error'),
 a as (select *, row_number() over w as attempts, case when lag(kind) over w = kind then 0 else 1 end as turned from e window w as (partition by session order by t, id)), b as (select *, sum(turned) over (partition by session order by t, id) as turn from a),
 c as (select *, row_number() over (partition by session, turn order by t, id) as same_kind from b), d as (select *, attempts >= 5 or (kind = 'empty_response' and same_kind >= 2) as terminal from c)
select session, id, kind, attempts, same_kind, terminal, case when not terminal then least(3600, 60 * power(2, attempts - 1))::bigint end as wait_s from d""")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = signals(spark, sf_dir).where("kind = 'error'").select("session", F.col("event_id").alias("id"), F.col("ms").alias("at"), F.when(F.col("event_id") % 3 == 0, "empty_response").otherwise("other").alias("kind"))
    return S.retry_schedule(e).select("session", "id", "kind", F.col("attempts").cast("long").alias("attempts"), F.col("same_kind").cast("long").alias("same_kind"), "terminal", "wait_s")


@query(f"""with {SIGNALS_SQL}, e as (select session, ms // {DAY} as arrival, count(*) as n_entries, max(ms) - min(ms) as max_end_ms from signals group by 1, 2),
 r as (select *, row_number() over (partition by session order by n_entries desc, max_end_ms desc, arrival) as k, count(*) over (partition by session) as exports from e) select session, arrival, n_entries, max_end_ms, exports from r where k = 1""")
def fuller_export_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's days as exports of one session."""
    e = signals(spark, sf_dir).groupBy("session", F.floor(F.col("ms") / DAY).cast("long").alias("arrival")).agg(F.count(F.lit(1)).alias("n_entries"), (F.max("ms") - F.min("ms")).alias("max_end_ms"))
    return S.fuller_exports(e)


@query("""select o_orderkey as session, o_orderdate as finished_at from orders where o_orderstatus = 'F' and o_totalprice > 1000 and o_orderdate < timestamp '1998-08-02' - interval 1000 days""")
def retention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("open").alias("status"), (F.col("o_totalprice") > 1000).alias("has_output"), F.col("o_orderdate").alias("finished_at"))
    return S.retention(d, F.lit("1998-08-02").cast("timestamp_ntz"), 1000).select("session", "finished_at")


@query(f"""with {SIGNALS_SQL}, s as (select session, ms, event_id as id, case when kind in ('click', 'view') then 'mic' else 'system' end as track, value > 20 as active from signals),
 b as (select *, min(ms) over (partition by session) as st, max(ms) over (partition by session) as en, count(*) filter (track = 'mic') over w > 0 and count(*) filter (track = 'system') over w > 0 as both_seen from s window w as (partition by session order by ms, id rows between unbounded preceding and current row)),
 r as (select *, min(ms) filter (both_seen) over (partition by session) as ready from b), a as (select *, coalesce(lead(ms) over (partition by session order by ms, id), en) as t from r where active)
select session, ms as silent_from, t as silent_to from a where t - ms >= {DAY} and t >= st + {DAY} and ready <= t""")
def silence_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two event families as the tracks, days in place of minutes."""
    s = signals(spark, sf_dir).select("session", "ms", F.col("event_id").alias("id"), F.when(F.col("kind").isin("click", "view"), "mic").otherwise("system").alias("track"), (F.col("value") > 20).alias("active"))
    return S.silences(s, DAY, DAY)
