"""Queries on speech segments, speaker turns and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import evidence_norm, jaccard
from ..operators import align as A
from ..sources.tables import LINES_SQL, SIGNALS_SQL, document_lines, signals, table
from .registry import query

DAY = 86_400_000


@query("""with s as (select event_id, user_id as session, event_type as text, value as v, (event_id % 500)::double - 10 as st, (event_id % 500)::double + 30 - (event_id % 7) * 6 as en, (value - floor(value)) as p, -(value % 3) as lp, (value % 5) as cr from events),
 c as (select *, greatest(0.0, st) as s0, least(450.0, en) as e0 from s)
select session, event_id, s0 as start, e0 as "end" from c where not (p >= 0.75 or (p > 0.60 and lp < -0.5) or (cr > 2.8 and lp < -1.0) or trim(text) = '' or s0 >= 450 or e0 <= s0)""")
def segment_clip_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    s = e.select(F.col("user_id").alias("session"), "event_id", F.col("event_type").alias("text"), ((n % 500).cast("double") - 10).alias("start"), ((n % 500).cast("double") + 30 - (n % 7) * 6).alias("end"),
                 (F.col("value") - F.floor("value")).alias("no_speech_prob"), (-(F.col("value") % 3)).alias("avg_logprob"), (F.col("value") % 5).alias("compression_ratio"))
    return A.clip_and_reject(s, F.lit(450.0)).select("session", "event_id", "start", "end")


@query("""with s as (select l_orderkey, l_linenumber, l_quantity as st, l_quantity + l_linenumber * 2 as en from lineitem)
select l_orderkey, l_linenumber, round(greatest(0.0, -2.5 + st * 1.01), 6) as start, round(least(45.0, -2.5 + en * 1.01), 6) as "end" from s where least(45.0, -2.5 + en * 1.01) > greatest(0.0, -2.5 + st * 1.01)""")
def timeline_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("start"), (F.col("l_quantity") + F.col("l_linenumber") * 2).alias("end"))
    d = A.affine_timeline(s, F.lit(-2.5), F.lit(1.01), F.lit(45.0))
    return d.select("l_orderkey", "l_linenumber", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(f"""with {SIGNALS_SQL}, seg as (select session, event_id as seg_id, ms as s0, ms + 7200000 as s1 from signals where kind in ('view', 'click')),
 trn as (select session, event_id as turn_ord, kind as speaker, ms as t0, ms + 10800000 as t1 from signals where kind not in ('view', 'click')),
 h as (select s.session, s.seg_id, t.speaker, sum(least(s1, t1) - greatest(s0, t0)) as overlap, min(turn_ord) as f from seg s join trn t on s.session = t.session and s0 < t1 and t0 < s1 group by 1, 2, 3),
 r as (select *, row_number() over (partition by session, seg_id order by overlap desc, f) as k from h)
select s.session, s.seg_id, coalesce(speaker, 'UNKNOWN') as speaker, coalesce(overlap, 0)::bigint as overlap from seg s left join r on s.session = r.session and s.seg_id = r.seg_id and k = 1""")
def speaker_overlap_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks as segments of two hours, other events as turns of three."""
    s = signals(spark, sf_dir)
    seg = s.where("kind in ('view', 'click')").select("session", F.col("event_id").alias("seg_id"), F.col("ms").alias("start"), (F.col("ms") + 7_200_000).alias("end"))
    trn = s.where("kind not in ('view', 'click')").select("session", F.col("event_id").alias("turn_ord"), F.col("kind").alias("speaker"), F.col("ms").alias("start"), (F.col("ms") + 10_800_000).alias("end"))
    return A.overlap_speakers(seg, trn, 14_400_000).select("session", "seg_id", "speaker", "overlap")


@query(f"""with {LINES_SQL}, n as (select session, ord as id, start_ms, end_ms, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) as norm from doc_lines),
 t as (select *, case when norm = '' then [] else string_split(norm, ' ') end as tokens from n), m as (select * from t where id % 2 = 0), o as (select * from t where id % 2 = 1)
select session, id from m where not exists (select 1 from o where o.session = m.session and len(m.tokens) >= 4 and length(m.norm) >= 16 and len(o.tokens) >= 4 and o.end_ms >= m.start_ms - 60000 and o.start_ms <= m.end_ms + 60000
 and len(list_intersect(list_distinct(m.tokens), list_distinct(o.tokens))) >= 0.85 * len(list_distinct(list_concat(m.tokens, o.tokens))))""")
def mic_leak_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even lines as one track, odd lines as the other; token sets in place of the sequence ratio."""
    norm = evidence_norm(F.col("text"))
    t = document_lines(spark, sf_dir).select("session", F.col("ord").alias("id"), "start_ms", "end_ms", norm.alias("norm"), F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " ")).alias("tokens"))
    same = jaccard(F.col("m.tokens"), F.col("o.tokens")) >= 0.85
    return A.leaks(t.where("id % 2 = 0"), t.where("id % 2 = 1"), 60_000, same).select("session", "id")


@query()
def mic_leak_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the sequence ratio of the normalised texts."""
    norm = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_ ]", ""))
    t = document_lines(spark, sf_dir).select("session", F.col("ord").alias("id"), "start_ms", "end_ms", norm.alias("norm"), F.filter(F.split(norm, " +"), lambda x: x != "").alias("tokens"))
    mine, other = F.col("m.norm"), F.col("o.norm")
    return A.leaks(t.where("id % 2 = 0"), t.where("id % 2 = 1"), 30_000, A.may_agree(mine, other, 0.85), A.sequences_agree(mine, other, 0.85)).select("session", "id")


@query("""with s as (select user_id as session, event_id, case when event_id % 211 = 0 then 'B' when event_id % 223 = 0 then 'C' when event_id % 10 = 3 then 'UNKNOWN' else 'A' end as speaker, 0.0 as st, case when event_id % 211 = 0 or event_id % 223 = 0 then 2.0 else 60.0 end as en from events),
 d as (select session, speaker, sum(greatest(0.0, en - st)) as t from s where speaker <> 'UNKNOWN' group by 1, 2),
 p as (select session from (select session, count(*) as n, sum(t) as total, max(t) as top, list_sort(list(t)) as each from d group by 1) where n >= 3 and total > 0 and top >= 0.95 * total and each[-2] <= greatest(15.0, total * 0.01))
select session, event_id, case when session in (select session from p) then 'SPEAKER_00' else speaker end as speaker from s""")
def speaker_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    small = (n % 211 == 0) | (n % 223 == 0)
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "event_id", F.when(n % 211 == 0, "B").when(n % 223 == 0, "C").when(n % 10 == 3, "UNKNOWN").otherwise("A").alias("speaker"), F.lit(0.0).alias("start"), F.when(small, 2.0).otherwise(60.0).alias("end"))
    return A.collapse_speakers(s).select("session", "event_id", "speaker")


@query(f"""with {SIGNALS_SQL}, w as (select session, row_number() over (partition by session order by ms, event_id) as ord, kind as speaker, ms as s, ms + 500 as e, event_id || ' ,' as t from signals),
 a as (select *, case when lag(speaker) over w = speaker then 0 else 1 end as turned from w window w as (partition by session order by ord)), b as (select *, sum(turned) over (partition by session order by ord) as span from a),
 c as (select *, case when turned = 1 or s - max(e) over (partition by session, span order by ord rows between unbounded preceding and 1 preceding) > {DAY} then 1 else 0 end as cut from b), d as (select *, sum(cut) over (partition by session order by ord) as run from c)
select session, run::bigint as run, min(speaker) as speaker, min(s) as start, max(e) as "end", replace(string_agg(t, ' ' order by ord), ' ,', ',') as text from d group by 1, 2""")
def words_to_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    w = s.select("session", F.row_number().over(Window.partitionBy("session").orderBy("ms", "event_id")).alias("ord"), F.col("kind").alias("speaker"), F.col("ms").alias("start"), (F.col("ms") + 500).alias("end"), F.concat("event_id", F.lit(" ,")).alias("text"))
    return A.merge_words(w, DAY).select("session", "run", "speaker", "start", "end", "text")
