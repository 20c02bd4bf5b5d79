"""Quality, classification and rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources.tables import SIGNALS_SQL, TURNS_SQL, signals, table, turns
from .registry import query

_METRICS = f"""{SIGNALS_SQL}, e as (select session, case when kind = 'purchase' then 'chat' else 'caption' end as kind, case when event_id % 7 = session % 7 then ['Unknown', ' local_unknown ', 'Учасник', 'УЧАСНИК 12', 'невідомий'][event_id % 5 + 1] else ['P0', 'SPEAKER_07', 'Unknown Soldier', '', 'Учасники'][event_id % 5 + 1] end as speaker, ms as start_ms from signals),
 g as (select *, case when kind <> 'chat' then start_ms - lag(start_ms) over (partition by session, kind <> 'chat' order by start_ms) end as gap from e),
 m as (select session, count(*) filter (kind <> 'chat') as captions, count(*) filter (kind = 'chat') as chats, coalesce(avg(case when kind <> 'chat' then (lower(trim(speaker)) in ('unknown', 'local_unknown', 'невідомий', 'учасник', 'учасник 12'))::int::double end), 1.0) as unknown_ratio, coalesce(max(gap), 0) as max_gap_ms from g group by 1)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as captions; a seventh of the names, in all spellings, stand for unknown speakers, the others only look like it."""
    name = lambda *each: F.element_at(F.array(*map(F.lit, each)), (F.col("event_id") % 5 + 1).cast("int"))
    return signals(spark, sf_dir).select("session", F.when(F.col("kind") == "purchase", "chat").otherwise("caption").alias("kind"), F.when(F.col("event_id") % 7 == F.col("session") % 7, name("Unknown", " local_unknown ", "Учасник", "УЧАСНИК 12", "невідомий")).otherwise(name("P0", "SPEAKER_07", "Unknown Soldier", "", "Учасники")).alias("speaker"), F.col("ms").alias("start_ms"))


@query(f"with {_METRICS} select session, captions, chats, round(unknown_ratio, 6) as unknown_ratio, max_gap_ms from m")
def caption_gap_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.capture_metrics(_entries(spark, sf_dir)).withColumn("unknown_ratio", F.round("unknown_ratio", 6))


_HEALTH = """h as (select m.*, session % 5 <> 0 as has_health, session % 4 = 1 as unavailable, session % 8 = 1 as recovered, session % 3 as disconnects, case when session % 6 = 2 then 4 else 0 end as decode_failures, session % 50 * 1000 as open_ms from m),
 i as (select session, unnest(list_filter([case when not has_health then 'capture_health_missing:warning' end, case when captions = 0 then 'no_captions:error' end, case when unavailable and not recovered then 'rtc_unavailable:error' end,
  case when unavailable and recovered then 'rtc_recovered:warning' end, case when disconnects > 0 then 'rtc_disconnects:warning' end, case when decode_failures > 0 then 'decode_failures:warning' end, case when open_ms > 30000 then 'slow_rtc_start:warning' end,
  case when unknown_ratio > 0.35 then 'unknown_speakers_high:error' end, case when unknown_ratio > 0.15 and unknown_ratio <= 0.35 then 'unknown_speakers:warning' end], lambda x: x is not null)) as c from h)"""


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("session")
    return Q.capture_metrics(_entries(spark, sf_dir)).select("*", (s % 5 != 0).alias("has_health"), (s % 4 == 1).alias("unavailable"), (s % 8 == 1).alias("recovered"), (s % 3).alias("disconnects"), F.when(s % 6 == 2, 4).otherwise(0).alias("decode_failures"), (s % 50 * 1000).alias("open_ms"))


@query(f"""with {_METRICS}, {_HEALTH}, p as (select session, count(*) as n_issues, count(*) filter (split_part(c, ':', 2) = 'error') as n_errors from i group by 1)
select session, case when coalesce(n_errors, 0) > 0 then 'review' when coalesce(n_issues, 0) > 0 then 'medium' else 'high' end as status, coalesce(n_issues, 0) as n_issues, coalesce(n_errors, 0) as n_errors from m left join p using (session)""")
def capture_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _health(spark, sf_dir)
    return Q.report(h, Q.issues(h, Q.capture_rules()))


@query(f"""with {_METRICS}, {_HEALTH}, u as (select session, split_part(c, ':', 1) as code, split_part(c, ':', 2) as severity, 0 as source from i
 union all select doc_id as session, 'toxic' as code, 'error' as severity, 1 as source from labels where toxic = 1 union all select doc_id, 'low_quality', 'warning', 1 from labels where quality = 0 union all select doc_id, 'rtc_disconnects', 'warning', 1 from labels)
select session, code, severity, min(source) as source from u group by 1, 2, 3""")
def quality_issue_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture issues and label issues, each (session, code, severity) once."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("session"), "quality", "toxic")
    more = Q.issues(labels, [("toxic", "error", F.col("toxic") == 1), ("low_quality", "warning", F.col("quality") == 0), ("rtc_disconnects", "warning", F.lit(True))])
    return Q.union_issues([Q.issues(_health(spark, sf_dir), Q.capture_rules()), more])


@query("""with r as (select l_suppkey as session, avg((l_returnflag = 'R')::int::double) as u, 1 + (l_suppkey % 13 - 6) / 1000.0 as scale from lineitem group by 1)
select session, round(u, 6) as unknown_ratio, case when u > 0.35 then 'review' when u > 0.15 or abs(scale::double - 1) > 0.005 then 'medium' else 'high' end as status from r""")
def audio_quality_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("session")).agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("u"))
    return d.select("session", F.round("u", 6).alias("unknown_ratio"), Q.audio_status(F.col("u"), 1 + (F.col("session") % 13 - 6) / 1000.0).alias("status"))


@query("""with s as (select l_partkey || ':' || l_linenumber as dimension, count(distinct l_orderkey) as situations, bool_or(l_quantity >= 45 and l_returnflag = 'R') as strong from lineitem group by 1)
select dimension, situations, strong, case when situations = 0 then 'Low' when situations >= 3 and strong then 'High' else 'Medium' end as cap from s""")
def confidence_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Situations are orders, a strong observation a large return."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.concat_ws(":", "l_partkey", "l_linenumber").alias("dimension")).agg(F.countDistinct("l_orderkey").alias("situations"), F.bool_or((F.col("l_quantity") >= 45) & (F.col("l_returnflag") == "R")).alias("strong"))
    return d.withColumn("cap", Q.confidence_cap(F.col("situations"), F.col("strong")))


@query(f"""with {SIGNALS_SQL} select session, ms // 864000000 as span, array_to_string(list_sort(list(distinct kind)), ',') as kinds from signals group by 1, 2 having list_has_all(list(distinct kind), ['click', 'purchase', 'view'])""")
def situation_signal_superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-day spans of a user whose signals include all three asked for."""
    d = signals(spark, sf_dir).groupBy("session", F.floor(F.col("ms") / 864_000_000).cast("long").alias("span")).agg(F.collect_set("kind").alias("k"))
    need = F.array(F.lit("click"), F.lit("purchase"), F.lit("view"))
    return d.where(F.size(F.array_except(need, "k")) == 0).select("session", "span", F.array_join(F.array_sort("k"), ",").alias("kinds"))


@query(r"""with c as (select doc_id, source || case when doc_id % 50 = 0 then ' Daily sync' when doc_id % 50 = 1 then ' Sprint planning' else '' end as title, substr(text, 1, 80000) as t from documents)
select doc_id, case when regexp_matches(title, '(?i)\b(daily|stand[- ]?up)\b') then 'standup' when regexp_matches(title, '(?i)\b(sprint\s+planning|roadmap)\b') then 'planning'
 when len(regexp_extract_all(t, '(?i)\b(thing|nothing)\b')) >= 2 then 'echo' when len(regexp_extract_all(t, '(?i)released under')) >= 2 then 'licence' else 'general' end as meeting_type from c""")
def meeting_type_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = [("standup", r"daily|stand[- ]?up"), ("planning", r"sprint\s+planning|roadmap"), ("echo", "thing|nothing"), ("licence", "released under")]
    d = table(spark, sf_dir, "documents")
    title = F.concat("source", F.when(F.col("doc_id") % 50 == 0, " Daily sync").when(F.col("doc_id") % 50 == 1, " Sprint planning").otherwise(""))
    return d.select("doc_id", Q.meeting_type(title, F.col("text"), cues).alias("meeting_type"))


@query(f"""with {TURNS_SQL}, r as (select session, ord, text, speaker = 'user' as c, len(string_split(trim(regexp_replace(text, '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g')), ' ')) as w, row_number() over (partition by session order by ord desc) as k from turns),
 s as (select session, count(*) as lines, sum(w)::bigint as words, count(*) filter (c) as candidate_lines, coalesce(sum(w) filter (c), 0)::bigint as candidate_words,
  arg_min(text, ord) filter (regexp_matches(text, '(?i)ting')) as et, arg_min(c, ord) filter (regexp_matches(text, '(?i)ting')) as ec, min(ord) filter (regexp_matches(text, '(?i)ting')) as eo, min(ord) filter (k <= 3) as tail, count(*) filter (regexp_matches(text, '(?i)aner')) as can, count(*) filter (regexp_matches(text, '(?i)wh')) as tec from r group by 1)
select session, case when et is not null and ec and eo >= tail and (candidate_lines < 4 or candidate_words < 180) then 'early_terminated' when can > 0 and lines <= 20 then 'cancelled_no_show'
 when tec > 0 and words < 180 then 'technical_failure' when candidate_lines = 0 and lines >= 8 and words >= 180 then 'identity_unresolved' when candidate_lines < 2 or candidate_words < 40 then 'insufficient_content' else 'completed' end as outcome, lines, words, candidate_lines, candidate_words from s""")
def interview_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user is the candidate; syllables of the synthetic texts stand in for the cues."""
    t = turns(spark, sf_dir).withColumn("is_candidate", F.col("speaker") == "user")
    return Q.interview_outcome(t, "ting", "aner", "wh").select("session", "outcome", "lines", F.col("words").cast("long").alias("words"), "candidate_lines", F.col("candidate_words").cast("long").alias("candidate_words"))


@query("""select c_custkey, case c_custkey % 6 when 4 then false when 5 then false else true end as same from customer""")
def person_match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer numbers as surnames in several spellings; every third form is another person."""
    n = F.col("c_custkey").cast("string")
    forms = [(F.concat(F.lit("Євген К"), n), F.concat(F.lit("Yevhen K"), n)), (F.concat(F.lit("Юлія Шевченко"), n), F.concat(F.lit("Shevchenko"), n, F.lit(" Iuliia"))), (F.concat(F.lit("Anna "), n), F.concat(n, F.lit(" ANNA"))), (n, n), (F.concat(F.lit("Anna "), n), F.concat(F.lit("Anna 9"), n)), (n, F.concat(n, F.lit(" x")))]
    pick = lambda k: F.element_at(F.array(*(f[k] for f in forms)), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", Q.same_person(pick(0), pick(1)).alias("same"))


@query("""with p as (select p_partkey, p_brand || ' ' || p_type as spec, list_distinct(list_filter(string_split(upper(p_type), ' '), lambda x: list_contains(['STANDARD', 'SMALL', 'MEDIUM', 'LARGE', 'ECONOMY', 'PROMO', 'STEEL'], x))) as f, p_brand, p_type from part)
select p_partkey, case when len(f) = 1 then array_to_string(list_filter(string_split(spec, ' '), lambda x: upper(x) <> f[1]), ' ') else spec end as role, case when len(f) = 1 then f[1] else '' end as level from p""")
def target_role_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    role, level = Q.role_level(F.concat_ws(" ", "p_brand", "p_type"), ["STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO", "STEEL"])
    return table(spark, sf_dir, "part").select("p_partkey", role.alias("role"), level.alias("level"))


@query("""with known as (select o_orderkey from orders where o_orderkey % 3 <> 0) select l_orderkey as evidence_id, count(*) as citations from lineitem where l_orderkey not in (select o_orderkey from known) group by 1""")
def citation_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited ids that no ledger row has; a third of the ledger is missing by construction."""
    known = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(known, "l_orderkey", "left_anti").groupBy(F.col("l_orderkey").alias("evidence_id")).agg(F.count(F.lit(1)).alias("citations"))


@query("""select o_orderkey as report, unnest(list_filter([case when o_totalprice > 400000 then 'score_out_of_range' end, case when o_orderstatus not in ('F', 'O') then 'unknown_verdict' end, case when o_orderpriority like '5%' and o_orderstatus = 'O' then 'low_confidence_hire' end,
 case when o_orderdate >= timestamp '1998-01-01' then 'late_report' end, case when length(trim(o_orderpriority)) < 6 then 'missing_section' end], lambda x: x is not null)) as code from orders""")
def report_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over reports, one row for each that is broken, in one pass."""
    c = F.col
    rules = [("score_out_of_range", "error", c("o_totalprice") > 400_000), ("unknown_verdict", "error", ~c("o_orderstatus").isin("F", "O")), ("low_confidence_hire", "error", c("o_orderpriority").startswith("5") & (c("o_orderstatus") == "O")),
             ("late_report", "warning", c("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")), ("missing_section", "error", F.length(F.trim("o_orderpriority")) < 6)]
    return Q.issues(table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "report"), rules, ["report"]).select("report", "code")
