"""Candidate reports and interview evidence, written from the tables so that what is wrong with each is known to the SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grounding, reports
from ..sources import evidence
from ..sources.tables import table
from .registry import query

LEVELS = ("Junior", "Senior")
#: By number modulo their count: target, recommendation, fit.
TARGETS = ("Backend Senior", "Senior", "Backend", "Backend Junior/Senior", "Backend mid")
CHOICES = ("Наймати", "Не наймати.", "Скоріше наймати — так", "Не застосовується", "Продовжити", "скоріше не наймати", "Недостатньо даних")
FITS = ("Відповідає", "Не застосовується", "Не відповідає", "Нижче")


def _pick(values: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


def _sql_pick(values: tuple[str, ...], k: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], ({k}) % {len(values)} + 1)"


def _report(parts: dict[str, Column | str], body: Column | str = "") -> Column:
    line = lambda label, v: F.concat(F.lit(f"**{label}:** "), F.lit(v) if isinstance(v, str) else v, F.lit("\n"))
    return F.concat(*(F.coalesce(line(label, v), F.lit("")) for label, v in parts.items()), F.lit("\n"), F.lit(body) if isinstance(body, str) else body)


def _plain() -> dict[str, Column | str]:
    return {label: "є" for label in reports.FIELDS} | {reports.STATUS: "Попередній", reports.STAGE: "Технічний", reports.ROLE: "Backend", reports.LEVEL: "Senior", reports.FIT: "Відповідає", reports.FINAL: "Не застосовується", reports.CRITICAL: "Так"}


@query(f"""with k as (select c_custkey as k, {_sql_pick(TARGETS, 'c_custkey')} as target, {_sql_pick(CHOICES, 'c_custkey // 5')} as choice, {_sql_pick(FITS, 'c_custkey // 35')} as fit,
  c_custkey % 3 = 0 as final_meeting, c_custkey % 4 = 0 as says_final_stage, c_custkey % 6 = 0 as final_status, c_custkey % 2 = 0 as verified, c_custkey % 13 = 0 as no_role, c_custkey % 17 = 0 as no_level from customer),
f as (select *, target <> 'Senior' as role, target in ('Backend Senior', 'Senior', 'Backend mid') as level, choice in ('Наймати', 'Не наймати.', 'Скоріше наймати — так', 'скоріше не наймати') as decides from k),
all_codes as (select k as report_id, unnest(case when k % 11 = 0 then ['missing_field'] else [
  case when says_final_stage <> final_meeting then 'stage_mismatch' end, case when final_status and not final_meeting then 'final_status_early' end, case when decides and not final_meeting then 'final_recommendation_early' end,
  case when decides and not final_status then 'final_with_preliminary_status' end, case when decides and not level then 'final_without_level' end, case when decides and not role then 'final_without_role' end, case when decides and not verified then 'final_unverified' end,
  case when choice in ('Наймати', 'Скоріше наймати — так') and fit not in ('Відповідає', 'Не відповідає') then 'hire_against_fit' end, case when not (role and level) and fit <> 'Не застосовується' then 'fit_without_target' end,
  case when role and level and fit = 'Не застосовується' then 'fit_missing' end, case when role and no_role then 'role_lost' end, case when level and no_level then 'level_lost' end, case when not level and not no_level then 'level_invented' end] end) as code from f)
select report_id, code, case when code = 'missing_field' then 'Цільова роль' else '' end as subject from all_codes where code is not null""")
def report_decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports whose stage, decision and target contradict each other or the meeting."""
    k = F.col("c_custkey")
    every = lambda n: k % n == 0
    parts = _plain() | {
        reports.STATUS: F.when(every(6), "Фінальний").otherwise("Попередній"), reports.STAGE: F.when(every(4), "Final").otherwise("Технічний"), reports.ROLE: F.when(every(11), None).when(every(13), "не задано").otherwise("Backend"),
        reports.LEVEL: F.when(every(17), "—").otherwise("Senior"), reports.FIT: _pick(FITS, F.floor(k / 35)), reports.FINAL: _pick(CHOICES, F.floor(k / 5)), reports.CRITICAL: F.when(every(2), "Так").otherwise("Ні"),
    }
    d = table(spark, sf_dir, "customer").select(k.alias("report_id"), _report(parts).alias("report"), F.col("c_name").alias("candidate"), _pick(TARGETS, k).alias("target"), F.when(every(3), "Фінальна співбесіда").otherwise("screening").alias("stage"))
    return reports.broken_rules(d, LEVELS).select("report_id", "code", "subject")


_WORDS_SQL = r"docs as (select doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')), ' '), lambda x: x <> '') as w, text from documents)"


@query(f"""with {_WORDS_SQL}, q as (select doc_id, case doc_id % 3 when 1 then array_to_string(list_reverse(w[1:5]), ' ') else array_to_string(w[1:5], ' ') end as quote, array_to_string(w[1:9], ' ') as kept, ' ' || array_to_string(w, ' ') || ' ' as said from docs where len(w) >= 1),
codes as (select doc_id, quote, kept, said, unnest([case when doc_id % 5 <> 0 and (doc_id % 3 = 2 or not contains(kept, quote)) then 'quote_not_in_evidence' end, case when doc_id % 7 <> 0 and not contains(trim(said), quote) then 'quote_not_in_transcript' end]) as code from q)
select doc_id as report_id, code, case doc_id % 3 when 2 then '2.1' else '1.1' end as subject from codes where code is not null""")
def report_citation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of reports held against evidence and transcript: as said, turned round, or under an id that isn't there; some reports lack one or the other."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.filter(F.split(evidence.quote_key(F.col("text")), " "), lambda x: x != "").alias("w")).where(F.size("w") >= 1)
    first = F.slice("w", 1, 5)
    said = F.when(F.col("doc_id") % 3 == 1, F.array_join(F.reverse(first), " ")).otherwise(F.array_join(first, " "))
    cite = F.concat(F.lit("> [E"), F.when(F.col("doc_id") % 3 == 2, "2.1").otherwise("1.1"), F.lit("] «"), said, F.lit("»\n"))
    ledger = F.concat(F.lit("[E1.1] speaker=candidate | type=claim | situation=a | timestamp=00:01 | dimensions=motivation | signals=x\n«"), F.array_join(F.slice("w", 1, 9), " "), F.lit("»\n"))
    d = d.select(F.col("doc_id").alias("report_id"), _report(_plain(), cite).alias("report"), F.lit("Backend Senior").alias("target"), F.when(F.col("doc_id") % 5 != 0, ledger).alias("evidence"), F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("transcript"))
    return reports.broken_rules(d, LEVELS).select("report_id", "code", "subject")


@query("""with p as (select p_partkey as k, p_partkey % 5 + 1 as score, p_partkey % 3 = 0 as high, p_partkey % 4 as cited, p_partkey % 7 = 0 as no_time, p_partkey % 11 as situations from part),
codes as (select k, unnest([case when no_time then 'score_without_time' end, case when cited = 0 then 'score_without_id' end, case when cited = 3 then 'unknown_id' end,
  case when high and not (cited in (1, 2) and situations < 4 and cited = 2) then 'confidence_too_high' end, case when score >= 3 and ((cited = 1) or (cited = 2 and situations < 4)) then 'reflection_chain' end]) as code from p)
select k as report_id, code, case when code = 'reflection_chain' then '' else 'Рефлексія' end as subject from codes where code is not null""")
def report_dimension_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored dimension whose section cites no record, one, three, or an unknown one, of one situation or several."""
    k = F.col("p_partkey")
    several = k % 11 < 4
    names = ("own_mistake", "lesson", "behavior_change")
    record = lambda i: F.concat(F.lit(f"[E1.{i + 1}] speaker=candidate | type={'candidate_live' if i == 1 else 'claim'} | situation="), F.when(several, f"s{i}").otherwise("one"), F.lit(f" | timestamp=00:0{i} | dimensions=reflection | signals=x, {names[i]}\nсказано {i}\n"))
    cited = _pick(("", "[E1.1]", "[E1.1] [E1.2], [E1.3]", "[E9.9]"), k)
    high = F.when(k % 3 == 0, "Висока").otherwise("Середня")
    body = F.concat(F.lit("| Рефлексія | "), (k % 5 + 1).cast("string"), F.lit(" | "), high, F.lit(" |\n\n### 4. Рефлексія — "), F.when(k % 7 == 0, "без часу").otherwise("о 01:15"), F.lit("\n"), cited, F.lit("\n"))
    d = table(spark, sf_dir, "part").select(k.alias("report_id"), _report(_plain(), body).alias("report"), F.lit("Backend Senior").alias("target"), F.concat(*map(record, range(3))).alias("evidence"))
    return reports.broken_rules(d, LEVELS).select("report_id", "code", "subject")


@query("""select o_orderkey as report_id, case o_orderkey % 6
 when 0 then array_to_string(list_transform(range(o_orderkey % 50, o_orderkey % 50 + o_orderkey % 9 + 1), lambda x: '[E1.' || x || ']'), ', ')
 when 1 then '[E1.' || o_orderkey % 50 || '], [E2.' || o_orderkey % 9 || ']' when 2 then '[E1.' || o_orderkey || '77]' when 3 then '[E1.' || o_orderkey || '], [E2.5]'
 when 4 then 'Eabc, [E3.' || o_orderkey || ']' else '[E1.1], [E4.' || o_orderkey || '], [E5.2]' end as report from orders""")
def report_id_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence ids as ranges, groups and broken brackets, one form for every sixth order."""
    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    low, more = k % 50, k % 9
    t = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    forms = [t("[E1.", low, "-E1.", low + more, "]"), t("[E1.", low, "-E2.", more, "]"), t("[E1.", s, "]77]"), t("[E1.", s, ", [E2.5]"), t("[Eabc], E3.", s), t("[E1.1,E4.", s, " , E5.2]")]
    return table(spark, sf_dir, "orders").select(k.alias("report_id"), reports.normal_ids(F.element_at(F.array(*forms), (k % 6 + 1).cast("int"))).alias("report"))


@query(r"""with l as (select doc_id, i - 1 as i, trim(regexp_replace(lower(string_split(text, chr(10))[i]), '[^\p{L}\p{N}_]+', ' ', 'g')) as k from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)),
w as (select doc_id, i, k, string_split(k, ' ') as w from l), p as (select * from w where len(w) >= 8),
e as (select doc_id, i, k, w, case (doc_id + i) % 4 when 0 then w[2] || ' ' || w[3] when 1 then w[2] || ' ' || w[3] when 2 then w[7] || ' ' || w[8] else w[2] end as a, case (doc_id + i) % 4 when 0 then '' when 1 then w[7] || ' ' || w[8] when 2 then w[2] || ' ' || w[3] else w[3] end as b from p),
s as (select doc_id, array_to_string(list(k order by i), ' ') as said from l where k <> '' group by 1),
g as (select e.*, a || case when b = '' then '' else ' ' || b end as whole, said, strpos(k, a) as p0 from e join s using (doc_id)),
h as (select *, case when b = '' then 0 else strpos(substr(k, p0 + length(a)), b) end as next from g),
x as (select *, case when contains(said, whole) then a || case when b = '' then '' else ' ... ' || b end when p0 > 0 and next > 0 then trim(substr(k, p0, length(a) + next - 1 + length(b))) end as found from h)
select doc_id as session, i as ord, case when contains(said, whole) then found when length(found) > 700 then case when len(string_split(a, ' ')) >= 3 then a end when len(string_split(found, ' ')) >= 3 then found end as exact from x""")
def evidence_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with words left out, in order, turned round, or in one piece, of every line of eight words and more; each must be found in its own line."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session"), F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("timestamp", F.col("line").cast("string"))
    w = F.split(evidence.quote_key(F.col("text")), " ")
    d = d.withColumn("w", w)
    two = lambda a, b: F.concat_ws(" ", F.get("w", F.lit(a)), F.get("w", F.lit(b)))
    form = (F.col("session") + F.col("line")) % 4
    quote = F.when(form == 0, two(1, 2)).when(form == 1, F.concat(two(1, 2), F.lit(" ... "), two(6, 7))).when(form == 2, F.concat(two(6, 7), F.lit(" ... "), two(1, 2))).otherwise(F.concat(F.get("w", F.lit(1)), F.lit(" ... "), F.get("w", F.lit(2))))
    records = d.where(F.size("w") >= 8).select("session", F.col("line").alias("ord"), "timestamp", quote.alias("quote"))
    return grounding.ground(records, d.drop("w")).select("session", "ord", "exact")
