"""Summaries, report files, titles, devices and small text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import bound
from ..operators import clean, identity, summaries, tasks
from ..operators import ledger as L
from ..sources.tables import TURNS_SQL, table, turns
from .ledger import ITEMS_SQL, NORM, _items
from .registry import query


@query(f"""with {ITEMS_SQL}, i as (select session, item_id, type, case when type in ('commitment', 'open_question') and status = 'active' then 'open' else status end as status, claim, deadline, owners, case source_order when 0 then 1000000000 else source_order end as o,
  type in ('fact', 'proposal') and item_id % 2 = 0 as thematic, type = 'proposal' and item_id % 9 = 0 as conditional, {NORM.format("claim")} as key from items),
l as (select session, o, item_id, 0 as nth, key, 'theses' as section, case type when 'proposal' then 'Пропозиція: ' else '' end || claim as t from i where thematic
 union all select session, o, item_id, 1, key, 'decisions', claim from i where type = 'decision' and status = 'active'
 union all select session, o, item_id, 2, key, 'actions', '[' || case when len(owners) > 0 then array_to_string(owners, ' / ') else 'Власник не визначений' end || '] ' || claim || case when deadline <> '' then ' — дедлайн: ' || deadline else '' end from i where type = 'commitment' and status = 'open'
 union all select session, o, item_id, 3, key, 'questions', claim from i where type = 'open_question' and status = 'open' union all select session, o, item_id, 4, key, 'questions', 'Чи підтвердиться після перевірки: ' || claim || '?' from i where conditional),
f as (select *, row_number() over (partition by session, section, key order by o, item_id, nth) as k from l), g as (select session, section, list(t order by o, item_id, nth) as ts from f where k = 1 group by 1, 2),
th as (select session, key, claim, row_number() over (partition by session order by o, item_id) - 1 as pos, count(*) over (partition by session) as n from i where thematic),
tp as (select session, key, claim, pos from th where pos = 0 or (n > 2 and pos = n // 2) or (n > 1 and pos = n - 1)), tf as (select *, row_number() over (partition by session, key order by pos) as k from tp), tt as (select session, array_to_string(list(claim order by pos), '; ') as topics from tf where k = 1 group by 1),
p as (select s.session, d.ts as d, a.ts as a, h.ts as h, q.ts as q, tt.topics from (select distinct session from items) s left join g d on d.session = s.session and d.section = 'decisions' left join g a on a.session = s.session and a.section = 'actions'
  left join g h on h.session = s.session and h.section = 'theses' left join g q on q.session = s.session and q.section = 'questions' left join tt on tt.session = s.session)
select session, 'На зустрічі обговорили: ' || coalesce(topics, array_to_string(coalesce(d, a)[1:3], '; '), 'зміст зустрічі') || '. ' || case when d is not null then 'Явні рішення: ' || array_to_string(d[1:3], '; ') || '.' else 'Явних рішень не зафіксовано.' end
  || case when a is not null then ' Наступні кроки: ' || array_to_string(list_transform(a[1:2], lambda x: regexp_replace(x, '^\\[[^\\]]+\\]\\s+', '')), '; ') || '.' else '' end as tldr,
 coalesce('- ' || array_to_string(h, chr(10) || '- '), '- —') as theses, coalesce('- ' || array_to_string(d, chr(10) || '- '), '- —') as decisions, coalesce('- ' || array_to_string(a, chr(10) || '- '), '- —') as actions, coalesce('- ' || array_to_string(q, chr(10) || '- '), '- —') as questions from p""")
def summary_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five sections of a summary from a customer's items, the first one in whole sentences."""
    c = F.col
    d = _items(spark, sf_dir).withColumn("status", F.when(c("type").isin("commitment", "open_question") & (c("status") == "active"), "open").otherwise(c("status")))
    d = d.withColumn("thematic", c("type").isin("fact", "proposal") & (c("item_id") % 2 == 0)).withColumn("lifecycle_reason", F.when((c("type") == "proposal") & (c("item_id") % 9 == 0), "conditional_decision"))
    return summaries.grounded_sections(d)


@query("""select o_orderkey as k, o_orderkey % 6 in (0, 1, 2) as valid from orders""")
def summary_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries that are whole, whole with a heading of their type, or lack a heading, have one too many, no action line, or one without owner."""
    k, h = F.col("o_orderkey"), list(summaries.HEADINGS)
    text = lambda heads, action: "\n".join(f"{x}\n{action if x == summaries.ACTIONS else 'зміст'}\n" for x in heads)
    good = "- [Olha] зробити\n\n- —"
    forms = [text(h, good), text([*h, "## Відповіді"], good), text(h, "- —"), text(h[:-1], good), text([*h, "## Зайве"], good), text(h, "- зробити без власника")]
    extra = F.when(k % 6 == 1, "## Відповіді")
    return table(spark, sf_dir, "orders").select(k.alias("k"), summaries.valid_summary(F.element_at(F.array(*map(F.lit, forms)), (k % 6 + 1).cast("int")), extra).alias("valid"))


@query("""with o as (select 'customer-' || o_custkey || '.md' as file, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as nth from orders), a as (select * from o where nth = 1), b as (select * from o where nth = 2),
old as (select file, '<!-- evaluation-id: ' || o_orderkey || ' -->' || chr(10) || 'old ' || o_orderkey || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '<!-- evaluation-id: x -->' || chr(10) || 'tail' || chr(10) as text, o_orderkey as id from a where o_orderkey % 3 <> 0),
new as (select b.file, case when b.o_orderkey % 2 = 0 then a.o_orderkey else b.o_orderkey end as id, b.o_orderkey % 4 = 0 as repl, 'new ' || b.o_orderkey as report from b join a using (file))
select coalesce(o.file, n.file) as file, case when n.file is null then o.text when o.file is null then '<!-- evaluation-id: ' || n.id || ' -->' || chr(10) || report || chr(10) when n.id <> o.id then rtrim(o.text, chr(10)) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '<!-- evaluation-id: ' || n.id || ' -->' || chr(10) || report || chr(10)
 when repl then replace(o.text, 'old ' || o.id, report) else o.text end as text from old o full join new n on o.file = n.file""")
def report_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report files by customer: a second report is appended, replaces the one of its marker, or leaves it."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("customer-"), "o_custkey", F.lit(".md")).alias("file"), F.col("o_orderkey").alias("k"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("nth"))
    a, b = o.where("nth = 1").select("file", F.col("k").alias("first")), o.where("nth = 2").select("file", "k")
    s = lambda c: F.col(c).cast("string")
    files = a.where("first % 3 <> 0").select("file", F.concat(summaries.marker(s("first")), F.lit("\nold "), s("first"), F.lit("\n\n---\n\n"), summaries.marker(F.lit("x")), F.lit("\ntail\n")).alias("text"))
    new = b.join(a, "file").select("file", F.when(F.col("k") % 2 == 0, s("first")).otherwise(s("k")).alias("evaluation"), F.concat(F.lit(" new "), s("k"), F.lit("\n")).alias("report"), (F.col("k") % 4 == 0).alias("replace"))
    return summaries.upsert_reports(files, new)


@query("""with e as (select user_id as session, event_id as id, ts as t0, 's/' || event_id % 5 || '/d' || event_id % 3 as dev, 'd' || event_id % 3 as tail from events where event_type in ('click', 'view')),
n as (select user_id as session, ts as t0, 's/' || event_id % 5 || '/d' || event_id % 3 as dev, 'd' || event_id % 3 as tail, 'Name ' || event_id % 4 as name from events where event_type not in ('click', 'view') and event_id % 11 <> 0),
j as (select e.session, e.id, any_value(e.tail) as tail, arg_max(n.name, (n.t0, n.dev, n.name)) filter (n.t0 > e.t0) as later, arg_max(n.name, (n.t0, n.dev, n.name)) filter (n.t0 <= e.t0 and n.dev = e.dev) as own, arg_max(n.name, (n.t0, n.dev, n.name)) filter (n.t0 <= e.t0) as part
  from e left join n on n.session = e.session and n.tail = e.tail group by 1, 2) select session, id, coalesce(later, own, part, 'Учасник ' || tail) as speaker from j""")
def device_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of events as captions by device, the others as names of devices, some of which say nothing."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("ts").alias("at"), F.concat(F.lit("s/"), F.col("event_id") % 5, F.lit("/d"), F.col("event_id") % 3).alias("device"))
    said = F.col("kind").isin("click", "view")
    names = e.where(~said).withColumn("name", F.when(F.col("id") % 11 == 0, " ").otherwise(F.concat(F.lit("Name "), F.col("id") % 4)))
    return identity.with_device_names(e.where(said).withColumn("device", F.concat(F.lit("@"), "device")), names).select("session", "id", "speaker")


@query("""select o_orderkey as k, case o_orderkey % 4 when 3 then '—' else strftime(o_orderdate, '%Y-%m-%d') end as day, case o_orderkey % 4 when 0 then lpad((o_orderkey % 24)::varchar, 2, '0') || ':' || lpad((o_orderkey % 60)::varchar, 2, '0') || ':07' when 1 then lpad((o_orderkey % 24)::varchar, 2, '0') || ':' || lpad((o_orderkey % 60)::varchar, 2, '0')
 when 2 then lpad((o_orderkey % 24)::varchar, 2, '0') || ':' || lpad((o_orderkey % 60)::varchar, 2, '0') || ':09' else '—' end as clock from orders""")
def session_date_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date and time in session names, with dashes, without, without seconds, or not at all."""
    k = F.col("o_orderkey")
    day, h, m = F.date_format("o_orderdate", "yyyy-MM-dd"), F.lpad((k % 24).cast("string"), 2, "0"), F.lpad((k % 60).cast("string"), 2, "0")
    forms = [F.concat(day, F.lit("_"), h, F.lit("-"), m, F.lit("-07_meet-x")), F.concat(day, F.lit("_"), h, m), F.concat(day, F.lit("_"), h, m, F.lit("09_sys")), F.concat(F.lit("meet-"), day)]
    session = F.element_at(F.array(*forms), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), identity.session_date(session).alias("day"), identity.session_time(session).alias("clock"))


@query("""select c_custkey as k, case when c_custkey % 5 = 4 then '' else 'Customer ' || c_custkey end as candidate, case when c_custkey % 5 in (2, 3) then 'Data ' || c_mktsegment else '' end as target,
 case c_custkey % 5 when 3 then 'Round ' || c_custkey when 2 then 'Technical' when 1 then 'Final' when 0 then 'Невідомий' else 'Hiring Manager' end as stage from customer""")
def title_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate, target and stage of titles with two to four fields; the last kind is no interview."""
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    who, what = F.concat(F.lit(" «Customer "), s, F.lit("» ")), F.concat(F.lit("  Data   "), "c_mktsegment", F.lit(" "))
    forms = [F.concat(F.lit("Interview |"), who), F.concat(F.lit("Final interview|"), who), F.concat(F.lit("Technical interview |"), who, F.lit("|"), what), F.concat(F.lit("Interview|"), who, F.lit("|"), what, F.lit("| Round "), s), F.concat(F.lit("Sync with the hiring manager | "), who)]
    title = F.element_at(F.array(*forms), (k % 5 + 1).cast("int"))
    fields = identity.title_fields(title, F.lower(title).rlike("interview"))
    return table(spark, sf_dir, "customer").select(k.alias("k"), *(c.alias(n) for n, c in fields.items()))


@query("""with o as (select o_orderkey as k, o_orderdate + interval 10 years as d, (o_orderkey % 31 + 1) as a, (o_orderkey % 31 + 2) as b from orders), w as (select *, strftime(d, '%Y-%m-') as m, last_day(d)::date as eom from o),
x as (select *, case when b <= day(eom) then dayname((m || lpad(a::varchar, 2, '0'))::date) end as da, case when b <= day(eom) then dayname((m || lpad(b::varchar, 2, '0'))::date) end as db from w)
select k, case when b > day(eom) then '' when k % 3 = 2 then '' when (k % 3 = 0 and list_sort([da, db]) = list_sort(['Monday', 'Tuesday'])) then 'Meet on ' || a || ' та ' || b || ' числа (Monday, Tuesday)' when k % 3 = 0 then 'Meet on ' || a || ' та ' || b || ' числа'
 else 'Meet on ' || a || ' та ' || b || ' числа then' end as claim from x where not (k % 3 = 2 and list_sort([da, db]) = list_sort(['Monday', 'Tuesday'])) or b > day(eom)""")
def weekday_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days of the month with weekdays in an aside (right or wrong), with one weekday in an aside, or with both in the sentence itself."""
    k = F.col("o_orderkey")
    a, b = k % 31 + 1, k % 31 + 2
    days = F.concat(F.lit("Meet on "), a.cast("string"), F.lit(" та "), b.cast("string"), F.lit(" числа"))
    forms = [F.concat(days, F.lit(" (Monday, Tuesday)")), F.concat(days, F.lit(" (on Monday) then")), F.concat(days, F.lit(", Monday and Tuesday"))]
    claim = F.element_at(F.array(*forms), (k % 3 + 1).cast("int"))
    made = L.consistent_weekdays(claim, F.concat(F.lit("Запис від "), F.date_format(F.add_months("o_orderdate", 120), "yyyy-MM-dd")))
    # The sentence that is right keeps its weekdays; the SQL leaves these rows out. A filter would work the claims out once more.
    kept = bound(made, lambda c: F.when((k % 3 != 2) | (c != claim), F.array(c)).otherwise(F.array().cast("array<string>")))
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.explode(kept).alias("claim"))


@query("""select p_partkey as k, p_partkey % 700 >= 300 and (p_partkey % 700)::double / (p_partkey % 700 + p_partkey % 900) >= 0.45 as ukrainian from part""")
def report_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of so many Cyrillic and Latin letters; quoted lines don't count."""
    k = F.col("p_partkey").cast("int")
    text = F.concat(F.expr("repeat('ї', cast(p_partkey % 700 as int))"), F.lit(" 12\n> quoted "), F.expr("repeat('цитата ', 90)"), F.lit("\n"), F.expr("repeat('q', cast(p_partkey % 900 as int))"))
    return table(spark, sf_dir, "part").select(k.cast("long").alias("k"), clean.in_ukrainian(text).alias("ukrainian"))


@query(f"""with {TURNS_SQL}, t as (select session // 10 as session, session * 1000 + ord as ord, speaker, kind, substr(text, 1, ord % 4) as text from turns), n as (select *, row_number() over (partition by session, speaker, lower(text) order by ord) as nth from t where length(text) >= 2)
select session, ord, kind, text from n where kind <> 'chat' or nth = 1""")
def chat_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short beginnings of turns, ten conversations to a session: chat messages repeat, whatever their case."""
    t = turns(spark, sf_dir).select(F.floor(F.col("session") / 10).alias("session"), (F.col("session") * 1000 + F.col("ord")).alias("ord"), "speaker", "kind", F.substr("text", F.lit(1), (F.col("ord") % 4).cast("int")).alias("text"))
    return clean.compact_chats(t).select("session", "ord", "kind", "text")


@query("""select o_orderkey as k from orders where o_custkey % 3 = 1 and o_orderkey % 4 <> 0 and o_orderkey % 5 <> 0 and o_orderkey % 2 = 0""")
def trash_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of one note that were posted, are not in the trash yet, and aren't the owner's."""
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("note-"), F.col("o_custkey") % 3).alias("note"), F.when(k % 4 != 0, F.concat(F.lit("page"), k)).alias("page_id"), F.when(k % 5 == 0, F.lit("2024-01-01")).alias("trashed_at"), F.when(k % 2 == 0, "**Bob**, Annette").otherwise("Bob / Ann").alias("involved"))
    return tasks.to_trash(d, "note-1", ["Ann"]).select("k")
