"""Search queries over conversation turns and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import folded, normalized, word_tokens
from ..operators import search as S
from ..operators.index import SearchIndex
from ..operators.snippets import snippet
from ..sources.tables import MEETINGS_SQL, TURNS_SQL, meetings, shared_path, table, turns
from .registry import query

#: Roles stand in for item kinds.
BOOSTS = {"assistant": -0.4, "system": -0.2}


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return t.select(F.concat_ws(":", "session", "ord").alias("chunk_id"), "session", F.col("ord").alias("ordinal"), F.col("speaker").alias("kind"), "speaker", "text", F.lit(None).cast("string").alias("owners"), F.col("kind").alias("status"))


def _bm25_sql(terms: list[str], where: str = "true", limit: int = 20) -> str:
    hit = lambda t: f"starts_with(token, '{t}')" if len(t) >= 4 else f"token = '{t}'"
    each = " union all ".join(f"select chunk_id, w, {i} as term from toks where {hit(t)}" for i, t in enumerate(terms))
    return f"""with {TURNS_SQL}, {MEETINGS_SQL},
  chunks as (select session || ':' || ord as chunk_id, session, ord as ordinal, speaker, text, kind as status from turns),
  toks as (select chunk_id, 1.0::double as w, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as token from chunks
     union all select chunk_id, 0.7::double, unnest(regexp_extract_all(lower(speaker), '[\\p{{L}}\\p{{N}}]+')) from chunks),
  lens as (select c.chunk_id, count(t.token) as n_tokens from chunks c left join toks t using (chunk_id) group by 1),
  corpus as (select count(*) as n_all, avg(n_tokens) as a from lens),
  hits as (select chunk_id, term, sum(w) as f from ({each}) group by 1, 2),
  idf as (select term, greatest(ln((n_all - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) as idf from hits, corpus group by term, n_all),
  per_chunk as (select chunk_id, count(*) as matched, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_tokens / a))) as s from hits join idf using (term) join lens using (chunk_id), corpus group by 1),
  met as (select c.session, c.ordinal, c.speaker, m.meeting_date, k.matched, round(s + case c.speaker when 'assistant' then -0.4 when 'system' then -0.2 else 0 end, 6) as score
     from per_chunk k join chunks c using (chunk_id) join meetings m using (session) where {where})
select * from met where matched >= case when (select max(matched) from met) = {len(terms)} then {len(terms)} else 1 end order by score, meeting_date desc, session, ordinal limit {limit}"""


def _found(d: DataFrame) -> DataFrame:
    return d.select("session", "ordinal", "speaker", "meeting_date", "matched", "score")


@query(_bm25_sql(["that", "with"]))
def search_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(S.search(_chunks(spark, sf_dir), meetings(spark, sf_dir), "that with", ("text", "speaker"), boosts=BOOSTS))


@query(_bm25_sql(["from", "zzzz"]))
def search_and_or_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No turn has both terms, so any term counts."""
    return _found(S.search(_chunks(spark, sf_dir), meetings(spark, sf_dir), "the from zzzz", ("text", "speaker"), boosts=BOOSTS, stop_words=["the"]))


@query(_bm25_sql(["ther"], "c.speaker in ('user', 'assistant') and list_contains(m.participants, 'user') and m.meeting_date >= '2024-01-05' and status = 'caption'", 50))
def search_bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(S.search(_chunks(spark, sf_dir), meetings(spark, sf_dir), "ther", ("text", "speaker"), limit=50, boosts=BOOSTS, kinds=["user", "assistant"], participants=["User"], date_from="2024-01-05", status="caption"))


@query(_bm25_sql(["that", "user"], "c.speaker in ('assistant', 'system')", 50))
def search_filtered_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the user have both terms, but the kinds leave them out: any term counts among the rest."""
    return _found(S.search(_chunks(spark, sf_dir), meetings(spark, sf_dir), "what about that user", ("text", "speaker"), limit=50, boosts=BOOSTS, kinds=["assistant", "system"]))


@query(f"""with {TURNS_SQL}, {MEETINGS_SQL} select session, ord as ordinal, speaker, meeting_date from turns join meetings using (session)
where speaker in ('user', 'assistant') and meeting_date between '2024-01-02' and '2024-03-01' and list_contains(participants, 'user') order by meeting_date desc, session, ordinal limit 100""")
def search_browse_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.search(_chunks(spark, sf_dir), meetings(spark, sf_dir), "", limit=100, kinds=["user", "assistant"], participants=["user"], date_from="2024-01-02", date_to="2024-03-01")
    return d.select("session", "ordinal", "speaker", "meeting_date")


@query(f"with {TURNS_SQL}, {MEETINGS_SQL} select speaker as kind, count(*) as n, count(distinct session) as sessions, min(meeting_date) as first_date from turns join meetings using (session) group by 1")
def search_kind_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _chunks(spark, sf_dir).join(meetings(spark, sf_dir), "session")
    return d.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("sessions"), F.min("meeting_date").alias("first_date"))


@query("select doc_id, case when length(text) > 240 then substr(text, 1, 237) || '…' else text end as snippet from documents")
def search_snippet_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.browse_snippet(F.col("text")).alias("snippet"))


@query("""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as token from documents)
select token, count(distinct doc_id) as df, count(*) as tf from t group by 1""")
def index_stats_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.document_frequencies(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "text")


@query("""select avg(n)::double as avg_tokens, max(n) as most_tokens, sum(n)::bigint as tokens, count(*) as chunks from
(select len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) + len(regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+')) as n from documents)""")
def index_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("speaker"))
    n = (F.size(word_tokens(F.col("text"))) + F.size(word_tokens(F.col("speaker")))).cast("long")
    return d.select(n.alias("n")).agg(F.avg("n").alias("avg_tokens"), F.max("n").alias("most_tokens"), F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("chunks"))


@query("""with old as (select doc_id, sha256(text) as h from documents where doc_id % 2 = 0), new as (select doc_id, case when doc_id % 10 = 4 then sha256(text || '!') else sha256(text) end as h from documents where doc_id % 8 <> 0)
select coalesce(o.doc_id, n.doc_id) as session, case when n.doc_id is null then 'removed' when o.h = n.h then 'unchanged' else 'indexed' end as change from old o full join new n on o.doc_id = n.doc_id""")
def index_incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the even documents meets a corpus that lost every eighth and changed some: both states are part of the case."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session"), "text")
    old = d.where("session % 2 = 0").select("session", F.sha2("text", 256).alias("content_hash"))
    new = d.where("session % 8 <> 0").select("session", F.when(F.col("session") % 10 == 4, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("content_hash"))
    return S.index_diff(old, new)


@query("""select conv_id as session, count(*) as turns from conversations where conv_id in (select conv_id from conversations where contains(lower(role), 'sys'))
and conv_id in (select conv_id from conversations where contains(lower(role), 'user')) group by 1""")
def participants_semi_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in which every requested participant is present, as semi joins on the bridge table."""
    c = table(spark, sf_dir, "conversations")
    bridge = c.select(F.col("conv_id").alias("session"), normalized(F.col("role")).alias("name")).distinct()
    out = c.select(F.col("conv_id").alias("session"))
    for name in ("sys", "user"):
        out = out.join(bridge.where(F.contains("name", F.lit(name))), "session", "left_semi")
    return out.groupBy("session").agg(F.count(F.lit(1)).alias("turns"))


def _snippet_sql(chunks: str, terms: list[str]) -> str:
    """CTEs after `chunks` (chunk_id, text): snips (chunk_id, snippet) of chunks with a term; terms of four letters and more."""
    wanted = ", ".join(f"('{t}')" for t in terms)
    return f"""{chunks},
  cut_up as (select chunk_id, regexp_extract_all(text, '([\\p{{L}}\\p{{N}}]+)', 1) as tk, regexp_extract_all(text, '([^\\p{{L}}\\p{{N}}]*)[\\p{{L}}\\p{{N}}]+', 1) as gp, regexp_extract(text, '([^\\p{{L}}\\p{{N}}]*)$', 1) as tail from chunks),
  flat as (select chunk_id, unnest(tk) as token, unnest(gp) as gap, unnest(range(len(tk))) as i, len(tk) as n, tail from cut_up),
  terms(term) as (values {wanted}),
  hits as (select chunk_id, i, n, term from flat join terms on starts_with(strip_accents(lower(token)), term)),
  sentences as (select chunk_id, i from flat where i = 0 or regexp_matches(gap, '[.:][ \\t\\n\\r]+$')),
  tried as (select distinct chunk_id, i as hit, n, 0 as kind, i as beg from hits
     union all select h.chunk_id, h.i, h.n, 1, max(s.i) from (select distinct chunk_id, i, n from hits where n > 24) h join sentences s on s.chunk_id = h.chunk_id and s.i <= h.i group by h.chunk_id, h.i, h.n having max(s.i) < h.i),
  per_term as (select t.chunk_id, t.hit, t.n, t.kind, t.beg, h.term, 1000 + count(*) - 1 as w, max(h.i) + 1 as last from tried t join hits h on h.chunk_id = t.chunk_id and h.i >= t.beg and h.i < t.beg + 24 group by all),
  worth as (select chunk_id, hit, n, kind, beg, sum(w) + case when kind = 0 then 0 when beg = 0 then 120 else 100 end as worth, max(last) as last from per_term group by chunk_id, hit, n, kind, beg),
  placed as (select *, case when kind = 1 then beg else greatest(least(beg - (24 - (last - beg)) // 2, n - 24), 0) end as start from worth),
  best as (select chunk_id, n, arg_max(start, (worth, -2 * hit - kind)) as start from placed group by 1, 2),
  shown as (select b.chunk_id, b.n, b.start, f.tail, f.i, case when f.i = b.start and b.start > 0 then '' else f.gap end || case when exists (select 1 from hits h where h.chunk_id = f.chunk_id and h.i = f.i) then '«' || f.token || '»' else f.token end as piece
     from best b join flat f on f.chunk_id = b.chunk_id and f.i >= b.start and f.i < b.start + 24),
  snips as (select chunk_id, trim(regexp_replace(case when start > 0 then ' … ' else '' end || string_agg(piece, '' order by i) || case when start + 24 < n then ' … ' else any_value(tail) end, '\\s+', ' ', 'g')) as snippet from shown group by chunk_id, start, n)"""


_TURN_CHUNKS = f"{TURNS_SQL}, chunks as (select session || ':' || ord as chunk_id, session, ord, text from turns)"


@query(f"with {_snippet_sql(_TURN_CHUNKS, ['that', 'with'])} select session, ord as ordinal, snippet from snips join chunks using (chunk_id)")
def search_snippet_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snippet of every turn that has a term of the query."""
    d = _chunks(spark, sf_dir).where(F.exists(word_tokens(F.col("text")), lambda t: S.matches(t, "that") | S.matches(t, "with")))
    return d.select("session", "ordinal", snippet(F.col("text"), ["that", "with"]).alias("snippet"))


_DOC_CHUNKS = "chunks as (select doc_id as chunk_id, text from documents)"


@query(f"with {_snippet_sql(_DOC_CHUNKS, ['ciones', 'erenthes', 'unden'])} select chunk_id as doc_id, snippet from snips")
def search_snippet_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of long texts, accents aside."""
    terms = ["ciones", "erenthes", "unden"]
    d = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.exists(word_tokens(folded(F.col("text"))), lambda t: S.matches(t, terms[0]) | S.matches(t, terms[1]) | S.matches(t, terms[2])))
    return d.select("doc_id", snippet(F.col("text"), terms).alias("snippet"))


@query(_bm25_sql(["that", "with"]))
def search_kept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first search again, from postings on disk: only the shards of its terms are read."""
    index = SearchIndex(spark, shared_path(spark, "index"), ("text", "speaker"))
    index.rebuild(_chunks(spark, sf_dir), meetings(spark, sf_dir))
    return _found(index.search("that with", boosts=BOOSTS))


def _half(d: DataFrame) -> DataFrame:
    return d.where("session % 3 <> 0").withColumn("text", F.when(F.col("session") % 5 == 1, F.lit("that was another text")).otherwise(F.col("text"))) if "text" in d.columns else d.where("session % 3 <> 0")


@query(_bm25_sql(["that", "user"], "c.speaker in ('assistant', 'system')", 50))
def search_kept_index_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that held other sessions and other texts of some, brought up to date and searched with filters that leave none with all terms."""
    index = SearchIndex(spark, shared_path(spark, "index"), ("text", "speaker"))
    chunks, m = _chunks(spark, sf_dir), meetings(spark, sf_dir)
    index.update(_half(chunks), _half(m))
    index.update(chunks, m)
    return _found(index.search("what about that user", limit=50, boosts=BOOSTS, kinds=["assistant", "system"]))


@query("select case when conv_id % 3 = 0 or conv_id % 5 = 1 then 'indexed' else 'unchanged' end as change, count(distinct conv_id)::bigint as sessions from conversations group by 1 union all select 'removed', 0::bigint")
def search_kept_index_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the update did: sessions indexed, left as they were, and removed."""
    index = SearchIndex(spark, shared_path(spark, "index"), ("text", "speaker"))
    chunks, m = _chunks(spark, sf_dir), meetings(spark, sf_dir)
    index.update(_half(chunks), _half(m))
    return spark.createDataFrame(list(index.update(chunks, m).items()), "change string, sessions long")
