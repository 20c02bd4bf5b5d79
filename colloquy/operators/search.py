"""Full-text search over chunks: inverted index, BM25 with field weights and kind boosts, filters, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized, word_tokens

#: Fixed values of the ranking.
FIELD_WEIGHTS = {"text": 1.0, "speaker": 0.7, "owners": 0.8}
KIND_BOOST = {"decision": -0.8, "commitment": -0.6, "open_question": -0.4, "tldr": -0.2}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
PREFIX_CHARS = 4
MOST_RESULTS = 200
#: Words that a query leaves out unless it has no others.
STOP_WORDS = (
    "а", "але", "в", "ви", "до", "з", "за", "і", "із", "й", "ми",
    "на", "не", "про", "та", "у", "що", "як", "які", "яка", "який",
    "було", "були", "вирішили", "обговорювали", "зустріч", "зустрічі",
    "meeting", "meetings", "the", "what", "about",
)


def query_terms(text: str, stop_words: Sequence[str] = STOP_WORDS) -> list[str]:
    """Distinct tokens that are no stop words, or all of them if nothing else is left."""
    import re

    tokens = list(dict.fromkeys(re.findall(r"[^\W_]+", text.casefold())))
    return [t for t in tokens if t not in stop_words] or tokens


def matches(token: Column, term: str) -> Column:
    """Terms of four letters and more match as prefixes."""
    return F.startswith(token, F.lit(term)) if len(term) >= PREFIX_CHARS else token == term


def postings(chunks: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(chunk_id, field, token) for every token: the inverted index before counting."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), word_tokens(F.coalesce(F.col(f), F.lit(""))).alias("tokens")) for f in fields))
    flat = chunks.select("chunk_id", F.explode(each).alias("f"))
    return flat.select("chunk_id", "f.field", F.explode("f.tokens").alias("token"))


def build_index(chunks: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(postings with tf, lengths): what a search needs of a corpus. Write the postings by `shard` to read only a query's tokens."""
    p = postings(chunks, fields).groupBy("token", "chunk_id", "field").agg(F.count(F.lit(1)).alias("tf"))
    lengths = chunks.select("chunk_id", sum((F.size(word_tokens(F.coalesce(F.col(f), F.lit("")))) for f in fields), F.lit(0)).cast("long").alias("n_tokens"))
    return p.withColumn("shard", F.substring("token", 1, 2)), lengths


def document_frequencies(chunks: DataFrame, field: str) -> DataFrame:
    """token, df, tf over the chunks."""
    return postings(chunks, [field]).groupBy("token", "chunk_id").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf"))


def bm25(chunks: DataFrame, terms: Sequence[str], fields: Sequence[str], boosts: dict[str, float] = KIND_BOOST) -> DataFrame:
    """chunks that have any term, with matched (terms found), score (lower is better) and any column they had.

    Tokens are filtered to the query's before the only shuffle; corpus statistics are one row and count all chunks.
    """
    # A token can match several terms (a prefix of another): each term gets its own posting.
    hit = F.filter(F.array(*(F.when(matches(F.col("token"), t), F.lit(i)) for i, t in enumerate(terms))), lambda x: x.isNotNull())
    weight = F.element_at(F.create_map(*(x for f in fields for x in (F.lit(f), F.lit(FIELD_WEIGHTS[f])))), F.col("field"))
    found = postings(chunks, fields).select("chunk_id", weight.alias("w"), F.explode(hit).alias("term")).groupBy("chunk_id", "term").agg(F.sum("w").alias("f"))
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("n_i"))
    lengths = chunks.withColumn("n_tokens", sum((F.size(word_tokens(F.coalesce(F.col(f), F.lit("")))) for f in fields), F.lit(0)))
    corpus = lengths.agg(F.count(F.lit(1)).alias("n_all"), F.avg("n_tokens").alias("avg_tokens"))
    idf = F.greatest(F.log((F.col("n_all") - F.col("n_i") + 0.5) / (F.col("n_i") + 0.5)), F.lit(LEAST_IDF))
    idfs = df.crossJoin(F.broadcast(corpus)).select("term", idf.alias("idf"), "avg_tokens")  # one row a query term
    scored = found.join(F.broadcast(idfs), "term").join(lengths.select("chunk_id", "n_tokens"), "chunk_id")
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.col("avg_tokens")))
    per_chunk = scored.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("matched"), (-F.sum(part)).alias("bm25"))
    boost = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in boosts.items()), F.lit(0.0))
    return chunks.join(per_chunk, "chunk_id").withColumn("score", F.round(F.col("bm25") + boost, 6)).drop("bm25")


def filters(participants: Sequence[str] = (), owner: str | None = None, kinds: Sequence[str] = (), status: str | None = None, date_from: str | None = None, date_to: str | None = None) -> Column:
    """All given conditions; Catalyst pushes those on chunk columns below the joins."""
    on = F.lit(True)
    for p in participants:
        on &= _some(p)
    if owner:
        on &= F.contains(normalized(F.col("owners")), F.lower(F.lit(owner)))
    if kinds:
        on &= F.col("kind").isin(*kinds)
    if status:
        on &= F.col("status") == status
    if date_from:
        on &= F.col("meeting_date") >= date_from
    if date_to:
        on &= F.col("meeting_date") <= date_to
    return on


def _some(name: str) -> Column:
    return F.exists("participants", lambda x: F.contains(normalized(x), F.lower(F.lit(name))))


def search(chunks: DataFrame, meetings: DataFrame, text: str, fields: Sequence[str] = ("text", "speaker", "owners"), limit: int = 20, stop_words: Sequence[str] = STOP_WORDS, boosts: dict[str, float] = KIND_BOOST, **conditions) -> DataFrame:
    """The best `limit` chunks for a query, or the newest for an empty one; conditions as in filters().

    If a chunk that meets the conditions has all terms, only such chunks count, else those with any term.
    """
    if not 1 <= limit <= MOST_RESULTS:
        raise ValueError(f"limit must be between 1 and {MOST_RESULTS}")
    terms = query_terms(text, stop_words)
    if terms:
        found = bm25(chunks, terms, fields, boosts).join(meetings, "session").where(filters(**conditions))
        # Those with all terms come first: the top rows show whether there are any.
        order = (F.col("score"), F.col("meeting_date").desc(), F.col("session"), F.col("ordinal"))
        top = found.withColumn("all_terms", F.col("matched") == len(terms)).orderBy(F.col("all_terms").desc(), *order).limit(limit)
        some = F.max("all_terms").over(Window.partitionBy(F.lit(0)))  # over at most `limit` rows
        return top.withColumn("some", some).where(F.col("all_terms") == F.col("some")).drop("all_terms", "some").orderBy(*order)
    found = chunks.join(meetings, "session").where(filters(**conditions))
    time = [F.col("meeting_time").desc()] if "meeting_time" in meetings.columns else []
    return found.orderBy(F.col("meeting_date").desc(), *time, "session", "ordinal").limit(limit)


def browse_snippet(text: Column) -> Column:
    """Texts over 240 characters are cut to 237 and an ellipsis."""
    return F.when(F.length(text) > 240, F.concat(F.substring(text, 1, 237), F.lit("…"))).otherwise(text)


def index_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """session and change: indexed (new or other content), unchanged, removed; both sides have session and content_hash."""
    j = old.select("session", F.col("content_hash").alias("was")).join(new.select("session", F.col("content_hash").alias("now")), "session", "full")
    change = F.when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("indexed")
    return j.select("session", change.alias("change"))
