"""A kept search index: tables on disk that a search reads by shard, replaced session by session.

Under the index's folder are

- `postings`: a row for every token of every chunk, in folders by segment and by shard (of a token's first letters), sorted by
  token, so that a search reads the shards of its terms and, of these, the row groups that can hold them;
- `chunks`: the chunks themselves, by segment and bucket of the session, read for the rows that a search returns;
- `sessions`: one row a session: the segment that holds it, a hash of its content, its counts and its meeting's columns;
- `versions`: small numbered files, each naming a sessions table and the segments it needs. The highest number is the
  index. A version is written whole, then renamed to a number that must be free, so readers see the index before or after an
  update and of two writers one fails.

An update compares content hashes, tokenises the sessions that are new or changed into one new segment, and leaves all others
where they are; replaced sessions stay in their old segment, unread, until a rebuild writes a single one.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, folded, normalized, without_accents, word_tokens
from .search import B, FIELD_WEIGHTS, K1, KIND_BOOST, LEAST_IDF, MOST_RESULTS, STOP_WORDS, browse_snippet, filters, index_diff, matches, query_terms
from .snippets import snippet

SHARDS, BUCKETS, SHARD_CHARS = 64, 64, 2
NOTHING = {"sessions": None, "segments": [], "schemas": {}}
#: What a chunk has; session and text must be there, the others are null where a table lacks them.
CHUNK_COLUMNS = {"ordinal": "long", "kind": "string", "speaker": "string", "owners": "string", "status": "string", "deadline": "string", "timestamp": "string", "source_line": "long", "text": "string"}


def index_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, Latin letters without their accents."""
    return word_tokens(folded(F.coalesce(c, F.lit(""))))


def shard_of(term: str) -> int:
    return zlib.crc32(term[:SHARD_CHARS].encode()) % SHARDS


def _hash_mod(c: Column, n: int) -> Column:
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n)).cast("int")


class SearchIndex:
    """The index in a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str, fields: Sequence[str] = ("text", "speaker", "owners")):
        self.spark, self.folder, self.fields = spark, folder.rstrip("/"), tuple(fields)

    # Versions

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the current version, 0 for none."""
        fs, at = self._files(), self._path("versions")
        if not fs.exists(at):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """What the current version, or an earlier one, is made of."""
        number = self.version() if version is None else version
        if not number:
            return dict(NOTHING)
        stream = self._files().open(self._path("versions", str(number)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, number: int, manifest: dict) -> None:
        fs, draft, final = self._files(), self._path("versions", f".draft-{uuid.uuid4().hex}"), self._path("versions", str(number))
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer made version {number} of {self.folder}")

    # Reading

    def _read(self, table: str, segments: Sequence[str], schemas: dict[str, str]) -> DataFrame:
        """Segments of a table; their schema is part of the version, as a segment can be without files."""
        paths = [f"{self.folder}/{table}/segment={s}" for s in segments]
        return self.spark.read.schema(schemas[table]).option("basePath", f"{self.folder}/{table}").parquet(*paths)

    def sessions(self) -> DataFrame:
        """One row a session: session, segment, content_hash, n_chunks, n_tokens, meeting (its columns)."""
        return self.spark.read.parquet(f"{self.folder}/{self._held()['sessions']}")

    def _held(self) -> dict:
        held = self.manifest()
        if not held["sessions"]:
            raise LookupError(f"no index in {self.folder}")
        return held

    # Writing

    def _content(self, chunks: DataFrame, meetings: DataFrame) -> DataFrame:
        """session, content_hash, meeting, of every session that has a meeting; sums of row hashes don't depend on order and add up before the shuffle."""
        row = F.xxhash64(*CHUNK_COLUMNS)
        by = chunks.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64(row, F.lit(7))).alias("x"))
        m = meetings.select("session", F.struct(*[c for c in meetings.columns if c != "session"]).alias("meeting"))
        return m.join(by, "session", "left").select("session", F.sha2(F.concat_ws("|", "n", "s", "x", F.to_json("meeting"), F.lit(",".join(self.fields))), 256).alias("content_hash"), "meeting")

    def _chunks(self, chunks: DataFrame) -> DataFrame:
        return chunks.select("session", *(F.col(c).cast(t).alias(c) if c in chunks.columns else F.lit(None).cast(t).alias(c) for c, t in CHUNK_COLUMNS.items()))

    def _segment(self, chunks: DataFrame) -> tuple[str, dict[str, str], DataFrame]:
        """Writes chunks and their postings; the segment's name, both tables' schemas, and counts by session."""
        name, ddl = uuid.uuid4().hex, lambda d: ", ".join(f"`{c}` {t}" for c, t in d.dtypes)
        schemas = {"chunks": ddl(chunks) + ", bucket int, segment string"}
        chunks.withColumn("bucket", _hash_mod(F.col("session"), BUCKETS)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "session", "ordinal").write.partitionBy("bucket").parquet(f"{self.folder}/chunks/segment={name}")
        kept = self._read("chunks", [name], schemas)
        tokens = F.array(*(F.struct(F.lit(k).cast("byte").alias("field"), index_tokens(F.col(f)).alias("tokens")) for k, f in enumerate(self.fields)))
        t = kept.select("session", "ordinal", "kind", "status", normalized(F.col("owners")).alias("owners"), tokens.alias("f"))
        n = F.aggregate("f", F.lit(0), lambda a, x: a + F.size(x["tokens"])).cast("int")
        p = t.select("session", "ordinal", "kind", "status", "owners", n.alias("n_tokens"), F.explode("f").alias("f")).select("session", "ordinal", "kind", "status", "owners", "n_tokens", "f.field", F.explode("f.tokens").alias("token"))
        p = p.withColumn("shard", _hash_mod(F.substring("token", 1, SHARD_CHARS), SHARDS))
        p.hint("rebalance", "shard").sortWithinPartitions("shard", "token", "session", "ordinal").write.partitionBy("shard").parquet(f"{self.folder}/postings/segment={name}")
        schemas["postings"] = ddl(p) + ", segment string"
        return name, schemas, t.select("session", n.alias("n")).groupBy("session").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n").alias("n_tokens"))

    def update(self, chunks: DataFrame, meetings: DataFrame) -> dict[str, int]:
        """Makes the index hold exactly these meetings; counts of sessions indexed, unchanged and removed."""
        return self._write(chunks, meetings, self.version())

    def rebuild(self, chunks: DataFrame, meetings: DataFrame) -> dict[str, int]:
        """The same from nothing, in one segment; the old version serves until the new one is whole."""
        return self._write(chunks, meetings, self.version(), afresh=True)

    def _write(self, chunks: DataFrame, meetings: DataFrame, number: int, afresh: bool = False) -> dict[str, int]:
        chunks = self._chunks(chunks)
        fresh = self._content(chunks, meetings)
        held = dict(NOTHING) if afresh else self.manifest()
        old = self.sessions() if held["sessions"] else None
        before = old if old is not None else fresh.select("session", "content_hash").limit(0)
        diff = index_diff(before.select("session", "content_hash"), fresh.select("session", "content_hash"))
        told = {r["change"]: r["n"] for r in diff.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
        counts = {k: told.get(k, 0) for k in ("indexed", "unchanged", "removed")}
        if old is not None and not counts["indexed"] and not counts["removed"]:
            return counts
        changed = diff.where("change = 'indexed'").select("session")
        name, schemas, n = self._segment(chunks.join(changed, "session", "left_semi"))
        rows = fresh.join(changed, "session", "left_semi").join(n, "session", "left").select("session", F.lit(name).alias("segment"), "content_hash", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "meeting")
        if old is not None:
            rows = old.join(diff.where("change = 'unchanged'"), "session", "left_semi").unionByName(rows)
        table = f"sessions/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{table}")
        used = {r["segment"] for r in self.spark.read.parquet(f"{self.folder}/{table}").select("segment").distinct().collect()}  # as many as updates since the last rebuild
        self._commit(number + 1, {"sessions": table, "segments": [s for s in (*held["segments"], name) if s in used or s == name], "schemas": schemas})
        return counts

    # Searching

    def search(self, query: str = "", limit: int = 20, stop_words: Sequence[str] = STOP_WORDS, boosts: dict[str, float] = KIND_BOOST, **conditions) -> DataFrame:
        """The best `limit` chunks with their snippets, or the newest for an empty query; conditions as in search.filters()."""
        if not 1 <= limit <= MOST_RESULTS:
            raise ValueError(f"limit must be between 1 and {MOST_RESULTS}")
        terms = list(dict.fromkeys(without_accents(t) for t in query_terms(query, stop_words)))
        held = self._held()
        sessions = self.spark.read.parquet(f"{self.folder}/{held['sessions']}").select("session", "segment", "n_chunks", "n_tokens", "meeting.*")
        meetings = sessions.drop("n_chunks", "n_tokens", "segment")
        live = sessions.select("session", "segment")
        time = [F.col("meeting_time").desc()] if "meeting_time" in meetings.columns else []
        if not terms:
            d = self._read("chunks", held["segments"], held["schemas"]).join(live, ["session", "segment"], "left_semi").drop("segment", "bucket")
            found = d.join(meetings, "session").where(filters(**conditions)).orderBy(F.col("meeting_date").desc(), *time, "session", "ordinal").limit(limit)
            return found.withColumn("snippet", browse_snippet(F.col("text"))).withColumn("score", F.lit(0.0))
        order = (F.col("score"), F.col("meeting_date").desc(), F.col("session"), F.col("ordinal"))
        scored = self._scored(terms, held, live, sessions, boosts).join(meetings, "session").where(filters(**conditions))
        top = scored.withColumn("all_terms", F.col("matched") == len(terms)).orderBy(F.col("all_terms").desc(), *order).limit(limit)
        some = F.max("all_terms").over(Window.partitionBy(F.lit(0)))  # over at most `limit` rows
        best = top.withColumn("some", some).where(F.col("all_terms") == F.col("some")).select("session", "segment", "ordinal", "matched", "score")
        rows = best.collect()  # at most MOST_RESULTS
        if not rows:
            return self._texts(best.limit(0), self._read("chunks", held["segments"], held["schemas"]).where("false"), meetings, terms).orderBy(*order)
        keys = self.spark.createDataFrame(rows, best.schema)
        bucket = [r[0] for r in keys.select(_hash_mod(F.col("session"), BUCKETS)).distinct().collect()]
        near = self._read("chunks", sorted({r["segment"] for r in rows}), held["schemas"]).where(F.col("bucket").isin(bucket) & F.col("session").isin(sorted({r["session"] for r in rows})))
        return self._texts(keys, near, meetings.where(F.col("session").isin(sorted({r["session"] for r in rows}))), terms).orderBy(*order)

    def _scored(self, terms: Sequence[str], held: dict, live: DataFrame, sessions: DataFrame, boosts: dict[str, float]) -> DataFrame:
        """A row for each chunk with any term: its place, kind, status, owners, matched and score."""
        token = F.col("token")
        wanted = F.lit(False)
        for t in terms:
            wanted |= matches(token, t)
        p = self._read("postings", held["segments"], held["schemas"]).where(F.col("shard").isin(sorted({shard_of(t) for t in terms})) & wanted)
        if len(held["segments"]) > 1:
            p = p.join(live, ["session", "segment"], "left_semi")
        weight = F.element_at(F.array(*(F.lit(FIELD_WEIGHTS[f]) for f in self.fields)), F.col("field") + 1)
        sums = [F.sum(F.when(matches(token, t), weight)).alias(f"f{i}") for i, t in enumerate(terms)]
        # A chunk's own columns are keys as well: sums alone are hashed, and both readers of `by` share its exchange.
        by = p.groupBy("session", "segment", "ordinal", "kind", "status", "owners", F.col("n_tokens").alias("n_here")).agg(*sums)
        having = by.agg(*(F.count(f"f{i}").alias(f"n{i}") for i in range(len(terms))))
        corpus = sessions.agg(F.sum("n_chunks").alias("n_all"), (F.sum("n_tokens") / F.sum("n_chunks")).alias("avg_tokens"))
        d = by.crossJoin(F.broadcast(having.crossJoin(corpus)))  # one row
        score, matched = F.lit(0.0), F.lit(0)
        for i in range(len(terms)):
            f, n = F.col(f"f{i}"), F.col(f"n{i}")
            idf = F.greatest(F.log((F.col("n_all") - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
            part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n_here") / F.col("avg_tokens")))
            score, matched = score - F.coalesce(part, F.lit(0.0)), matched + f.isNotNull().cast("int")
        boost = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in boosts.items()), F.lit(0.0))
        return d.select("session", "segment", "ordinal", "kind", "status", "owners", matched.alias("matched"), F.round(score + boost, 6).alias("score"))

    def _texts(self, keys: DataFrame, chunks: DataFrame, meetings: DataFrame, terms: Sequence[str]) -> DataFrame:
        d = chunks.join(F.broadcast(keys), ["session", "segment", "ordinal"]).drop("segment", "bucket")
        return d.withColumn("snippet", snippet(F.col("text"), terms)).join(meetings, "session")


def meeting_chunks(meetings: DataFrame, items: DataFrame, lines: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """The chunks of every meeting, numbered: its title, its summary if it has one, its evidence items, and its transcript's lines.

    items: session, item_id, type, claim, speaker, owners, status, deadline and evidence (an array of quote, timestamp, line);
    items without a claim or of another kind don't count. lines: session, line, timestamp, speaker, is_chat, text.
    """
    def row(rank: int, at: Column, kind: Column, text: Column, **more: Column) -> list[Column]:
        given = {"speaker": F.lit(""), "owners": F.lit(""), "status": F.lit(""), "deadline": F.lit(""), "timestamp": F.lit(""), "source_line": F.lit(0).cast("long")} | more
        return [F.col("session"), F.lit(rank).alias("rank"), at.cast("long").alias("at"), kind.alias("kind"), *(F.coalesce(c, F.lit("") if n != "source_line" else F.lit(0)).alias(n) for n, c in given.items()), text.alias("text")]

    title = meetings.select(*row(0, F.lit(0), F.lit("title"), F.col("title")))
    summary = meetings.where("tldr <> ''").select(*row(1, F.lit(0), F.lit("tldr"), F.col("tldr")))
    owners = F.array_distinct(F.filter(F.transform("owners", lambda o: clean_text(o)), lambda o: o != ""))
    times = F.filter(F.transform("evidence", lambda e: clean_text(e["timestamp"])), lambda t: t != "")
    line = F.array_min(F.transform("evidence", lambda e: e["line"].cast("long")))
    known = items.withColumn("claim", clean_text(F.col("claim"))).where((F.col("claim") != "") & F.col("type").isin(*kinds))
    item = known.select(*row(2, F.col("item_id"), F.col("type"), F.col("claim"), speaker=clean_text(F.col("speaker")), owners=F.array_join(owners, " / "), status=clean_text(F.col("status")), deadline=clean_text(F.col("deadline")), timestamp=F.get(times, F.lit(0)), source_line=line))
    said = lines.withColumn("text", clean_text(F.col("text"))).where("text <> ''").select(*row(3, F.col("line"), F.when(F.col("is_chat"), "chat").otherwise("transcript"), F.col("text"), speaker=F.col("speaker"), timestamp=F.col("timestamp"), source_line=F.col("line").cast("long")))
    every = title.unionByName(summary).unionByName(item).unionByName(said)
    return every.join(meetings.select("session"), "session", "left_semi").withColumn("ordinal", F.row_number().over(Window.partitionBy("session").orderBy("rank", "at")) - 1).drop("rank", "at")
