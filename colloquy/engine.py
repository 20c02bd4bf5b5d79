"""One object over the operators: ingest exports, search, judge and list tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import evidence_norm
from .operators import clean, fold, ledger, quality, search, summaries, tasks
from .operators.index import SearchIndex, meeting_chunks
from .sources import exports, notes


#: What a chunk may be.
SEARCHABLE_KINDS = (
    "title", "tldr", "fact", "participant_claim", "recommendation", "hypothesis", "proposal",
    "decision", "commitment", "completed_action", "open_question", "transcript", "chat",
)


class Engine:
    """A folder of tables: entries by session, and the chunks and meetings that a search reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _stage(self, name: str, df: DataFrame) -> DataFrame:
        """df as a table of the folder, replaced each time: what is read several times is worked out once."""
        df.write.mode("overwrite").parquet(self._table(name))
        return self.spark.read.schema(df.schema).parquet(self._table(name))

    def _has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._table(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def ingest(self, path: str, **limits) -> DataFrame:
        """Cleans the fullest valid export of each session under path and replaces its entries; returns refused exports with their reason."""
        valid, refused = exports.split_valid(exports.read_exports(self.spark, path), **limits)
        valid = exports.fullest(valid)
        if self._has("meetings"):  # what was taken in before stays unless the new export says more
            before = self.meetings().select("session", F.struct("n_entries", "last_ms").alias("had"))
            valid = valid.join(before, "session", "left").where(F.col("had").isNull() | (F.struct("n_entries", "last_ms") > F.col("had"))).drop("had")
        self.normalised(exports.entries(valid)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(self._table("entries"))
        meeting = valid.select("session", F.date_format(exports.started_at(F.col("startedAt")), "yyyy-MM-dd").alias("meeting_date"), F.col("meetingTitle").alias("title"), "participants", "n_entries", "last_ms")
        meeting.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(self._table("meetings"))
        return refused.select("path", "reason")

    @staticmethod
    def normalised(raw: DataFrame) -> DataFrame:
        """Raw entries to turns: projection, replays, merging, assembly, in the order in which they feed each other."""
        d = clean.refuse_bad_times(clean.project_entries(raw))
        d = fold.drop_bursts(clean.recent_replays(d)).drop("candidate")
        return fold.assemble_turns(fold.merge_related(clean.exact_replay_batches(d)))

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(self._table("entries")).withColumn("session", F.col("session").cast("string"))

    def meetings(self) -> DataFrame:
        return self.spark.read.parquet(self._table("meetings")).withColumn("session", F.col("session").cast("string"))

    def chunks(self, items: DataFrame | None = None) -> DataFrame:
        """Transcript and chat lines, and evidence items if given, numbered within their session."""
        e = self.entries().select("session", F.lit(1).alias("rank"), F.col("ord").cast("long").alias("at"), F.when(F.col("kind") == "chat", "chat").otherwise("transcript").alias("kind"), "speaker", F.lit(None).cast("string").alias("owners"), F.lit(None).cast("string").alias("status"), "text")
        if items is not None:
            e = e.unionByName(items.select("session", F.lit(0).alias("rank"), F.col("item_id").cast("long").alias("at"), F.col("type").alias("kind"), "speaker", F.array_join("owners", ", ").alias("owners"), "status", F.col("claim").alias("text")))
        from pyspark.sql import Window

        return e.withColumn("ordinal", F.row_number().over(Window.partitionBy("session").orderBy("rank", "at")) - 1).withColumn("chunk_id", F.concat_ws(":", "session", "ordinal")).drop("rank", "at")

    def search(self, query: str = "", participants: Sequence[str] = (), owner: str | None = None, kinds: Sequence[str] = (), status: str | None = None, date_from: str | None = None, date_to: str | None = None, limit: int = 20, items: DataFrame | None = None) -> DataFrame:
        if unknown := sorted(set(kinds) - set(SEARCHABLE_KINDS)):
            raise ValueError(f"unknown kinds: {unknown}")
        return search.search(self.chunks(items), self.meetings(), query, limit=limit, participants=participants, owner=owner, kinds=kinds, status=status, date_from=date_from, date_to=date_to)

    def index(self, note_path: str, items: DataFrame, transcripts: DataFrame, rebuild: bool = False) -> dict[str, int]:
        """Brings the kept index up to the notes under a path, evidence items and transcripts (session, text): sessions indexed, unchanged and removed.

        Sessions whose content is as it was stay as they are; those without a note go. rebuild writes a new index and swaps it in.
        """
        meetings = notes.meetings(notes.scan(self.spark, note_path))
        chunks = meeting_chunks(meetings, items, notes.transcript_rows(transcripts), SEARCHABLE_KINDS)
        kept = SearchIndex(self.spark, self._table("index"))
        return (kept.rebuild if rebuild else kept.update)(chunks, meetings)

    def find(self, query: str = "", kinds: Sequence[str] = (), **conditions) -> DataFrame:
        """search() by the kept index, with snippets; only the shards of the query's terms are read."""
        if unknown := sorted(set(kinds) - set(SEARCHABLE_KINDS)):
            raise ValueError(f"unknown kinds: {unknown}")
        return SearchIndex(self.spark, self._table("index")).search(query, kinds=kinds, **conditions)

    def quality(self) -> DataFrame:
        """Capture metrics of every session."""
        return quality.capture_metrics(self.entries())

    def ledger(self, items: DataFrame, proofs: DataFrame) -> DataFrame:
        """Evidence items validated against the transcripts and brought through their lifecycle."""
        lines = self.entries().select("session", (F.col("ord") + 1).cast("long").alias("line"), F.col("start_ms").cast("string").alias("timestamp"), "speaker", "text")
        d = ledger.validated(items, proofs, lines)
        return ledger.lifecycle(d.withColumn("quotes", F.transform("evidence", lambda e: e["quote"])))

    def summary(self, items: DataFrame, proofs: DataFrame) -> dict[str, DataFrame]:
        """From evidence items to a summary: the ledger, what is wrong with it (findings), and its sections.

        Validated items are merged where they say the same, go through their lifecycle, are put into the transcript's language and merged again; what is left is
        judged and rendered. A session with an error among its findings has no sections. Deduplication and the choice of themes fold one session in one task.
        """
        columns = ["session", "item_id", "type", "claim", "status", "confidence", "owners", "deadline", "deadline_ambiguous", "source_order", "speaker", "quotes", "said"]
        lines = self.entries().select("session", (F.col("ord") + 1).cast("long").alias("line"), F.col("start_ms").cast("string").alias("timestamp"), "speaker", "text")
        d = ledger.validated(items, proofs, lines).withColumn("said", F.transform("evidence", lambda e: e["quote"]))
        d = d.withColumn("quotes", F.array_distinct(F.filter(F.transform("said", lambda q: evidence_norm(q)), lambda q: q != "")))
        d = ledger.lifecycle(self._stage("ledger-merged", fold.greedy_dedup(d.select(*columns)).drop("merged")))
        d = d.withColumn("claim", ledger.grounded_language(F.col("claim"), F.col("said")))
        d = self._stage("ledger", fold.greedy_dedup(d).drop("merged")).withColumn("is_accepted", ledger.accepted(F.col("quotes"))).withColumn("n_evidence", F.size("quotes"))
        again = ledger.duplicate_pairs(d).select("session", F.col("a").alias("item_id"), F.lit("duplicate_claim").alias("code"), F.lit("error").alias("severity"))
        findings = self._stage("findings", quality.issues(d, ledger.qa_findings(), ["session", "item_id"]).unionByName(again.distinct()))
        themes = fold.diverse_selection(d).withColumn("theme", F.lit(True))
        sound = d.join(themes, ["session", "item_id"], "left").withColumn("thematic", F.coalesce("theme", F.lit(False)))
        sound = sound.join(findings.where("severity = 'error'").select("session").distinct(), "session", "left_anti")
        return {"ledger": d.drop("is_accepted", "n_evidence"), "findings": findings, "sections": summaries.grounded_sections(sound)}

    def tasks(self, items: DataFrame, owner_names: Sequence[str]) -> DataFrame:
        """Open commitments of the given people."""
        found = tasks.from_ledger(items.withColumn("note", F.col("session")))
        return found.where(tasks.owned_by(F.col("involved"), owner_names))
