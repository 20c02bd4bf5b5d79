"""Evidence grounded in what was said: quotes found whole or, where an ellipsis takes words out, by their parts in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..sources import evidence as E

#: A longer stretch than this gives way to its first part; shorter ones than this don't count.
MOST_CHARS, LEAST_WORDS = 700, 3


def stretch(quote: Column, line: Column) -> Column:
    """The part of a line from a quote's first fragment to its last, all of them in order; null if the line lacks one."""
    key = E.quote_key(line)
    fragments = F.filter(F.transform(F.split(quote, r"\.{3,}|…"), E.quote_key), lambda x: x != "")

    def step(s: Column, f: Column) -> Column:
        at = F.when(s["end"] >= 0, F.position(f, s["line"], s["end"] + 1))
        start = F.when(s["start"] > 0, s["start"]).otherwise(at)
        return F.when(at > 0, F.struct(s["line"].alias("line"), start.cast("int").alias("start"), (at - 1 + F.length(f)).cast("int").alias("end"))).otherwise(F.struct(s["line"].alias("line"), F.lit(0).alias("start"), F.lit(-1).alias("end")))

    def cut(parts: Column, s: Column) -> Column:
        whole = F.trim(F.substr(s["line"], s["start"], s["end"] - s["start"] + 1))
        short = F.when(F.length(whole) > MOST_CHARS, F.get(parts, F.lit(0))).otherwise(whole)
        return F.when((F.size(parts) > 0) & (s["end"] > 0), short)

    begin = F.struct(key.alias("line"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    return E.once(fragments, lambda parts: E.once(F.aggregate(parts, begin, step), lambda s: cut(parts, s)))


def ground(records: DataFrame, lines: DataFrame) -> DataFrame:
    """records (session, ord, timestamp, quote) with `exact`: the quote if it was said, else the stretch of its line that its fragments span; null if neither.

    lines: session, line, timestamp, text. A whole quote may run over several lines: each session's records meet its joined text once, as one row
    each. Fragments must be in one line that has the record's time, so records meet lines by session and time.
    """
    said = lines.groupBy("session").agg(E.quote_key(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")).alias("said"))
    own = records.select("session", F.struct("ord", "timestamp", "quote").alias("r"))
    by = own.groupBy("session").agg(F.collect_list("r").alias("rs")).join(said, "session", "left")
    whole = E.quote_key
    d = by.select("session", F.explode(F.transform("rs", lambda r: r.withField("found", F.coalesce((whole(r["quote"]) != "") & F.contains("said", whole(r["quote"])), F.lit(False))))).alias("r")).select("session", "r.*")
    at = lines.select("session", F.trim("timestamp").alias("timestamp"), "line", clean_text(F.col("text")).alias("text")).where("text <> ''")
    near = d.where(~F.col("found")).join(at, ["session", "timestamp"]).select("session", "ord", "line", stretch(F.col("quote"), F.col("text")).alias("exact")).where("exact is not null")
    first = near.groupBy("session", "ord").agg(F.min_by("exact", "line").alias("part"))
    enough = F.when(F.size(F.split("part", " ")) >= LEAST_WORDS, F.col("part"))
    return d.join(first, ["session", "ord"], "left").select("session", "ord", "timestamp", "quote", F.when(F.col("found"), F.col("quote")).otherwise(enough).alias("exact"))


def ground_ledger(evidence: DataFrame, lines: DataFrame) -> DataFrame:
    """session, evidence (the records whose quote was said, with the words as they were said) and dropped (ids of the others).

    evidence: session and evidence, a text of records. A text without any record stays as it is. The speaker of a record that leaves it
    open is the interviewer for interviewer_commentary, else the candidate.
    """
    blocks = evidence.select("session", F.posexplode(E.blocks(F.col("evidence"))).alias("ord", "b")).select("session", "ord", "b.*")
    head = F.regexp_extract("block", r"(?d)\A[^\n]*", 0)
    speaker = F.when(F.contains(head, F.lit("type=interviewer_commentary")), "interviewer").otherwise("candidate")
    rest = F.regexp_extract("block", r"(?ds)\A[^\n]*(\n.*)?\z", 1)
    g = blocks.join(ground(blocks, lines).select("session", "ord", "exact"), ["session", "ord"])
    opened = F.concat(F.regexp_replace(head, F.lit(r"speaker=candidate\|interviewer"), F.concat(F.lit("speaker="), speaker)), F.regexp_replace(rest, F.lit(r"(?d)\A(\n\s*)[^\n]*\S[^\n]*"), F.concat(F.lit('$1"'), F.regexp_replace("exact", r"([\\$])", r"\\$1"), F.lit('"'))))
    kept = F.when(F.col("exact").isNotNull(), F.struct("ord", F.regexp_replace(opened, r"\s+\z", "").alias("text")))
    of = g.groupBy("session").agg(F.collect_list(kept).alias("kept"), F.collect_list(F.when(F.col("exact").isNull(), F.struct("ord", "id"))).alias("lost"))
    joined = F.array_join(F.transform(F.array_sort("kept"), lambda x: x["text"]), "\n\n")
    return evidence.join(of, "session", "left").select("session", F.when(F.col("kept").isNull(), F.col("evidence")).otherwise(joined).alias("evidence"), F.transform(F.array_sort(F.coalesce("lost", F.array().cast("array<struct<ord:int,id:string>>"))), lambda x: x["id"]).alias("dropped"))


def merged_evidence(parts: DataFrame) -> DataFrame:
    """session, ord, id, block: records of all parts of a session, one of each time, situation and quote, the first one.

    parts: session, part, evidence.
    """
    b = parts.select("session", "part", F.posexplode(E.blocks(F.col("evidence"))).alias("at", "b")).select("session", "part", "at", "b.*")
    head = F.regexp_extract("block", r"(?d)\A[^\n]*", 0)
    situation = F.lower(F.trim(F.regexp_extract(head, r"\bsituation=([^|\n]+)", 1)))
    one = b.groupBy("session", "timestamp", situation.alias("situation"), E.quote_key(F.col("quote")).alias("key")).agg(F.min(F.struct("part", "at", "id", "block")).alias("r"))
    return one.select("session", "r.part", "r.at", "r.id", "r.block")
