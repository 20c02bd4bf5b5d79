"""Action items from notes and ledgers, owner resolution, fingerprints and synchronisation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, evidence_norm, says

#: What stands for "nothing" in a note.
PLACEHOLDERS = ("", "немає", "відсутні", "відсутнє", "не визначено", "не було")
NO_DEADLINE = (
    r"(?iu)\s*[—–-]\s*(?:дедлайн|термін)\s+(?:не\s+(?:вказан(?:о|ий)|звучав|визначен(?:о|ий))|відсутній)(?:\s*\([^)]*\))?\.?\s*$",
    r"(?iu)\s*[—–-]\s*без\s+(?:чіткого\s+)?дедлайну\.?\s*$",
)
SECRET = r"\b(hf_|ntn_)[A-Za-z0-9_-]+"


def plain_markdown(c: Column) -> Column:
    """Links give their text, emphasis and code marks go, white space collapses."""
    c = F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return clean_text(F.regexp_replace(c, r"\*\*|__|`", ""))


def clean_task_name(c: Column) -> Column:
    c = plain_markdown(c)
    for p in NO_DEADLINE:
        c = F.regexp_replace(c, p, "")
    return F.regexp_replace(c, r"^[ \t—–.-]+|[ \t—–.-]+$", "")


def is_placeholder(c: Column) -> Column:
    return F.lower(F.regexp_replace(plain_markdown(c), r"^[ «»—–.-]+|[ «»—–.-]+$", "")).isin(*PLACEHOLDERS)


def resolve_owners(c: Column, names: dict[str, str]) -> Column:
    """Speaker labels give way to names, the longest label first, whole words only; placeholders to nothing."""
    out = plain_markdown(c)
    for label in sorted(names, key=len, reverse=True):
        out = F.regexp_replace(out, rf"(?U)\b\Q{label}\E\b", names[label].replace("$", r"\$"))
    return F.when(is_placeholder(c), "").otherwise(out)


def owned_by(c: Column, names: Sequence[str]) -> Column:
    """Whether one of the names stands in c as a word of its own."""
    import re

    return says(plain_markdown(c), "|".join(map(re.escape, names)))


def fingerprint(note: Column, name: Column, involved: Column) -> Column:
    squeeze = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.sha2(F.concat_ws("\n", note, squeeze(name), squeeze(involved)), 256)


def redact(c: Column) -> Column:
    return F.regexp_replace(c, SECRET, "$1***")


def from_bullets(notes: DataFrame, heading: str = "Action items") -> DataFrame:
    """note, ord, name, involved of the bullets under a heading of each note's markdown.

    A bullet may begin with its owners in brackets; an indented bullet without any has its parent's; a line that is no bullet
    continues the one before it. Running functions over the lines of one note carry parents and continuations along.
    """
    rows = notes.select("note", F.posexplode(F.split("markdown", "\n")).alias("ord", "line"))
    by = Window.partitionBy("note").orderBy("ord")
    inside = F.last(F.when(F.col("line").rlike(r"^##\s"), F.col("line").rlike(rf"^##\s+{heading}\s*$")), ignorenulls=True).over(by)
    rows = rows.withColumn("inside", inside).where("inside").where(~F.col("line").rlike(r"^##\s") & (F.trim("line") != ""))
    bullet = F.col("line").rlike(r"^\s*(?:[-*]|\d+\.)\s+")
    rows = rows.withColumn("bullet", bullet).withColumn("item", F.sum(bullet.cast("int")).over(by)).where("item > 0")
    body = F.regexp_replace("line", r"^\s*(?:[-*]|\d+\.)\s+", "")
    rows = rows.withColumns({"body": F.trim(body), "nested": F.col("bullet") & F.col("line").rlike(r"^\s{2,}")})
    owner = F.regexp_extract("body", r"^(?:\*\*)?\[([^\]]+)\](?:\*\*)?\s*(.*)$", 1)
    rows = rows.withColumn("owner", F.when(F.col("bullet"), F.trim(owner)))
    rows = rows.withColumn("text", F.when(F.col("bullet") & (F.col("owner") != ""), F.regexp_extract("body", r"^(?:\*\*)?\[([^\]]+)\](?:\*\*)?\s*(.*)$", 2)).otherwise(F.col("body")))
    parent = F.last(F.when(F.col("bullet") & ~F.col("nested"), F.col("owner")), ignorenulls=True).over(by)
    rows = rows.withColumn("involved", F.when(F.col("nested") & (F.col("owner") == ""), parent).otherwise(F.col("owner")))
    g = rows.groupBy("note", "item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"), F.first("involved", ignorenulls=True).alias("involved"))
    return g.select("note", F.col("item").cast("long").alias("ord"), clean_task_name(F.col("text")).alias("name"), F.coalesce("involved", F.lit("")).alias("involved")).where(~is_placeholder(F.col("name")))


def from_ledger(items: DataFrame) -> DataFrame:
    """note, name, involved, fingerprint of open commitments, once a claim; soft ones are marked, deadlines appended."""
    nth = F.row_number().over(Window.partitionBy("note", evidence_norm(F.col("claim"))).orderBy("source_order", "item_id"))
    name = F.concat(F.when(F.col("commitment_strength") == "soft", "Спробувати: ").otherwise(""), "claim", F.when(F.coalesce("deadline", F.lit("")) != "", F.concat(F.lit(" — дедлайн: "), "deadline")).otherwise(""))
    d = items.where((F.col("type") == "commitment") & (F.col("status") == "open") & ~is_placeholder(F.col("claim"))).withColumn("nth", nth).where("nth = 1")
    return d.select("note", name.alias("name"), F.array_join("owners", ", ").alias("involved")).withColumn("fingerprint", fingerprint(F.col("note"), F.col("name"), F.col("involved")))


def pending(tasks: DataFrame, synced: DataFrame, names: Sequence[str]) -> DataFrame:
    """Tasks of the given owners that no fingerprint of `synced` covers yet, once each."""
    return tasks.where(owned_by(F.col("involved"), names)).join(synced, "fingerprint", "left_anti").dropDuplicates(["fingerprint"])


def to_trash(tasks: DataFrame, note: str, owner_names: Sequence[str]) -> DataFrame:
    """Posted tasks of one note that are not yet in the trash and not the owner's own."""
    posted = (F.col("note") == note) & (F.coalesce("page_id", F.lit("")) != "") & F.col("trashed_at").isNull()
    return tasks.where(posted & ~F.coalesce(owned_by(F.col("involved"), owner_names), F.lit(False)))
