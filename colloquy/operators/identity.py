"""Who and when: a session's date and time, the fields of an interview's title, and names of devices that become known late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNKNOWN, clean_speaker

#: What a meeting's title can say of its stage, in order; the limits of a name and a target.
STAGES = (
    (r"(?iuU)(?<!\w)(?:final|фінальн\w*)(?!\w)", "Final"), (r"(?iuU)(?:technical|tech interview|технічн\w*)", "Technical"), (r"(?iuU)(?:hiring manager|hm interview)", "Hiring Manager"),
    (r"(?iuU)(?:recruiter|screening|hr interview)", "HR/Recruiter"), (r"(?iuU)(?<!\w)networking(?!\w)", "Networking"),
)
NO_STAGE, NAME_CHARS, TARGET_CHARS = "Невідомий", 80, 160
NO_TIME = "—"
LATE_NAME, TAIL_CHARS = "Учасник ", 6


def session_date(session: Column) -> Column:
    at = F.regexp_extract(session, r"^(\d{4}-\d{2}-\d{2})_(\d{2})-?(\d{2})", 1)
    return F.when(at != "", at).otherwise(NO_TIME)


def session_time(session: Column) -> Column:
    """HH:MM, or HH:MM:SS where the session tells its second."""
    form = r"^\d{4}-\d{2}-\d{2}_(\d{2})-?(\d{2})(?:-?(\d{2}))?"
    h, m, s = (F.regexp_extract(session, form, k) for k in (1, 2, 3))
    return F.when(h == "", NO_TIME).otherwise(F.concat(h, F.lit(":"), m, F.when(s != "", F.concat(F.lit(":"), s)).otherwise("")))


def safe_name(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, r"[/\\:|<>*?\"'«»]", ""), r"(?U)\s+", " ")
    return F.trim(F.substring(F.regexp_replace(bare, r"^[ .—–\-|_]+|[ .—–\-|_]+$", ""), 1, NAME_CHARS))


def title_fields(title: Column, is_interview: Column) -> dict[str, Column]:
    """candidate, target and stage of a title "kind | candidate | target | stage"; is_interview tells whether the first field is one.

    Without a fourth field the first one's words tell the stage.
    """
    parts = F.split(F.coalesce(title, F.lit("")), r"\|")
    part = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    known = F.coalesce(*(F.when(safe_name(part(0)).rlike(p), F.lit(s)) for p, s in STAGES), F.lit(NO_STAGE))
    stage = safe_name(part(3))
    return {
        "candidate": F.when(is_interview & (F.size(parts) >= 2), safe_name(part(1))).otherwise(""),
        "target": F.when(is_interview & (F.size(parts) >= 3), F.substring(F.trim(F.regexp_replace(part(2), r"(?U)\s+", " ")), 1, TARGET_CHARS)).otherwise(""),
        "stage": F.when(is_interview & (F.size(parts) >= 4), F.when(stage != "", stage).otherwise(NO_STAGE)).otherwise(known),
    }


def device_id(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "^@", "")


def device_tail(c: Column) -> Column:
    return F.element_at(F.split(device_id(c), "/"), -1)


def with_device_names(entries: DataFrame, names: DataFrame) -> DataFrame:
    """entries (session, device, at and any more) with `speaker`, as the names that become known leave it.

    names: session, device, name, at. At its time an entry gets the latest name of its whole device id, else of the id's last part, else a stand-in; a name that
    becomes known later for the same last part replaces it. Entries are joined once, with the names of their device, so none is written again: the join at
    read time is the back-fill. Names that are no names don't count.
    """
    n = names.select("session", device_id(F.col("device")).alias("id"), device_tail(F.col("device")).alias("tail"), clean_speaker(F.col("name")).alias("name"), "at").where((F.col("id") != "") & (F.col("name") != UNKNOWN))
    known = n.groupBy("session", "tail").agg(F.array_sort(F.collect_list(F.struct("at", "id", "name"))).alias("known"))  # one device's names
    e = entries.withColumns({"__id": device_id(F.col("device")), "__tail": device_tail(F.col("device"))})
    k = known.select(F.col("session").alias("__s"), F.col("tail").alias("__t"), F.col("known").alias("__known"))
    d = e.join(k, (F.col("session") == F.col("__s")) & (F.col("__tail") == F.col("__t")), "left")
    last = lambda test: F.get(F.filter("__known", test), F.size(F.filter("__known", test)) - 1)["name"]
    later = last(lambda x: x["at"] > F.col("at"))
    whole = last(lambda x: (x["at"] <= F.col("at")) & (x["id"] == F.col("__id")))
    part = last(lambda x: x["at"] <= F.col("at"))
    stand_in = F.concat(F.lit(LATE_NAME), F.right(F.when(F.col("__tail") != "", F.col("__tail")).otherwise(F.col("__id")), F.lit(TAIL_CHARS)))
    return d.withColumn("speaker", F.coalesce(later, whole, part, stand_in)).select(*entries.columns, "speaker")
