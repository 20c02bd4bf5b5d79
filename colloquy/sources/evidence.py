"""Interview evidence as text: records, the quotes below them, and quotes cited in reports, as column expressions.

A record is a header line "[Eid] speaker=... | type=... | situation=... | timestamp=... | dimensions=... | signals=... | phase=... | support=..."
and, below it, the quote it stands for. Where an id occurs twice the later record counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flags of all patterns: line feeds alone end lines, ^ and $ are ends of lines, case is ignored, classes are Unicode.
FLAGS = "(?dmiuU)"
ID = r"[A-Za-z0-9._-]+"
#: An id of several parts, as reports cite it.
LONG_ID = r"E[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+"
CLOCK = r"(?<!\d)(?:\d{1,2}:)?\d{1,2}:\d{2}(?!\d)"
#: The parts of a header in their order; the last two may be missing.
PARTS = ("speaker", "type", "situation", "timestamp", "dimensions", "signals")
LATE_PARTS = ("phase", "support")
HEADER = (
    FLAGS + rf"^\[E({ID})\]\s*" + r"\|\s*".join(rf"{p}=([^|\n]{'*' if p == 'signals' else '+'})" for p in PARTS)
    + "".join(rf"(?:\|\s*{p}=([^|\n]+))?" for p in LATE_PARTS) + r"\s*$"
)
LOOSE_HEADER = FLAGS + rf"^\[E({ID})\]\s+.*?timestamp=([^|\n]+).*?$"
CITED_QUOTE = FLAGS + rf"^>\s*\[E({ID})\]\s*[«\"](.*?)[»\"](.*)$"


def once(c: Column, f) -> Column:
    """f(c), with c worked out once: as a lambda's argument it isn't repeated where f uses it."""
    return F.transform(F.array(c), f)[0]


def quote_key(c: Column) -> Column:
    """Lower case, ellipses of either form and all but letters, digits and underscores as one space, stripped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"…|\.{3,}", " "), r"[^\p{L}\p{N}\p{M}_]+", " "))


def bare_quote(line: Column) -> Column:
    """A line without its quotation mark (>) and the quotes around it."""
    line = F.regexp_replace(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""), r"(?U)^>\s*", "")
    inner = F.regexp_extract(line, r"^[«\"](.+?)[»\"]$", 1)
    return F.when(inner != "", F.trim(inner)).otherwise(line)


def _last_of_id(records: Column) -> Column:
    return F.filter(records, lambda r, i: ~F.exists(F.slice(records, i + 2, F.size(records)), lambda later: later["id"] == r["id"]))


def records(evidence: Column) -> Column:
    """Array of records: id, the header's parts in lower case, dimensions and signals as arrays."""
    heads = F.regexp_extract_all(F.coalesce(evidence, F.lit("")), F.lit(HEADER), F.lit(0))

    def read(h: Column) -> Column:
        part = lambda k: F.trim(F.lower(F.regexp_extract(h, HEADER, k)))
        several = lambda c: F.transform(F.split(F.replace(c, F.lit(";"), F.lit(",")), ","), lambda x: F.trim(x))
        simple = {p: part(k + 2) for k, p in enumerate((*PARTS, *LATE_PARTS))}
        arrays = {p: several(simple[p]) if p == "dimensions" else F.transform(F.split(simple[p], ","), lambda x: F.trim(x)) for p in ("dimensions", "signals")}
        return F.struct(F.regexp_extract(h, HEADER, 1).alias("id"), *(v.alias(k) for k, v in (simple | arrays).items()))

    return once(F.transform(heads, read), _last_of_id)


def _blocks(evidence: Column, header: str) -> Column:
    return F.filter(F.split(F.coalesce(evidence, F.lit("")), f"(?=(?:{header}))"), lambda b: b.rlike(r"\A" + header))


def first_line(block: Column) -> Column:
    """The first line after the header that isn't blank."""
    return F.regexp_extract(block, r"(?d)\A[^\n]*\n\s*([^\n]*\S[^\n]*)", 1)


def quotes(evidence: Column) -> Column:
    """Array of (id, quote): of every record that has a line below its header, that line."""
    def read(b: Column) -> Column:
        return F.struct(F.regexp_extract(b, r"(?i)\A\[E([A-Za-z0-9._-]+)\]", 1).alias("id"), bare_quote(first_line(b)).alias("quote"))

    found = F.filter(F.transform(_blocks(evidence, FLAGS + rf"^\[E{ID}\]\s+(?:speaker=|.*?timestamp=)"), read), lambda r: r["quote"] != "")
    return once(found, _last_of_id)


def blocks(evidence: Column) -> Column:
    """Array of whole records with a time: id, timestamp, quote and block, in order, repeated ids too."""
    def read(b: Column) -> Column:
        return F.struct(F.regexp_extract(b, LOOSE_HEADER, 1).alias("id"), F.trim(F.regexp_extract(b, LOOSE_HEADER, 2)).alias("timestamp"), bare_quote(first_line(b)).alias("quote"), F.trim(F.regexp_replace(b, r"\s+\z", "")).alias("block"))

    return F.transform(_blocks(evidence, FLAGS + rf"^\[E{ID}\]\s+.*?timestamp=[^|\n]+"), read)


def cited_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\[E({ID})\]"), F.lit(1)))


def cited_quotes(report: Column) -> Column:
    """Array of (id, quote) of the lines "> [Eid] «quote»" of a report."""
    lines = F.regexp_extract_all(report, F.lit(CITED_QUOTE), F.lit(0))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, CITED_QUOTE, 1).alias("id"), quote_key(F.regexp_extract(x, CITED_QUOTE, 2)).alias("quote")))


def field(report: Column, label: str) -> Column:
    """The value behind "**label:**"."""
    return F.regexp_extract(report, FLAGS + rf"^\*\*\Q{label}\E:\*\*\s*(.+?)\s*$", 1)


def dimension_section(report: Column, heading: str) -> Column:
    """What stands under "### n. heading", up to the next such heading or chapter."""
    return F.regexp_extract(report, r"(?dmsuU)^###\s+\d+\.\s+" + rf"\Q{heading}\E\b(.*?)(?=^###\s+\d+\.|^##\s+|\z)", 1)


def chapter(report: Column, heading: str) -> Column:
    """What stands under "## heading", up to the next chapter."""
    return F.regexp_extract(report, r"(?dmsuU)^##\s+" + rf"\Q{heading}\E\s*(.*?)(?=^##\s+|\z)", 1)
