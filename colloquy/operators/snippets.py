"""The part of a text that best shows a query's terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import clean_text, folded
from .search import matches

#: Tokens of a snippet, its marks, and what a window earns that begins with the text or with a sentence.
TOKENS, OPEN, CLOSE, GAP = 24, "«", "»", " … "
TEXT_START, SENTENCE_START = 120, 100
FIRST, AGAIN = 1000, 1


def snippet(text: Column, terms: Sequence[str], tokens: int = TOKENS) -> Column:
    """The best window of `tokens` tokens, with each matched token in marks and a gap where text is left out.

    A window's worth is FIRST for each term in it and AGAIN for each further match. Each match is tried in two windows: one that
    has it and the matches up to `tokens` later in its middle, and one from the start of its sentence. The first of the best ones is taken; without any match it is the text's beginning.
    """
    # Each step is bound as a lambda's argument, so that it is worked out once a row.
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(r"([^\p{L}\p{N}]*)[\p{L}\p{N}]+"), F.lit(1)).alias("gap"),
        F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)).alias("token"),
        F.regexp_extract(text, r"([^\p{L}\p{N}]*)\z", 1).alias("tail"),
    )
    return clean_text(F.transform(F.array(parts), lambda p: _best(p, terms, tokens))[0])


def _best(p: Column, terms: Sequence[str], tokens: int) -> Column:
    def places(term: str) -> Column:
        return F.filter(F.transform(p["token"], lambda t, i: F.when(matches(folded(F.lower(t)), term), i)), lambda i: i.isNotNull())

    n = F.size(p["token"])
    starts = F.filter(F.transform(p["gap"], lambda g, i: F.when((i == 0) | g.rlike(r"[.:][ \t\n\r]+$"), i)), lambda i: i.isNotNull())
    known = F.struct(F.array(*(places(t) for t in terms)).alias("by_term"), starts.alias("starts"))
    return F.transform(F.array(known), lambda k: F.transform(F.array(F.array_sort(F.array_distinct(F.flatten(k["by_term"])))), lambda every: _cut(p, every, _start(k, every, n, tokens), n, tokens))[0])[0]


def _start(k: Column, every: Column, n: Column, tokens: int) -> Column:
    def worth(at: Column) -> Column:
        def of(places: Column) -> Column:
            inside = F.size(F.filter(places, lambda x: (x >= at) & (x < at + tokens)))
            return F.when(inside > 0, FIRST + (inside - 1) * AGAIN).otherwise(0)

        return F.aggregate(F.transform(k["by_term"], of), F.lit(0), lambda a, x: a + x)

    def tried(at: Column, order: Column) -> Column:
        last = F.array_max(F.filter(every, lambda x: x < at + tokens)) + 1
        middle = (at - F.floor((tokens - (last - at)) / 2)).cast("int")
        middle = F.greatest(F.when(middle + tokens > n, n - tokens).otherwise(middle), F.lit(0))
        sentence = F.array_max(F.filter(k["starts"], lambda x: x <= at))
        head = worth(sentence) + F.when(sentence == 0, TEXT_START).otherwise(SENTENCE_START)
        return F.array(
            F.struct(worth(at).alias("worth"), (-2 * order).alias("first"), middle.alias("start")),
            F.when((n > tokens) & (sentence < at), F.struct(head.alias("worth"), (-2 * order - 1).alias("first"), sentence.alias("start"))),
        )

    return F.coalesce(F.array_max(F.flatten(F.transform(every, tried)))["start"], F.lit(0))


def _cut(p: Column, every: Column, start: Column, n: Column, tokens: int) -> Column:
    def shown(start: Column) -> Column:
        window = F.slice(F.arrays_zip(p["gap"].alias("gap"), p["token"].alias("token")), start + 1, tokens)

        def said(x: Column, i: Column) -> Column:
            word = F.when(F.array_contains(every, (start + i).cast("int")), F.concat(F.lit(OPEN), x["token"], F.lit(CLOSE))).otherwise(x["token"])
            return F.when((i == 0) & (start > 0), word).otherwise(F.concat(x["gap"], word))

        body = F.array_join(F.transform(window, said), "")
        return F.concat(F.when(start > 0, F.lit(GAP)).otherwise(""), body, F.when(start + tokens < n, F.lit(GAP)).otherwise(p["tail"]))

    return F.transform(F.array(start), shown)[0]
