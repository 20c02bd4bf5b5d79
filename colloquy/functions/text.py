"""Text primitives as column expressions; every operator uses these and no others."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Невідомий"
MAX_SPEAKER, MAX_TEXT = 200, 20_000
#: Code points of Latin letters with accents, and the letter each begins with once taken apart; combining accents, last, go.
_APART = {c: unicodedata.normalize("NFD", chr(c))[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))}
_PLAIN_LETTERS = {c: base for c, base in _APART.items() if base.isascii() and base.isalpha()} | {c: None for c in range(0x300, 0x332)}


def clean_inline(c: Column) -> Column:
    """Control characters deleted (tab and line feed excepted), white space collapsed and stripped; null stays empty."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B-\x1F\x7F]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), r"^ | $", "")


def clean_speaker(c: Column) -> Column:
    """clean_inline cut to 200 characters, without a tail such as "& 5 others"; the unknown speaker if nothing is left."""
    name = F.substring(clean_inline(c), 1, MAX_SPEAKER)
    name = F.regexp_replace(name, r"(?i)\s*&\s*\d+\s+others?\s*$", "")
    name = F.regexp_replace(name, r"(?iuU)\s+(?:і|та|и)\s+ще\s+\d+\s+(?:учасник\w*|люд\w*)\s*$", "")
    name = F.trim(name)
    return F.when(name == "", F.lit(UNKNOWN)).otherwise(name)


def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def normalized(c: Column) -> Column:
    return F.lower(clean_text(c))


def word_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def without_accents(text: str) -> str:
    """Latin letters of both cases without their accents; all else stays."""
    return text.translate(_PLAIN_LETTERS)


def folded(c: Column) -> Column:
    """without_accents of a column; Latin accents of their own are deleted too."""
    return F.translate(c, "".join(map(chr, _PLAIN_LETTERS)), "".join(x or "" for x in _PLAIN_LETTERS.values()))


def evidence_norm(c: Column) -> Column:
    """Lower case, everything but letters, digits and the underscore as one space, stripped."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def quote_norm(c: Column) -> Column:
    """evidence_norm that also takes an ellipsis for a space."""
    return evidence_norm(F.replace(c, F.lit("…"), F.lit(" ")))


def n_words(c: Column) -> Column:
    """Words between white space."""
    t = clean_text(c)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))


def long_text(c: Column) -> Column:
    return (F.length(c) >= 80) | (n_words(c) >= 12)


def says(c: Column, words: str) -> Column:
    """Whether one of the alternatives stands in c with no letter, digit or underscore at either side."""
    return c.rlike(rf"(?i)(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])")


def lines(c: Column) -> Column:
    """Lines as Python's splitlines() cuts them, without an empty last one."""
    return F.split(F.regexp_replace(c, r"(\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}])$", ""), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all of two arrays' distinct elements; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, both / every).otherwise(0.0)
