"""Running totals of arrays and parts of long texts, in time that grows with their length and not with its square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 32
#: Characters of a piece of a text; a part of the text is then cut from its pieces.
PIECE = 512

Combine = Callable[[Column, Column], Column]


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c worked out once: as a lambda's argument it isn't repeated where f uses it."""
    return F.transform(F.array(c), lambda x: f(x))[0]


def running(values: Column, combine: Combine, zero: Column, levels: int = 2) -> Column:
    """For each element the combination of all up to and with it. zero must change nothing.

    Blocks of BLOCK elements are combined first, then the blocks in the same way; only the last level takes each prefix anew, and has a
    BLOCK ** levels-th of the elements.
    """
    def each_prefix(v: Column) -> Column:
        return F.transform(v, lambda _, i: F.aggregate(F.slice(v, F.lit(1), i + 1), zero, combine))

    def blockwise(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        return bound(F.transform(starts, lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))), joined)

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, combine))
        until = bound(totals, each_prefix) if levels <= 1 else running(totals, combine, zero, levels - 1)
        return bound(until, lambda u: F.flatten(F.transform(blocks, lambda b, k: F.transform(each_prefix(b), lambda x: combine(F.coalesce(F.get(u, k - 1), zero), x)))))

    return bound(values, lambda v: F.when(F.size(v) > 0, blockwise(v)).otherwise(v))


def pieces(text: Column) -> Column:
    """A text in pieces of PIECE characters, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(text_pieces: Column, start: Column, end: Column) -> Column:
    """Characters start (from 0) to end (exclusive) of a text given by its pieces."""
    def of(k: Column) -> Column:
        low = F.greatest(start - k * PIECE, F.lit(0))
        return F.substr(F.get(text_pieces, k), low + 1, F.least(end - k * PIECE, F.lit(PIECE)) - low)

    ks = F.sequence(F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int"))
    return F.when(end > start, F.array_join(F.transform(ks, of), "")).otherwise("")
