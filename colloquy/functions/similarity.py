"""Similarity of token sequences and texts, for folds that no column expression can carry."""

from __future__ import annotations

import difflib
import functools
import math
import re
from collections.abc import Sequence

import numpy as np

#: Fixed limits.
MOST_TOKENS, EXPANSION, CORRECTION, CORRECTION_WORDS = 120, 0.9, 0.8, 5
_TOKEN = re.compile(r"[^\W_]+")
_NOT_WORD = re.compile(r"[^\w]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.casefold())


def norm(text: str) -> str:
    return _NOT_WORD.sub(" ", text.casefold()).strip()


def is_long(text: str) -> bool:
    return len(text) >= 80 or len(text.split()) >= 12


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Longest common subsequence, bit-parallel: the state of one row is one integer (Hyyrö 2004)."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def at_edge(short: Sequence[str], long: Sequence[str]) -> bool:
    n = len(short)
    return 0 < n <= len(long) and (list(long[:n]) == list(short) or list(long[-n:]) == list(short))


def expands(short: Sequence[str], long: Sequence[str]) -> bool:
    """Whether nearly all of short comes in order at the beginning of long."""
    n = len(short)
    if not n or n > len(long) or max(n, len(long)) > MOST_TOKENS:
        return False
    return lcs_length(short, long[: n + max(2, math.ceil(n / 10))]) >= EXPANSION * n


def corrects(old: Sequence[str], new: Sequence[str]) -> bool:
    """Whether new is old with a few words changed: both have five words, the same first two, and most of the rest."""
    few, many = sorted((len(old), len(new)))
    if few < CORRECTION_WORDS or many > MOST_TOKENS or list(old[:2]) != list(new[:2]):
        return False
    return lcs_length(old, new) >= CORRECTION * few


def related(old: str, new: str, fuzzy: bool) -> str | None:
    """The text that stands for both if they are forms of one utterance, else None.

    In this order: the longer of prefix and whole, the longer where one's tokens stand at an edge of the other's, and if fuzzy
    the expansion of a long text and the correction of a short one.
    """
    if not old or not new:
        return None
    for whole, part in ((old, new), (new, old)):
        if whole.startswith(part):
            return whole
    a, b = tokens(old), tokens(new)
    (short, short_text), (long, long_text) = ((b, new), (a, old)) if len(a) > len(b) else ((a, old), (b, new))
    if at_edge(short, long):
        return long_text
    if fuzzy and is_long(short_text) and expands(short, long):
        return long_text
    return new if fuzzy and corrects(a, b) else None


#: Words of one letter that are no cut-off beginning of another word.
ONE_LETTER = frozenset("яіаувзйжб")


def stitch(old: str, new: str) -> str:
    """Two pieces of one turn as one text: a shared form, an overlap of up to 20 tokens, a completed last word, or both in a row."""
    if (same := related(old, new, True)) is not None:
        return same
    a, b, old_words, new_words = tokens(old), tokens(new), old.split(), new.split()
    overlap = next((n for n in range(min(len(a), len(b), 20), 0, -1) if a[-n:] == b[:n]), 0)
    if overlap:
        return " ".join(old_words + new_words[overlap:])
    if old_words and new_words:
        last, first = tokens(old_words[-1]), tokens(new_words[0])
        if last and first and first[0].startswith(last[0]) and last[0] not in ONE_LETTER:
            return " ".join(old_words[:-1] + new_words)
    return f"{old} {new}".strip()


def _matching(a: str, b: str, need: int) -> int:
    """Characters in matching blocks as difflib.SequenceMatcher finds them (no text of b is long enough for its junk), or -1 if they are under need.

    The longest block, of several the first in a and then in b, and so on at either side of it. A string that holds a longer one holds all its beginnings, so one
    pass over a finds the longest.
    """
    found, open_ = 0, [(a, b)]
    room = min(len(a), len(b))
    while open_:
        a, b = open_.pop()
        at = size = 0
        for i in range(len(a)):
            while i + size < len(a) and a[i : i + size + 1] in b:
                at, size = i, size + 1
        room -= min(len(a), len(b))
        if size:
            j = b.find(a[at : at + size])
            sides = [(a[:at], b[:j]), (a[at + size :], b[j + size :])]
            found += size
            room += sum(min(len(x), len(y)) for x, y in sides)
            open_ += [x for x in sides if x[0] and x[1]]
        if found + room < need:
            return -1
    return found


#: From this length of the second text on, difflib leaves out frequent characters.
JUNK = 200
CLAIMS, PAIRS, KINDS = 1 << 15, 1 << 17, 64


class Claim:
    """A claim's normal form, its words, and how many characters of each of KINDS kinds it has."""

    __slots__ = ("text", "words", "kinds")

    def __init__(self, claim: str):
        self.text = norm(claim)
        self.words = frozenset(self.text.split())
        self.kinds = np.bincount(np.frombuffer(self.text.encode("utf-32-le"), np.uint32) % KINDS, minlength=KINDS).astype(np.int32)


#: A worker meets the same claims again; what it remembers is bounded.
claim_of = functools.lru_cache(CLAIMS)(Claim)


@functools.lru_cache(PAIRS)
def at_least(a: str, b: str, least: float) -> bool:
    """Whether claim_similarity(a, b) >= least, which must be over 0; cheap bounds decide first."""
    x, y = claim_of(a), claim_of(b)
    if not x.text or not y.text:
        return False
    if x.text == y.text or len(x.words & y.words) / len(x.words | y.words) >= least:
        return True
    both = len(x.text) + len(y.text)
    if 2.0 * min(len(x.text), len(y.text)) / both < least or 2.0 * int(np.minimum(x.kinds, y.kinds).sum()) / both < least:
        return False
    if len(y.text) >= JUNK:
        return difflib.SequenceMatcher(None, x.text, y.text).ratio() >= least
    # The bound is a little low, so that rounding never decides.
    return 2.0 * _matching(x.text, y.text, math.floor(least * both / 2)) / both >= least


def may_reach(claim: str, kinds: np.ndarray, sizes: np.ndarray, words: Sequence[frozenset[str]], least: float) -> np.ndarray:
    """Places of those claims, given by their kinds, sizes and words, that at_least() can be true for: their characters, or their words, allow it."""
    x = claim_of(claim)
    chars = 2.0 * np.minimum(kinds, x.kinds).sum(1) >= (least - 1e-9) * (sizes + len(x.text))
    if not chars.all():
        for k in np.flatnonzero(~chars):
            n = len(words[k] & x.words)
            chars[k] = n >= (least - 1e-9) * (len(words[k]) + len(x.words) - n)
    return np.flatnonzero(chars)


def claim_similarity(a: str, b: str) -> float:
    """The larger of token Jaccard and the sequence ratio of the normalised texts."""
    a, b = norm(a), norm(b)
    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    return 1.0 if a == b else max(len(x & y) / len(x | y), difflib.SequenceMatcher(None, a, b).ratio())
