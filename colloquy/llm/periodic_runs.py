"""Periodic runs of words, found by catching squares online.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends; those of LEAST words and
LEAST_TIMES periods and more count. Words are appended in order. For each power of two b, every completed block of b words has a catcher:
each appended word completes a suffix of b words, and that suffix is compared (by hash) with the block that began b to 2b-1 words
before it. When two blocks in a row recur at the same distance q, a square of period q is caught. A new square within a run of a
smaller period adds nothing; any other one opens a run, which grows with the words appended until one breaks its period. Every run of 4q words holds two such
blocks of the greatest b up to q, so none is missed, and only the first two of a run report it, so one report makes one run.

One document costs n log n comparisons, a stretch of equal words no more than any other text. The documents of an Arrow batch are appended
together as arrays, a word of its own between any two, so no run crosses from one to the next. Runs are confirmed on the words themselves.

Each document is judged by itself, in one task; there is no shuffle. Null or blank texts have no words and no runs. Repeated rows and null ids are rows as any other. Very
long texts are whole in one task's memory, at about 40 bytes a word. Other columns stay behind, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents, keyed_text, mix, random_words, text_groups, word_hashes, words

LEAST, LEAST_TIMES = 6, 4
#: Windows of a level that stay for the next append, in block lengths.
TAIL = 10
_PAIR = random_words(401, 1)[0]
_BREAK = random_words(402, 1)[0]


class SquareCatcher:
    """Runs of the words appended so far; append() takes any number of word hashes at a time."""

    def __init__(self) -> None:
        self.words = np.zeros(0, np.uint64)
        self.reach = self.words.astype(np.int64)  # the farthest end of a run that holds the word, of runs opened by this append
        self.levels: list[tuple[int, np.ndarray]] = []  # of b = 1, 2, 4, ...: the first window kept, hashes of windows of b words
        self.open: list[list[int]] = []  # start and period of runs that hold the last word
        self.grown: list[tuple[int, int, int]] = []  # start, end and period of those that were open before this append
        self.closed: list[tuple[int, int, int]] = []

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) by start, then period."""
        found = [*self.closed, *((s, len(self.words) - s, q) for s, q in self.open)]
        return sorted(r for r in found if r[1] >= max(LEAST, LEAST_TIMES * r[2]))

    def append(self, h: np.ndarray) -> None:
        before, self.words = len(self.words), np.concatenate([self.words, h])
        self.reach = np.zeros(len(self.words), np.int64)
        self.grown, self.open = [(start, self._right(before, q), q) for start, q in self.open], []
        for r in self.grown:
            self._hold(*r)
        below, level, b = (0, mix(self.words[:0])), 0, 1
        while LEAST_TIMES * b <= len(self.words):
            below = self._advance(level, b, before, below)
            level, b = level + 1, 2 * b
        for k, (first, w) in enumerate(self.levels):
            extra = max(0, len(w) - (TAIL << k))
            self.levels[k] = first + extra, w[extra:].copy()

    def _advance(self, level: int, b: int, before: int, below: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
        """Completes the windows of b words that the appended words end, and catches squares of periods b to 2b-1."""
        first, w = self.levels[level] if level < len(self.levels) else (0, np.zeros(0, np.uint64))
        new = first + len(w)  # the first window not yet seen
        if level == 0:
            w = np.concatenate([w, mix(self.words[new:])])
        else:
            lower_first, lower = below
            left = lower[new - lower_first : len(self.words) - b + 1 - lower_first]
            w = np.concatenate([w, mix(left * _PAIR + lower[new + b // 2 - lower_first :])])
        if level < len(self.levels):
            self.levels[level] = first, w
        else:
            self.levels.append((first, w))
        at = np.arange(max(new, 2 * b), first + len(w))  # a suffix whose block has another before it
        block = (at // b - 1) * b
        hit = w[at - first] == w[block - first]
        at, block = at[hit], block[hit]
        again = w[at - b - first] == w[block - b - first]
        at, block = at[again], block[again]
        inner = np.flatnonzero(block >= 2 * b)
        known = inner[w[at[inner] - 2 * b - first] == w[block[inner] - 2 * b - first]]
        fresh = np.ones(len(at), bool)
        fresh[known] = False
        for j, s in zip(at[fresh].tolist(), block[fresh].tolist(), strict=True):
            q, start = j - s, s - b
            if self.reach[start] < j + b and not any(r[0] <= start and r[1] >= j + b and r[2] <= q for r in self.grown):
                first_word, end = self._left(start, q), self._right(j + b, q)
                self._hold(first_word, end, q)
                self.reach[first_word:end] = np.maximum(self.reach[first_word:end], end)
        return first, w

    def _hold(self, start: int, end: int, q: int) -> None:
        if end == len(self.words):
            self.open.append([start, q])
        else:
            self.closed.append((start, end - start, q))

    def _right(self, end: int, q: int) -> int:
        """The first word from `end` on that is not the one q before it."""
        step = 16
        while end < len(self.words):
            differ = np.flatnonzero(self.words[end : end + step] != self.words[end - q : min(end + step, len(self.words)) - q])
            if len(differ):
                return end + int(differ[0])
            end, step = min(end + step, len(self.words)), step * 2
        return end

    def _left(self, start: int, q: int) -> int:
        step = 16
        while start > 0:
            low = max(0, start - step)
            differ = np.flatnonzero(self.words[low:start] != self.words[low + q : start + q])
            if len(differ):
                return low + int(differ[-1]) + 1
            start, step = low, step * 2
        return start


def runs_of_texts(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs of each of some texts laid end to end, places counted in words of the text."""
    h, own = word_hashes(data, offsets)
    texts = len(offsets) - 1
    apart = np.full(len(h) + texts, 0, np.uint64)
    apart[np.arange(len(h)) + own] = h
    first = np.searchsorted(own, np.arange(texts)) + np.arange(texts)
    ends = np.append(first[1:] - 1, len(apart) - 1)
    apart[ends] = mix(np.arange(texts, dtype=np.uint64) + _BREAK)
    c = SquareCatcher()
    c.append(apart)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(texts)]
    for start, length, q in c.runs():
        k = int(np.searchsorted(first, start, side="right")) - 1
        found[k].append((start - int(first[k]), length, q))
    return found


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The greatest length/period, compared as fractions; ties to the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def periodic_runs(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_runs, n_dropped, the strongest run, all runs and the digests; with texts also the words that stay, joined by spaces.

    A word is dropped if a run holds it after that run's first period.
    """
    bounded_batches(docs.sparkSession)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    longs = ("n_words", "n_runs", "n_dropped", "start", "length", "period", "exponent_milli")
    names = ["doc_id", *longs, "runs_sha256", "collapsed_sha256", "runs", *(["collapsed"] if texts else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: dict[str, list] = {n: [] for n in names[1:]}
            rows = b.column(1).to_pylist()
            for first, last, data, offsets in text_groups(b):
                for text, runs in zip(rows[first:last], runs_of_texts(data, offsets), strict=True):
                    w = words(text)
                    runs = [(s, n, q) for s, n, q in runs if w[s : s + n - q] == w[s + q : s + n]]
                    kept = w
                    if runs:
                        edge = np.zeros(len(w) + 1, np.int64)
                        for s, n, q in runs:
                            edge[s + q] += 1
                            edge[s + n] -= 1
                        kept = list(compress(w, (np.cumsum(edge)[:-1] == 0).tolist()))
                    joined = b" ".join(kept)
                    s, n, q = strongest(runs) or (None, None, None)
                    said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    out = (len(w), len(runs), len(w) - len(kept), s, n, q, 1000 * n // q if runs else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(joined).hexdigest(), [{"start": s, "length": n, "period": q} for s, n, q in runs], joined)
                    for name, x in zip(names[1:], out, strict=False):
                        columns[name].append(x)
            types = [pa.int64()] * len(longs) + [pa.string(), pa.string(), run_type] + [pa.binary()] * texts
            arrays = [pa.array(columns[n], t) for n, t in zip(names[1:], types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(a.cast(pa.string()) if a.type == pa.binary() else a for a in arrays)], names=names)

    schema = ", ".join(["doc_id long", *(f"{n} long" for n in longs), "runs_sha256 string", "collapsed_sha256 string", "runs array<struct<start: long, length: long, period: long>>", *(["collapsed string"] if texts else [])])
    return keyed_text(docs).mapInArrow(run, schema)


def with_planted_loops(docs: DataFrame, share: int = 10) -> DataFrame:
    """docs in which every document with crc32(doc_id) divisible by `share` repeats a stretch of its words to the end; the others, and those without id or words, are as before."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def loop(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / share)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        return F.concat(F.slice(w, 1, a), F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), 1, n - a))

    text = F.col("text").cast("string")
    found = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    # Bound once as a lambda's argument: the split is not repeated where its words are used.
    planted = F.transform(F.array(found), lambda w: F.when(F.size(w) > 0, F.array_join(loop(w), " ")))[0]
    return docs.withColumn("text", F.when(h % share == 0, F.coalesce(planted, text)).otherwise(text))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_loops(documents(spark, sf_dir).select("doc_id", "text")))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words", "n_dropped")
