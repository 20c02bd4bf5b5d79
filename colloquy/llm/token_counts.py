"""Token counts by prefix dynamic programming.

A byte-level BPE cuts a text into pieces by a pattern and merges inside each piece only. Inside a piece the last token of a prefix
decides everything: among the vocabulary's strings that end there, exactly one, t, stands after the encoding of what is before it,
and that can be told from t and the last token before it alone. So last[i] and count[i] = count[i - len(t)] + 1 follow from smaller
prefixes, and one pass over a piece gives the count at every prefix of it. The counts of a text are those of its pieces, added up.

The table holds the exact count of text[:k] for every k. The library is not asked: totals, truncation and budget questions read the
table. A cut may change how the pattern splits the end of a prefix; it does so in three ways only, which the table has: in a run of
white space, in a contraction, and in a special string.

Null texts count as empty (0 tokens). Rows are independent: repeated rows, null and repeated doc_id, ties and other columns (whatever
their names) don't matter, and an empty table gives an empty result. A very long text is one row of its own size, never cut.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents

#: About how many bytes of pieces and their steps a worker remembers, once as new and once as older ones.
CACHE_BYTES = 48 << 20
#: Pairs of tokens of which a worker remembers whether they may stand side by side.
MOST_PAIRS = 400_000
LIMIT = 1024
_STEP = np.dtype("<i4")


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if printable, else one from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Merges:
    """The merges of a BPE vocabulary, read backwards: which two tokens may stand side by side. Tokens are numbered here."""

    def __init__(self, merges: list):
        import ahocorasick

        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        number = {c: k for k, c in enumerate(byte_letters().values())}
        #: Of each token the rank of the merge that made it (-1 for a byte), and what was merged.
        self.made, self.left, self.right = [-1] * len(number), [-1] * len(number), [-1] * len(number)
        self.rank: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        for k, (a, b) in enumerate(pairs):
            self.rank[number[a] << 24 | number[b]] = k
            if a + b not in number:
                number[a + b] = len(self.made)
                self.made.append(k)
                self.left.append(number[a])
                self.right.append(number[b])
        self.ends_with = ahocorasick.Automaton()
        alone: dict[int, bool] = {}
        for token, k in sorted(number.items(), key=lambda x: len(x[0])):
            # Whether the encoding of a token's own string is that token.
            a, b = self.left[k], self.right[k]
            alone[k] = a < 0 or (alone[a] and alone[b] and self._apart(a, b, self.made[k]))
            if alone[k]:
                self.ends_with.add_word(token, (k, len(token)))
        self.ends_with.make_automaton()

    def _apart(self, a: int, b: int, before: int = 1 << 40) -> bool:
        """Whether no merge crosses the border of a and b before the merge of rank `before`.

        The tokens' own merges are undone, the latest first. What then touches the border would have merged if that pair's rank
        were lower than the merge just undone, or equal on the left of it, since the leftmost of equal merges goes first.
        """
        rank, made = self.rank, self.made
        while rank.get(a << 24 | b, before) >= before:
            if made[a] > made[b]:
                before, a = made[a], self.right[a]
            elif made[b] >= 0:
                before, b = made[b] + 1, self.left[b]
            else:
                return True
        return False

    def prefix_counts(self, s: str) -> list[int]:
        """Tokens of s[:i] for every i."""
        last, count, pairs = [-1] * len(s) + [-1], [0] * (len(s) + 1), self.pairs
        for end, (t, size) in self.ends_with.iter(s):  # every token that ends at each place, place by place
            end += 1
            if last[end] < 0:
                at = end - size
                if at:
                    key = last[at] << 24 | t
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= MOST_PAIRS:
                            pairs.clear()
                        fits = pairs[key] = self._apart(last[at], t)
                    if not fits:
                        continue
                last[end], count[end] = t, count[at] + 1
        return count


class _Steps(dict):
    """piece -> how much each of its characters changes the count, as packed integers."""

    def __init__(self, merges: Merges):
        self.merges, self.letters, self.held = merges, byte_letters(), 0
        self.older: dict[str, bytes] = {}

    def counts(self, piece: str) -> list[int]:
        """Tokens of piece[:i] for every i in characters, the piece taken as one."""
        raw = piece.encode()
        found = self.merges.prefix_counts(raw.decode("latin-1").translate(self.letters))
        if len(raw) == len(piece):
            return found
        return [found[k] for k in accumulate((len(c.encode()) for c in piece), initial=0)]

    def __missing__(self, piece: str) -> bytes:
        if self.held > CACHE_BYTES:  # what isn't asked for again in time goes
            self.older, self.held = dict(self), 0
            self.clear()
        self.held += 5 * len(piece) + 150
        if (steps := self.older.get(piece)) is not None:
            self[piece] = steps
            return steps
        counts = self.counts(piece)
        if len(piece) == 3 and piece[0] == "'" and piece[1:].isalpha():  # a contraction cut in two is two pieces
            counts[2] = counts[1] + self.counts(piece[1])[1]
        steps = self[piece] = array("i", map(sub, counts[1:], counts)).tobytes()
        return steps


class PrefixCounter:
    """Exact counts at the prefixes of texts, for one byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, name: str):
        import public_tokenizers

        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            spec = json.load(file)
        if (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{name} is not a plain byte-level BPE")
        # The library takes special strings inside a text as one token each and cuts the text there.
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.gaps = regex.compile(r"\s{2,}(?=\S)").finditer
        self.steps = _Steps(Merges(spec["model"]["merges"]))

    def _whole(self, piece: str) -> int:
        return 1 if piece in self.special else int(np.frombuffer(self.steps[piece], _STEP).sum())

    def _plain(self, text: str) -> np.ndarray:
        """Counts after every character of a text without special strings."""
        out = np.cumsum(np.frombuffer(b"".join(map(self.steps.__getitem__, self.pieces(text))), _STEP), dtype=np.int64)
        for gap in self.gaps(text):
            # The pattern leaves a run's last character to what follows; a prefix that ends there has the run whole.
            before = int(out[gap.start() - 1]) if gap.start() else 0
            out[gap.end() - 1] = before + self._whole(gap[0])
        return out

    def table(self, text: str | None) -> np.ndarray:
        """Element k is the token count of text[:k]."""
        zero = np.zeros(1, np.int64)
        if not text:
            return zero
        if self.cut is None or not any(s in text for s in self.special):
            return np.concatenate([zero, self._plain(text)])
        parts, total, before = [zero], 0, ""
        for k, part in enumerate(self.cut(text)):
            if k % 2:
                # Cut inside a special string, its letters are plain text and may join the piece before them.
                last = self.pieces(before)[-1] if before else ""
                base = total - (self._whole(last) if last else 0)
                inside = [base + sum(self._whole(p) for q in self.cut(last + part[:n]) if q for p in ([q] if q in self.special else self.pieces(q))) for n in range(1, len(part))]
                parts.append(np.array([*inside, total + 1], np.int64))
            elif part:
                parts.append(total + self._plain(part))
            before = "" if k % 2 else part
            total = int(parts[-1][-1])
        return np.concatenate(parts)

    @staticmethod
    def within(table: np.ndarray, budget: int) -> int:
        """Characters of the longest prefix whose own count is within the budget (none below 0)."""
        if table[-1] <= budget:
            return len(table) - 1
        fits = np.flatnonzero(table <= budget)
        return int(fits[-1]) if len(fits) else 0


@lru_cache(maxsize=4)
def counter(name: str) -> PrefixCounter:
    return PrefixCounter(name)


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = LIMIT, prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars (characters of the longest prefix of at most `limit` tokens).

    With prefixes also tokens_at: the count of every prefix, from the empty one to the whole text.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", tokens_at array<long>" * prefixes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(name)
        for b in batches:
            n, fit, tables = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), []
            for i, t in enumerate(b.column(1)):
                table = c.table(t.as_py())
                n[i], fit[i] = table[-1], c.within(table, limit)
                if prefixes:
                    tables.append(table)
            more = [pa.array(tables, pa.list_(pa.int64()))] if prefixes else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(n > limit), pa.array(fit), *more], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).mapInArrow(count, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
