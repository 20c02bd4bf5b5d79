"""Order-dependent cleaning: each session (or stretch of a phrase) is folded in order, Arrow batch by Arrow batch.

What windows can say stays in windows; here results feed back into later decisions. A fold never holds a whole session: between two
batches it keeps what can still change, which each operator states. A session of any length is so one sorted stream in a task.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import KINDS, at_least, claim_of, is_long, may_reach, related, stitch, tokens
from .ledger import LAST, STATUS_RANK, THEME_CONFIDENCE, THEME_TYPE_SCORE, TYPE_RANK

#: Fixed limits, in milliseconds, rows, words and characters.
BURST_MS, BURST_WORDS, ANCHOR_WORDS = 100, 4, 6
MERGE_MS, CLOSE_MS, LOOK_BACK = 90_000, 3_000, 50
TURN_GAP_MS, TURN_MS, TURN_WORDS = 2_500, 90_000, 300
LOOP_MIN_MS, LOOP_MAX_MS, LOOP_COUNT = 20_000, 40_000, 4
GENERIC = frozenset({"дякую"})
#: Rows that leave a fold together.
OUT_ROWS = 5_000


def _runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """(key, rows) of every run of equal keys in each batch; a group that spans batches comes in several runs."""
    for rows in frames:
        if not len(rows):
            continue
        k = rows[keys]
        same = ((k == k.shift()) | (k.isna() & k.shift().isna())).all(axis=1).to_numpy()
        same[0] = False
        cuts = [*np.flatnonzero(~same), len(rows)]
        for a, z in itertools.pairwise(cuts):
            yield tuple(None if pd.isna(x) else x for x in k.iloc[a]), rows.iloc[a:z].reset_index(drop=True)


def _fold(df: DataFrame, keys: list[str], schema: str, order: list[str], f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """f on the rows of each group in order, which it gets in parts; its small results leave together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, n = [], 0
        for _, parts in itertools.groupby(_runs(frames, keys), key=lambda x: x[0]):
            for out in f(rows for _, rows in parts):
                if len(out):
                    made.append(out)
                    n += len(out)
                if n >= OUT_ROWS:
                    yield pd.concat(made, ignore_index=True)
                    made, n = [], 0
        if made:
            yield pd.concat(made, ignore_index=True)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _fold_rows(df: DataFrame, schema: str, f: Callable[[Iterator[dict]], list[dict]]) -> DataFrame:
    """f on the rows of each session, by place and item_id; small sessions share their Arrow batches, coming and going."""
    names = [c.strip("`") for c in T.StructType.fromDDL(schema).names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        kinds: dict[str, pa.DataType] = {"merged": pa.int64()}

        def rows() -> Iterator[dict]:
            for b in batches:
                kinds.update(zip(b.schema.names, b.schema.types, strict=True))
                columns = [b.column(k).to_pylist() for k in range(b.num_columns)]
                yield from (dict(zip(b.schema.names, r, strict=True)) for r in zip(*columns, strict=True))

        def batch(some: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in some], kinds[c]) for c in names], names=names)

        for _, session in itertools.groupby(rows(), key=lambda r: r["session"]):
            made += f(session)
            if len(made) >= OUT_ROWS:
                yield batch(made)
                made = []
        if made:
            yield batch(made)

    return df.repartition("session").sortWithinPartitions("session", "place", "item_id").mapInArrow(run, schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def drop_bursts(entries: DataFrame, window_ms: int = BURST_MS) -> DataFrame:
    """entries (with candidate, see clean.recent_replays) without replayed bursts.

    A burst is all rows within window_ms of its first one. Its candidates go if one of them has ANCHOR_WORDS words; else those of
    BURST_WORDS words go if there are two of them. Held between batches: the last burst.
    """

    def judged(rows: pd.DataFrame) -> tuple[np.ndarray, int]:
        """Which rows stay, and where the last burst begins."""
        start, cand = rows["start_ms"].to_numpy(), rows["candidate"].to_numpy(bool)
        n = rows["text"].map(lambda t: len(tokens(t))).to_numpy()
        keep, at, first = np.ones(len(rows), bool), 0, 0
        while at < len(rows):
            first = at
            end = int(np.searchsorted(start, start[at] + window_ms, side="right"))
            c, words = cand[at:end], n[at:end]
            some = c & (words >= BURST_WORDS)
            keep[at:end] = ~(c if (c & (words >= ANCHOR_WORDS)).any() else some if some.sum() >= 2 else np.zeros(end - at, bool))
            at = end
        return keep, first

    def f(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for rows in parts:
            held = rows if held is None else pd.concat([held, rows], ignore_index=True)
            keep, last = judged(held)
            yield held[:last][keep[:last]]
            held = held[last:].reset_index(drop=True)
        if held is not None:
            yield held[judged(held)[0]]

    return _fold(entries, ["session"], _ddl(entries), ["start_ms", "ord"], f)


def merge_related(entries: DataFrame) -> DataFrame:
    """Growing, corrected and repeated captions of one speaker as one row: the row first seen, its text and end carried on.

    A row looks back over at most LOOK_BACK results until one ended more than MERGE_MS before it; equal and fuzzy texts count within
    CLOSE_MS only. Chat and long rows that agree exactly with one before are dropped. Held between batches: LOOK_BACK rows, and 16 bytes for
    every different chat or long row of the session.
    """

    def match(row, kept: list[dict]) -> dict | None:
        for old in reversed(kept[-LOOK_BACK:]):
            age = row.start_ms - old["end_ms"]
            if age > MERGE_MS:
                return None
            if (old["speaker"], old["kind"]) != (row.speaker, row.kind) or len(row.text) < 4:
                continue
            if row.text == old["text"]:
                if age <= CLOSE_MS:
                    return old
            elif related(old["text"], row.text, age <= CLOSE_MS):
                return old
        return None

    def name(kind: str, speaker: str, text: str) -> bytes:
        return hashlib.blake2b(repr((kind, speaker, text)).encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def f(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[dict] = []
        exact: set[bytes] = set()
        for rows in parts:
            for row in rows.itertuples(index=False):
                text, notable = row.text, row.kind == "chat" or is_long(row.text)
                if notable and name(row.kind, row.speaker, text) in exact:
                    continue
                old = match(row, kept)
                if old is None:
                    kept.append(row._asdict())
                else:
                    text = old["text"] = related(old["text"], row.text, row.start_ms - old["end_ms"] <= CLOSE_MS) or max(old["text"], row.text, key=len)
                    old["end_ms"] = max(old["end_ms"], row.end_ms)
                    notable = row.kind == "chat" or is_long(text)
                if notable:
                    exact.add(name(row.kind, row.speaker, text))
            yield pd.DataFrame(kept[:-LOOK_BACK], columns=rows.columns)
            kept = kept[-LOOK_BACK:]
        if kept:
            yield pd.DataFrame(kept)

    return _fold(entries, ["session"], _ddl(entries), ["start_ms", "ord"], f)


def assemble_turns(entries: DataFrame, gap_ms: int = TURN_GAP_MS, span_ms: int = TURN_MS, words: int = TURN_WORDS) -> DataFrame:
    """Captions of one speaker in a row as turns, unless a pause, the turn's length or its words are too much, or a short reply repeats.

    Held between batches: the last turn.
    """

    def joins(turn: dict, row) -> bool:
        if turn["kind"] != "caption" or row.kind != "caption" or turn["speaker"] != row.speaker:
            return False
        if row.start_ms > turn["end_ms"] + gap_ms or row.end_ms - turn["start_ms"] > span_ms:
            return False
        new = tokens(row.text)
        short_echo = len(new) <= 3 and turn["text"].casefold() == row.text.casefold()
        return not short_echo and len(tokens(turn["text"])) + len(new) <= words

    def f(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns: list[dict] = []
        for rows in parts:
            for row in rows.itertuples(index=False):
                if turns and joins(turns[-1], row):
                    turns[-1].update(text=stitch(turns[-1]["text"], row.text), end_ms=max(turns[-1]["end_ms"], row.end_ms))
                else:
                    turns.append(row._asdict())
            yield pd.DataFrame(turns[:-1], columns=rows.columns)
            turns = turns[-1:]
        if turns:
            yield pd.DataFrame(turns)

    return _fold(entries, ["session"], _ddl(entries), ["start_ms", "ord"], f)


def looping(times: list[int]) -> set[int]:
    """Places in sorted times that lie on a chain of LOOP_COUNT and more steps of 20 to 40 seconds; longest chains, earliest ties last."""
    length, back = [1] * len(times), [-1] * len(times)
    for i, t in enumerate(times):
        for j in range(bisect.bisect_right(times, t - LOOP_MIN_MS, 0, i) - 1, bisect.bisect_left(times, t - LOOP_MAX_MS, 0, i) - 1, -1):
            if length[j] >= length[i]:
                length[i], back[i] = length[j] + 1, j
    found: set[int] = set()
    for i in range(len(times)):
        j = i if length[i] >= LOOP_COUNT else -1
        while j >= 0:
            found.add(j)
            j = back[j]
    return found


def drop_periodic(rows: DataFrame) -> DataFrame:
    """rows (session, ord, phrase, start_ms, ...) without loops of one phrase: the first stays, of generic phrases none.

    A generic phrase with eight and more looping places that are three quarters of all its places goes altogether. No chain passes a
    pause of over LOOP_MAX_MS, so a phrase is folded by the stretches between such pauses; the rest is said by windows. Held: a stretch.
    """
    named = ("loop__stretch", "loop__said", "loop__on")
    in_time = Window.partitionBy("session", "phrase").orderBy("start_ms", "ord")
    pause = F.col("start_ms") - F.lag("start_ms").over(in_time) > LOOP_MAX_MS
    d = rows.withColumn(named[0], F.sum(F.when(pause, 1).otherwise(0)).over(in_time))
    d = d.withColumn(named[1], F.count(F.lit(1)).over(Window.partitionBy("session", "phrase", named[0]))).withColumn(named[2], F.lit(False))

    def f(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(parts), ignore_index=True)
        on = np.zeros(len(g), bool)
        on[list(looping(g["start_ms"].tolist()))] = True
        yield g.assign(**{named[2]: on})

    # Stretches too short to loop need no fold.
    may = (F.col(named[1]) >= LOOP_COUNT) & (F.coalesce("phrase", F.lit("")) != "")
    d = d.where(~may).unionByName(_fold(d.where(may), ["session", "phrase", named[0]], _ddl(d), ["start_ms", "ord"], f))
    every, on = Window.partitionBy("session", "phrase"), F.col(named[2])
    n_on = F.count_if(on).over(every)
    generic = F.coalesce(F.col("phrase").isin(*GENERIC), F.lit(False))
    all_of_it = generic & (n_on >= 8) & (n_on >= 0.75 * F.count(F.lit(1)).over(every))
    first = F.row_number().over(Window.partitionBy("session", "phrase", named[2]).orderBy("start_ms", "ord")) == 1
    return d.withColumn("loop__goes", all_of_it | (on & (generic | ~first))).where(~F.col("loop__goes")).drop("loop__goes", *named)


def _order(value: int) -> int:
    return value or LAST


class Survivors:
    """Items in order, and of their claims what tells quickly which of them a new one can duplicate."""

    def __init__(self) -> None:
        self.items: list[dict] = []
        self.words: list[frozenset[str]] = []
        self.kinds, self.sizes = np.zeros((16, KINDS), np.int32), np.zeros(16, np.int64)

    def put(self, x: dict, k: int | None = None) -> None:
        """x as a new item, or in the place of the k-th."""
        if k is None:
            k = len(self.items)
            self.items.append(x)
            self.words.append(frozenset())
            if k == len(self.sizes):
                self.kinds, self.sizes = np.concatenate([self.kinds, np.zeros_like(self.kinds)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        claim = claim_of(x["claim"])
        self.items[k], self.words[k], self.kinds[k], self.sizes[k] = x, claim.words, claim.kinds, len(claim.text)

    def first(self, r: dict, least: float) -> int | None:
        """The first item that r duplicates: by claims similar by least; or equal or nested quotes of one type; or an equal quote and half-similar claims."""
        n = len(self.items)
        if not n:
            return None
        like = iter(may_reach(r["claim"], self.kinds[:n], self.sizes[:n], self.words, least).tolist())
        near = next(like, n)
        for k, x in enumerate(self.items):
            if x["type"] == r["type"] and any(p in q or q in p for p in x["quotes"] for q in r["quotes"]):
                return k
            if k == near:
                if at_least(x["claim"], r["claim"], least):
                    return k
                near = next(like, n)
            if not set(r["quotes"]).isdisjoint(x["quotes"]) and at_least(x["claim"], r["claim"], min(least, 0.58)):
                return k
        return None


def _rank(x: dict) -> tuple:
    return TYPE_RANK.get(x["type"], 0), STATUS_RANK.get(x["status"], 0), len(x["quotes"]), x["source_order"] or 0


def absorb(a: dict, b: dict) -> dict:
    best, other = (a, b) if _rank(a) >= _rank(b) else (b, a)
    union = lambda k: list(dict.fromkeys([*best[k], *other[k]]))
    orders = [x["source_order"] for x in (a, b) if x["source_order"]]
    return best | {"quotes": union("quotes"), "owners": union("owners"), "deadline": best["deadline"] or other["deadline"], "source_order": min(orders, default=0), "merged": a["merged"] + b["merged"]}


def greedy_dedup(items: DataFrame) -> DataFrame:
    """Items in order, each merged into the first survivor it duplicates: survivors change as they absorb, so chains don't merge.

    Columns session, item_id, type, status, claim, deadline, source_order, owners and quotes (normalised, not empty); merged counts the items in each.
    Held between batches: the session's survivors.
    """

    def f(rows: Iterator[dict]) -> list[dict]:
        kept = Survivors()
        for r in rows:
            r |= {"quotes": r["quotes"] or [], "owners": r["owners"] or [], "merged": 1}
            k = kept.first(r, 0.84)
            kept.put(r if k is None else absorb(kept.items[k], r), k)
        return sorted(kept.items, key=lambda x: _order(x["source_order"]))

    ready = items.withColumn("place", F.when(F.col("source_order") > 0, F.col("source_order")).otherwise(LAST))
    return _fold_rows(ready, _ddl(items) + ", merged long", f)


def diverse_selection(items: DataFrame, limit: int = 7) -> DataFrame:
    """At most limit themes a session: distinct claims, five spread evenly in time, then the best unlike those, then the earliest.

    Columns session, item_id, type, confidence, claim, source_order, quotes. Held between batches: the session's distinct claims.
    """

    def score(x: dict) -> tuple:
        return THEME_CONFIDENCE.get(x["confidence"], 2), THEME_TYPE_SCORE.get(x["type"], 0), len(x["quotes"])

    def f(rows: Iterator[dict]) -> list[dict]:
        kept = Survivors()
        for r in rows:
            r["quotes"] = r["quotes"] or []
            k = kept.first(r, 0.80)
            if k is None or score(r) > score(kept.items[k]):
                kept.put(r, k)
        distinct = kept.items
        if len(distinct) > limit:
            spots = min(5, limit)
            chosen = list(dict.fromkeys(round(i * (len(distinct) - 1) / max(1, spots - 1)) for i in range(spots)))
            for k in sorted(range(len(distinct)), key=lambda k: score(distinct[k]), reverse=True):
                if len(chosen) < limit and k not in chosen and not any(at_least(distinct[k]["claim"], distinct[c]["claim"], 0.72) for c in chosen):
                    chosen.append(k)
            chosen += [k for k in range(len(distinct)) if k not in chosen][: limit - len(chosen)]
            distinct = [distinct[k] for k in chosen]
        return sorted(distinct, key=lambda x: (_order(x["source_order"]), x["item_id"]))

    live = items.where(F.col("type").isin(*THEME_TYPE_SCORE) & (F.trim("claim") != "")).withColumn("place", F.when(F.col("source_order") > 0, F.col("source_order")).otherwise(LAST))
    kinds = dict(items.dtypes)
    return _fold_rows(live, f"session {kinds['session']}, item_id {kinds['item_id']}", f)


def pack_lines(lines: DataFrame, limit: int) -> DataFrame:
    """lines (session, ord, text) with chunk: lines in order, a new chunk where the next one (and its line end) would pass limit characters.

    Held between batches: the chunk's number and size.
    """

    def f(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, size = 0, 0
        for rows in parts:
            out = []
            for n in rows["text"].str.len().to_numpy() + 1:
                if size and size + n > limit:
                    chunk, size = chunk + 1, 0
                size += n
                out.append(chunk)
            yield rows.assign(chunk=out)

    return _fold(lines, ["session"], _ddl(lines) + ", chunk long", ["ord"], f)
