"""Suffix-array dedup: long byte strings that start anywhere else, found by a family of suffix arrays of geometric sizes.

The suffixes indexed are those at anchors. Every string of LENGTH bytes has one anchor: the start of its least hashed
KEY bytes, so equal strings have their anchors at the same place, and a suffix array of anchors sees all of them.

1. Documents come in batches. A batch gets its suffix array: its anchored suffixes, sorted, with their numbers. It is merge-scanned
   (a sort-merge join) against every existing level for suffixes that agree with its own, then becomes a level itself;
   two levels of equal rank merge into one of the next.
2. For anchors whose suffix was matched, the strings around them are fetched from the texts, brought together by suffix, and
   compared at every start by two independent 64-bit hashes of all LENGTH bytes. Only this check decides.
3. Bytes that a repeated string covers are cut.

The matched suffixes are told to the tasks as a bitmap of at most MOST_BITS cells, a size bound that only lets more anchors
through to step 2 when there are more. Tasks settle equal surroundings among themselves and send one of each; suffixes found
over HOT times go by their single strings, not as a group, so nothing large meets in one task.

Null text is empty. Rows that repeat are two documents: all they share is cut from both. Texts shorter than LENGTH stay whole.
A null doc_id is a document like any other. Other columns, whatever their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents, keyed_text, mix, random_words, written

LENGTH, KEY = 400, 32
BATCHES = 4
HOT = 20_000
LEAST_BITS, MOST_BITS = 20, 29
BLOCK_BITS = 20
#: Bytes worked on at once; a longer text goes in parts that overlap by LENGTH - 1 bytes.
PART = 1 << 20
#: Bytes of surroundings that a task holds before it sends what it has.
FLUSH = 24 << 20
_BYTE = random_words(401, 256)
_BASE = random_words(402, 1)[0]
#: A second hash that has nothing in common with the first.
_BYTE2, _BASE2 = random_words(403, 256), random_words(404, 1)[0] | np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)


def power(n: int, base: np.uint64 = _BASE) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def string_hashes(data: np.ndarray, length: int, byte: np.ndarray = _BYTE, base: np.uint64 = _BASE) -> np.ndarray:
    """A polynomial hash of the `length` bytes from every place on: strings of twice the length join two of half."""
    out, have, h, size = None, 0, byte[data], 1
    while size <= length:
        if length & size:
            # What is joined so far covers the bytes before this part.
            out = h if out is None else out[: max(0, len(data) - have - size + 1)] * power(size, base) + h[have : have + max(0, len(data) - have - size + 1)]
            have += size
        if size * 2 <= length:
            h = h[: max(0, len(h) - size)] * power(size, base) + h[size:]
        size *= 2
    return out if len(data) >= length else np.zeros(0, np.uint64)


def least_in_windows(keys: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    rest = width - size
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor, hash of the anchor's KEY bytes) of runs of strings with a common anchor, in texts laid end to end."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64)
    h = string_hashes(data, KEY)
    keys = (mix(h) & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    chosen = (least_in_windows(keys, length - KEY + 1) & _PLACE).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int8)
    low, high = offsets[:-1], offsets[1:] - length + 1
    ok = high > low
    np.add.at(inside, low[ok], 1)
    np.add.at(inside, high[ok], -1)
    starts = np.flatnonzero(np.cumsum(inside)[: len(chosen)])
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64)
    chosen = chosen[starts]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last], chosen[first], h[chosen[first]]


def parts(texts: list[bytes | None], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each part, its place in the text, bytes, offsets) with about PART bytes together."""
    rows, places, held, size = [], [], [], 0

    def out() -> tuple[np.ndarray, ...]:
        return np.array(rows), np.array(places), np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)

    for i, t in enumerate(texts):
        if not t or len(t) < length:
            continue
        for at in range(0, len(t) - length + 1, PART):
            rows.append(i)
            places.append(at)
            held.append(t[at : at + PART + length - 1])
            size += len(held[-1])
            if size >= PART:
                yield out()
                rows, places, held, size = [], [], [], 0
    if rows:
        yield out()


def suffixes(docs: DataFrame, length: int, batches: int) -> DataFrame:
    """(batch, suffix, n): the anchored suffixes of each batch, to KEY bytes, counted by task."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow:
            found: dict[tuple[int, bytes], int] = {}
            group = b.column(1).to_numpy()
            for rows, _, data, offsets in parts(b.column(0).to_pylist(), length):
                _, _, x, _ = anchors(data, offsets, length)
                of = group[rows[np.searchsorted(offsets, x, side="right") - 1]].tolist()
                raw = data.tobytes()
                for g, at in zip(of, x.tolist(), strict=True):
                    key = (g, raw[at : at + KEY])
                    found[key] = found.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.binary()), pa.array(list(found.values()), pa.int64())], names=["batch", "suffix", "n"])

    d = docs.select(F.col("text").cast("string").cast("binary").alias("text"), F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.lit(batches)).cast("int").alias("batch"))
    return d.mapInArrow(run, "batch int, suffix binary, n long")


class IndexFamily:
    """Levels of sorted suffixes; level r holds about 2 ** r batches."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    @staticmethod
    def sorted_suffixes(rows: DataFrame) -> DataFrame:
        """A suffix array: (suffix, n) in the order of the suffixes, in ranges."""
        return written(rows.groupBy("suffix").agg(F.sum("n").alias("n")).repartitionByRange("suffix").sortWithinPartitions("suffix"), "suffixes")

    def scan(self, batch: DataFrame) -> DataFrame:
        """(suffix, n) of the batch's suffixes that occur twice, in it or in it and the levels; n counts both."""
        hits = [batch.hint("merge").join(level.withColumnRenamed("n", "before"), "suffix") for _, level in self.levels]
        both = reduce(DataFrame.unionByName, [batch.withColumn("before", F.lit(0).cast("long")), *hits]) if hits else batch.withColumn("before", F.lit(0).cast("long"))
        return both.groupBy("suffix").agg((F.max("n") + F.sum("before")).alias("n")).where("n > 1")

    def insert(self, batch: DataFrame) -> None:
        rank = 0
        merged = [batch]
        while self.levels and self.levels[-1][0] == rank:
            merged.append(self.levels.pop()[1])
            rank += 1
        self.levels.append((rank, batch if len(merged) == 1 else self.sorted_suffixes(reduce(DataFrame.unionByName, merged))))


def matched_suffixes(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """(suffix, n): all anchored suffixes that occur more than once, by one pass of the batches through the family."""
    table = written(suffixes(docs, length, batches), "anchors", "batch")
    family, found = IndexFamily(), []
    for k in range(batches):
        batch = family.sorted_suffixes(table.where(F.col("batch") == k).select("suffix", "n"))
        found.append(family.scan(batch))
        if k < batches - 1:  # nothing is scanned after the last one
            family.insert(batch)
    return written(reduce(DataFrame.unionByName, found).groupBy("suffix").agg(F.max("n").alias("n")), "matched")


def bitmaps(matched: DataFrame, hot: int) -> tuple[int, np.ndarray]:
    """bits, and two bitmaps of 2 ** bits cells: of the matched suffixes' hashes, and of those found more than `hot` times."""
    bits = int(np.clip(np.ceil(np.log2(max(1, matched.count()) * 64)), LEAST_BITS, MOST_BITS))
    block = min(BLOCK_BITS, bits)

    def mark(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow:
            if not b.num_rows:
                continue
            h = string_hashes(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8), KEY)[::KEY]
            c = cells_of(h, bits)
            yield pa.RecordBatch.from_arrays([pa.array((c >> block).astype(np.int32)), pa.array((c & ((1 << block) - 1)).astype(np.int32)), b.column(1)], names=["block", "cell", "hot"])

    def fill(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if at is not None:
                packed = [np.packbits(s, bitorder="little").tobytes() for s in seen]
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([p], pa.binary()) for p in packed)], names=["block", "matched", "hot"])

        for b in arrow:
            blocks, cell, is_hot = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            for k in np.unique(blocks).tolist():
                if k != at:
                    yield from done()
                    at, seen = k, np.zeros((2, 1 << block), bool)
                seen[0, cell[blocks == k]] = True
                seen[1, cell[(blocks == k) & is_hot]] = True
        yield from done()

    cells = matched.select("suffix", (F.col("n") > hot).alias("hot")).mapInArrow(mark, "block int, cell int, hot boolean")
    out = np.zeros((2, 1 << (bits - block), max(1, (1 << block) // 8)), np.uint8)
    for r in cells.repartition("block").sortWithinPartitions("block").mapInArrow(fill, "block int, matched binary, hot binary").toLocalIterator():
        out[0, r["block"]], out[1, r["block"]] = np.frombuffer(r["matched"], np.uint8), np.frombuffer(r["hot"], np.uint8)
    return bits, out.reshape(2, -1)


def cells_of(h: np.ndarray, bits: int) -> np.ndarray:
    """Cells by another hash than the one that picks anchors: that one is small at every anchor."""
    return (mix(h * _BASE + np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int64)


def _holds(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


_ROWS = "g long, tag long, doc_id long, th long, start long, n int, around binary, sure boolean"


def surroundings(docs: DataFrame, length: int, bits: int, marks: np.ndarray) -> DataFrame:
    """Rows of _ROWS: the bytes around each anchor with a matched suffix, or the hashes of its strings where the suffix is hot.

    n strings start at `start` and after it. Of rows that agree in all bytes a task sends one, and the others as sure, without bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matched, hot = shared.value
        # what was sent of each surroundings: key -> row number, to mark it sure when it comes again
        seen: dict[tuple, int] = {}
        rows: list[list] = []
        size = 0

        def add(key: tuple, row: list) -> None:
            nonlocal size
            if (k := seen.get(key)) is None:
                seen[key] = len(rows)
                size += len(row[6] or b"") + 64
            else:
                rows[k][7] = True
                # A sure row meets nobody: it goes under a number of its own.
                row[0], row[6], row[7] = hash((row[2], row[3], row[4])), None, True
                size += 64
            rows.append(row)

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for low in range(0, len(rows), 4000):
                cut = list(zip(*rows[low : low + 4000], strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cut, kinds, strict=True)], names=[x.split()[0] for x in _ROWS.split(", ")])
            rows.clear()
            seen.clear()
            size = 0

        for b in arrow:
            ids, ths = b.column(0).to_pylist(), b.column(2).to_pylist()
            for row, place, data, offsets in parts(b.column(1).to_pylist(), length):
                first, last, _, h = anchors(data, offsets, length)
                cell = cells_of(h, bits)
                may = np.flatnonzero(_holds(matched, cell))
                if not len(may):
                    continue
                of = np.searchsorted(offsets, first[may], side="right") - 1
                g, is_hot, raw = mix(h[may]).view(np.int64).tolist(), _holds(hot, cell[may]), data.tobytes()
                for k, i in enumerate(may.tolist()):
                    r, low, high = int(row[of[k]]), int(first[i]), int(last[i])
                    start = int(place[of[k]]) + low - int(offsets[of[k]])
                    around = raw[low : high + length]
                    if not is_hot[k]:
                        add((g[k], around), [g[k], 0, ids[r], ths[r], start, high - low + 1, around, False])
                        continue
                    data_of = np.frombuffer(around, np.uint8)
                    both = mix(string_hashes(data_of, length)), mix(string_hashes(data_of, length, _BYTE2, _BASE2))
                    for j, (s, t) in enumerate(zip(*(x.view(np.int64).tolist() for x in both), strict=True)):
                        add((s, t), [s, t, ids[r], ths[r], start + j, 1, None, False])
                if size >= FLUSH:
                    yield from send()
        yield from send()

    return keyed_text(docs, F.xxhash64("text").alias("th")).mapInArrow(run, _ROWS)


def repeated_starts(found: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, start, n): runs of n string starts that are repeated."""

    def settle(g: np.ndarray, tag: np.ndarray, doc: list, th: list, start: np.ndarray, n: np.ndarray, around: list, sure: np.ndarray) -> Iterator[pa.RecordBatch]:
        hit: list[tuple] = [(doc[i], th[i], int(start[i]), int(n[i])) for i in np.flatnonzero(sure)]
        text = [i for i in range(len(g)) if around[i] is not None]
        single = np.array([i for i in range(len(g)) if around[i] is None and n[i] == 1 and not (sure[i] and tag[i] == 0)], np.int64)
        if len(single):
            # strings of hot suffixes: their own hash is the group
            order = single[np.lexsort((tag[single], g[single]))]
            same = (g[order][1:] == g[order][:-1]) & (tag[order][1:] == tag[order][:-1])
            twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            hit += [(doc[i], th[i], int(start[i]), 1) for i in order[twice & ~sure[order]].tolist()]
        if text:
            data = np.frombuffer(b"".join(around[i] for i in text), np.uint8)
            sizes = np.array([len(around[i]) for i in text])
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            starts_of = n[text].astype(np.int64)
            own = np.repeat(np.arange(len(text)), starts_of)
            at = np.repeat(begins, starts_of) + np.arange(len(own)) - np.repeat(np.cumsum(starts_of) - starts_of, starts_of)
            key = mix(mix(string_hashes(data, length)[at]) ^ g[text].view(np.uint64)[own])
            tell = string_hashes(data, length, _BYTE2, _BASE2)[at]
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            if (tell[order][1:] != tell[order][:-1])[same].any():  # different strings of one hash
                order = np.lexsort((tell, key))
                same = (key[order][1:] == key[order][:-1]) & (tell[order][1:] == tell[order][:-1])
            twice = np.zeros(len(key), bool)
            twice[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            # runs of repeated starts, broken where the surroundings change
            edge = np.flatnonzero(np.diff(np.concatenate([[0], twice, [0]]).astype(np.int8)))
            run_low, run_high = edge[::2], edge[1::2]
            for low, high in zip(run_low.tolist(), run_high.tolist(), strict=True):
                while low < high:
                    o = int(own[low])
                    stop = min(high, int(np.searchsorted(own, o, side="right")))
                    i = text[o]
                    if not sure[i]:
                        hit.append((doc[i], th[i], int(start[i]) + int(at[low] - begins[o]), stop - low))
                    low = stop
        if hit:
            cols = list(zip(*hit, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "th", "start", "n"])

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in arrow:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 2000:
                continue
            g = held["g"].to_numpy()
            whole = int(np.searchsorted(g, g[-1]))  # rows of the last suffix wait for more
            if whole:
                yield from out(held.slice(0, whole))
                held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield from out(held)

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        return settle(t["g"].to_numpy(), t["tag"].to_numpy(), t["doc_id"].to_pylist(), t["th"].to_pylist(), t["start"].to_numpy(), t["n"].to_numpy(), t["around"].to_pylist(), t["sure"].to_numpy())

    return found.repartition("g").sortWithinPartitions("g").mapInArrow(run, "doc_id long, th long, start long, n long")


def dedup_bytes(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, hot: int = HOT, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, has_repeats (some byte was cut), and with texts the kept bytes; one row per document."""
    bounded_batches(docs.sparkSession)
    bits, marks = bitmaps(matched_suffixes(docs, length, batches), hot)
    runs = repeated_starts(surroundings(docs, length, bits, marks), length)
    cuts = runs.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n")).alias("cut")).select(F.col("doc_id").alias("cut_id"), F.col("th").alias("cut_th"), "cut")
    d = keyed_text(docs, F.xxhash64("text").alias("th"))
    j = d.join(cuts, d["doc_id"].eqNullSafe(F.col("cut_id")) & (d["th"] == F.col("cut_th")), "left").select("doc_id", "text", F.col("cut.start").alias("start"), F.col("cut.n").alias("n"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "has_repeats", *(["kept"] if texts else [])]

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow:
            size, gone, spans, sha, kept = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                text = text or b""
                out, lost, n_spans = text, 0, 0
                if b.column(2)[i].is_valid:
                    start, n = b.column(2)[i].values.to_numpy(), b.column(3)[i].values.to_numpy()
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, np.minimum(start + n - 1 + length, len(text)), -1)
                    cut = np.cumsum(edge)[:-1] > 0
                    lost, n_spans = int(cut.sum()), int((cut & ~np.concatenate([[False], cut[:-1]])).sum())
                    out = np.frombuffer(text, np.uint8)[~cut].tobytes()
                size.append(len(text))
                gone.append(lost)
                spans.append(n_spans)
                sha.append(hashlib.sha256(out).hexdigest())
                kept.append(out)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (size, gone, spans)), pa.array(sha, pa.string()), pa.array([len(x) for x in kept], pa.int64()), pa.array([x > 0 for x in gone], pa.bool_()), *([pa.array(kept, pa.binary())] if texts else [])], names=names)

    return j.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, has_repeats boolean" + ", kept binary" * texts)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(documents(spark, sf_dir))
