"""Substring dedup: windows of words that also start in a document with a smaller id.

1. Every task counts its windows into a count-min sketch of two rows, and the sketches are merged: a window that starts
   in two documents has both its cells at 2 or more, so an estimate below 2 is always right.
2. Windows estimated repeated, and no others, are grouped exactly by an 80-bit hash: each group's smallest doc_id keeps them.
3. Words that a removed window covers are cut from their text.

The sketch has a cell for every CELL_BYTES bytes of text, up to MOST_CELLS a row (the repeated ones make a bitmap of 64 MB in all,
which is what is broadcast); beyond that more windows go through step 2 and none is lost. A task resolves its own repeats first and sends one
row of each window, so a passage in a third of all documents gives a row per task and not per document.

Null text has no words. A null doc_id is smaller than none and larger than none: its text stays whole and removes nothing.
Rows that repeat a doc_id don't remove from each other. Equal words everywhere, long texts and empty tables are no special case.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, documents, keyed_text, mix, random_words, text_groups, word_hashes, words

WINDOW = 13
ROWS = 2
CELL_BYTES = 4
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 28
BLOCK_BITS = 20
#: Windows that a task holds before it sends what it has: as cells, and as candidates, which take more memory each.
FLUSH, FLUSH_CANDIDATES = 1 << 22, 1 << 21
#: A candidate's second hash (the low 16 bits), whether it is sure and its first word share one long, to keep the shuffle small.
TAG, SURE, AT = (1 << 16) - 1, 16, 17
_ROW = random_words(301, 4)


def multipliers(window: int) -> tuple[np.ndarray, np.ndarray]:
    return random_words(201, window), random_words(202, window)


def windows(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, the text and the first word of each window of some texts laid end to end."""
    h, own = word_hashes(data, offsets)
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k, (p, q) in enumerate(zip(*multipliers(window), strict=True)):
        part = h[k : k + n]
        a += part * p
        b += part * q
    whole = own[:n] == own[window - 1 :]
    first = np.searchsorted(own, np.arange(len(offsets)))
    at = np.arange(n) - first[own[:n]]
    return mix(a)[whole], (mix(b) >> np.uint64(48)).astype(np.int64)[whole], own[:n][whole], at[whole]


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((mix(h ^ _ROW[row]) * _ROW[2 + row]) >> np.uint64(64 - bits)).astype(np.int64)


def pack_gaps(sorted_cells: np.ndarray) -> bytes:
    """Rising numbers as gaps: 255 stands for 255 more, any other byte ends a gap."""
    gaps = np.diff(sorted_cells, prepend=-1) - 1
    length = gaps // 255 + 1
    out = np.full(int(length.sum()), 255, np.uint8)
    out[np.cumsum(length) - 1] = gaps % 255
    return out.tobytes()


def unpack_gaps(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8)
    ends = np.flatnonzero(raw < 255)
    return np.cumsum(raw, dtype=np.int64)[ends] + np.arange(len(ends))


def sketch(docs: DataFrame, window: int, bits: int) -> np.ndarray:
    """The merged sketch as a bitmap of cells counted twice or more: uint8 of shape (ROWS, 2 ** bits / 8)."""
    block_bits = min(BLOCK_BITS, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            out = []
            for row in range(ROWS):
                c = np.sort(cells(h, row, bits))
                new = np.concatenate([[True], c[1:] != c[:-1]]) if len(c) else np.zeros(0, bool)
                times = np.diff(np.append(np.flatnonzero(new), len(c)))
                c = c[new]
                for twice in (False, True):
                    part = c[(times > 1) == twice]
                    cut = np.searchsorted(part >> block_bits, np.arange((1 << (bits - block_bits)) + 1))
                    out += [(row, k, twice, pack_gaps(part[low:high] - (k << block_bits))) for k, (low, high) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if high > low]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("line", "block", "twice", "gaps"), r, strict=True)) for r in out], schema=pa.schema([("line", pa.int32()), ("block", pa.int32()), ("twice", pa.bool_()), ("gaps", pa.binary())]))

        n = 0
        for b in batches:
            for _, _, data, offsets in text_groups(b):
                h, _, own, _ = windows(data, offsets, window)
                # A document counts a window once, however often it says it.
                order = np.lexsort((h, own))
                h, own = h[order], own[order]
                once = h[np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])])] if len(h) else h
                held.append(once)
                n += len(once)
                if n >= FLUSH:
                    yield from send()
                    n = 0
        yield from send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if at is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([np.packbits(seen > 1, bitorder="little").tobytes()], pa.binary())], names=["line", "block", "bitmap"])

        for b in batches:
            for line, block, twice, gaps in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (line, block) != at:
                    yield from done()
                    at, seen = (line, block), np.zeros(1 << block_bits, np.uint8)
                c = unpack_gaps(gaps)
                seen[c] = 2 if twice else np.minimum(seen[c] + 1, 2)
        yield from done()

    parts = keyed_text(docs).where("doc_id is not null").select("text").mapInArrow(count, "line int, block int, twice boolean, gaps binary")
    merged = parts.repartition("line", "block").sortWithinPartitions("line", "block").mapInArrow(merge, "line int, block int, bitmap binary")
    out = np.zeros((ROWS, 1 << (bits - block_bits), max(1, (1 << block_bits) // 8)), np.uint8)
    for r in merged.toLocalIterator():
        out[r["line"], r["block"]] = np.frombuffer(r["bitmap"], np.uint8)
    return out.reshape(ROWS, -1)


@lru_cache(maxsize=1)
def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(ROWS, -1)


def candidates(docs: DataFrame, window: int, bits: int, bitmap: np.ndarray) -> DataFrame:
    """(h, place, doc_id) for windows estimated repeated; place packs tag, sure and first word.

    Those that a task knows to repeat are sure; of the others it sends what its smallest document has.
    """
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(bitmap.tobytes(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = _unpacked(shared.value)
        held: list[tuple[np.ndarray, ...]] = []

        def send() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            h, tag, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((doc, tag, h))
            a, b, c = h[order], tag[order], doc[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            sure = np.zeros(len(h), bool)
            sure[order] = c > c[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
            # Sure rows need no group any more: a key of their own spreads them.
            h = np.where(sure, mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)), h)
            place = (at << AT) | (sure.astype(np.int64) << SURE) | tag
            for low in range(0, len(h), 1 << 17):
                cut = slice(low, low + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(h[cut].view(np.int64)), pa.array(place[cut]), pa.array(doc[cut])], names=["h", "place", "doc_id"])

        n = 0
        for b in batches:
            ids = b.column(0).to_numpy()
            for first, _, data, offsets in text_groups(b):
                h, tag, own, at = windows(data, offsets, window)
                may = np.ones(len(h), bool)
                for row in range(ROWS):
                    c = cells(h, row, bits)
                    may &= (repeated[row][c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
                if may.any():
                    held.append((h[may], tag[may], ids[first + own[may]], at[may]))
                    n += int(may.sum())
                if n >= FLUSH_CANDIDATES:
                    yield from send()
                    n = 0
        yield from send()

    return keyed_text(docs).where("doc_id is not null").mapInArrow(run, "h long, place long, doc_id long")


def removed_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and cut: the place of every window of the document that starts in a document with a smaller id."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    bits = int(np.ceil(np.log2(min(max(size / CELL_BYTES, LEAST_CELLS), MOST_CELLS))))
    found = candidates(docs, window, bits, sketch(docs, window, bits)).repartition("h")  # the tag is worked out behind the shuffle
    found = found.withColumn("tag", F.col("place").bitwiseAND(TAG)).withColumn("least", F.min("doc_id").over(Window.partitionBy("h", "tag")))
    return found.where((F.col("place").bitwiseAND(1 << SURE) != 0) | (F.col("doc_id") > F.col("least"))).groupBy("doc_id").agg(F.collect_list("place").alias("cut"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with texts the kept words joined by spaces; one row per document."""
    bounded_batches(docs.sparkSession)
    cuts = removed_windows(docs, window).withColumnRenamed("doc_id", "cut_id")
    d = keyed_text(docs)
    j = d.join(cuts, d["doc_id"] == F.col("cut_id"), "left").select("doc_id", "text", "cut")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if texts else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha, kept = [], [], [], []
            cuts_of = b.column(2)
            for i, text in enumerate(b.column(1).to_pylist()):
                w = words(text)
                lost = np.zeros(len(w), bool)
                if cuts_of[i].is_valid:
                    place = cuts_of[i].values.to_numpy()
                    at, tag = place >> AT, place & TAG
                    _, own_tag, _, _ = windows(np.frombuffer(text or b"", np.uint8), np.array([0, len(text or b"")]), window)
                    # Rows may repeat a doc_id with other texts: a cut holds where the text has that window.
                    inside = at < len(own_tag)
                    at, tag = at[inside], tag[inside]
                    at = at[own_tag[at] == tag]
                    edge = np.zeros(len(w) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    lost = np.cumsum(edge)[:-1] > 0
                out = b" ".join(compress(w, (~lost).tolist())) if lost.any() else b" ".join(w)
                n.append(len(w))
                gone.append(int(lost.sum()))
                sha.append(hashlib.sha256(out).hexdigest())
                kept.append(out)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), *([pa.array(kept, pa.binary()).cast(pa.string())] if texts else [])], names=names)

    return j.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir))


OP2_SQL = rf"""with docs as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), cast([] as varchar[])) as ws from documents),
spots as materialized (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from docs where len(ws) >= {WINDOW}),
windows as (select doc_id, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') as k from spots), firsts as (select k, min(doc_id) as least from windows group by 1),
lost as (select distinct doc_id, unnest(range(i, i + {WINDOW})) as j from windows join firsts using (k) where doc_id > least),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j from docs),
kept as (select w.doc_id, string_agg(word, ' ' order by w.j) filter (l.j is null) as t, count(l.j) as n_removed from words w left join lost l on l.doc_id = w.doc_id and l.j = w.j group by 1)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from docs d left join kept k on k.doc_id = d.doc_id"""
