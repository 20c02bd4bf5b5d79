"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint has a bit set where over half of its shingle hashes have it. Fingerprints link at most MOST differing
bits apart. Equal fingerprints are one node. Two that differ in at most 2 bits agree on at least 2 of 4 quarters, so each node
goes to 6 blocks, one for each pair of quarters, and only nodes of one block are compared. There every node has a row of
distances to PIVOTS fixed fingerprints; by the triangle inequality a pair whose rows differ by more than MOST in any
coordinate cannot link and is discarded, survivors are verified by their differing bits.

A block gives the links of a spanning forest of its pairs, never all pairs; a sorted first coordinate bounds what
is compared. Blocks beyond BLOCK_ROWS nodes are split further by how the other quarters agree, so no task holds one.

Null text and text without words: fingerprint 0, linked like any other. Repeated rows get a row each. A null doc_id never names
a component unless nothing else is in it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents, keyed_text, lean, random_words, written
from .components import components

SHINGLE, SEED, MOST = 3, 42, 2
PIVOTS = 24
_TABLE = random_words(101, PIVOTS)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_AT = np.arange(8) * 256
HASHES_AT_ONCE = 1 << 16
BLOCK_ROWS = 20_000


def over_half(hashes: np.ndarray) -> int:
    """The fingerprint of some 64-bit hashes: the bits that over half of them have."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        bits += (_seen(hashes[at : at + HASHES_AT_ONCE]) @ _BITS).ravel()
    return int.from_bytes(np.packbits(bits * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _seen(h: np.ndarray) -> np.ndarray:
    """How often each of 8 bytes has each value."""
    return np.bincount((h.view(np.uint8).reshape(-1, 8) + _AT).ravel(), minlength=2048).reshape(8, 256)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    w = text.lower().split() if text else []  # bytes.lower() changes A-Z only
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= shingle:
        parts: Iterator[bytes] = iter([joined])
        n = 1
    else:
        ends = np.cumsum([len(x) + 1 for x in w]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = len(w) - shingle + 1
        parts = map(joined.__getitem__, map(slice, starts[:n].tolist(), ends[shingle - 1 :].tolist()))
    hashes = map(xxhash.xxh64_intdigest, parts, repeat(SEED))
    bits = np.zeros(64, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        h = np.fromiter(hashes, np.uint64, min(HASHES_AT_ONCE, n - at)) if at + HASHES_AT_ONCE >= n else np.fromiter((next(hashes) for _ in range(HASHES_AT_ONCE)), np.uint64, HASHES_AT_ONCE)
        bits += (_seen(h) @ _BITS).ravel()
    return int.from_bytes(np.packbits(bits * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (a hash of the text) and fp, the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], names=["doc_id", "th", "fp"])

    return keyed_text(docs, F.xxhash64("text").alias("th")).mapInArrow(lean(run), "doc_id long, th long, fp long")


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances to the PIVOTS reference fingerprints, one row each."""
    return np.bitwise_count(fp[:, None] ^ _TABLE[None, :]).astype(np.int16)


def forest(fp: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the pairs at most `most` bits apart, among distinct fingerprints.

    From each found node its neighbours among the nodes not found yet are looked up: those whose first coordinate is near (a range
    of a sorted array), whose other coordinates all are, and whose bits are. So a clique gives n - 1 links.
    """
    table = pivot_table(fp)
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    first = table[:, 0]
    open_ = np.ones(len(fp), bool)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for start in range(len(fp)):
        if not open_[start]:
            continue
        open_[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            low, high = np.searchsorted(first, [first[i] - most, first[i] + most + 1])
            near = low + np.flatnonzero(open_[low:high])
            near = near[np.abs(table[near] - table[i]).max(1) <= most] if len(near) else near
            near = near[np.bitwise_count(fp[near] ^ fp[i]) <= most] if len(near) else near
            if len(near):
                open_[near] = False
                queue.extend(near.tolist())
                a.append(np.full(len(near), fp[i], np.uint64))
                b.append(fp[near])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _blocks(nodes: DataFrame) -> DataFrame:
    """(block, key, fp): each node once a pair of quarters; the key holds those two quarters."""
    quarter = [F.shiftrightunsigned("fp", 16 * q).bitwiseAND(0xFFFF) for q in range(4)]
    keys = [F.struct(F.lit(k).alias("block"), (quarter[i] * 65536 + quarter[j]).alias("key")) for k, (i, j) in enumerate(combinations(range(4), 2))]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.block", "k.key", "fp")


def links(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b) signed fingerprints, enough links to connect what links connect; nodes has distinct fp."""
    if most > 2:
        raise ValueError("the blocks are complete for 2 differing bits at most")
    blocks = _blocks(nodes)
    crowded = blocks.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # In a large block the other 32 bits of a linking pair agree in one of three parts at least.
    rest = F.element_at(F.array(*(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) * 65536 + F.shiftrightunsigned("fp", 16 * j).bitwiseAND(0xFFFF) for i, j in reversed(list(combinations(range(4), 2))))), F.col("block") + 1)
    parts = F.array(F.shiftrightunsigned(rest, 21), 4096 + F.shiftrightunsigned(rest, 10).bitwiseAND(2047), 8192 + rest.bitwiseAND(1023))
    blocks = blocks.join(crowded, ["block", "key"]).withColumn("part", F.explode(F.when(F.col("n") > BLOCK_ROWS, parts).otherwise(F.array(F.lit(-1).cast("long")))))
    blocks = blocks.select("block", "key", "part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at: tuple[int, ...] | None = None

        def done() -> Iterator[pa.RecordBatch]:
            fp = np.concatenate(held).view(np.uint64) if held else np.zeros(0, np.uint64)
            if len(fp) > 1:
                a, b = forest(fp, most)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            *key, fp = (batch.column(k).to_numpy() for k in range(4))
            if not len(fp):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1, [len(fp)]])
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if (here := tuple(int(k[low]) for k in key)) != at:
                    yield from done()
                    held, at = [], here
                held.append(fp[low:high].copy())
        yield from done()

    return blocks.repartition("block", "key", "part").sortWithinPartitions("block", "key", "part").mapInArrow(lean(run), "a long, b long")


def choice(marks: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """marks (doc_id, th and the column named) with component_id and chosen; roots has node and root for every node with a link."""
    placed = marks.join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))
    placed = placed.withColumn("name", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    # Written, so that both joins are of plain exchanges, whose hot keys Spark splits: a third of all rows may share a root.
    least = written(placed.groupBy("root").agg(F.min("name").alias("least")), "least-names")
    return placed.join(least, "root").select("doc_id", "th", node, F.col("least.doc_id").alias("component_id"), (F.col("name") == F.col("least")).alias("chosen"))


def only_chosen(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that found (doc_id, th, chosen) has chosen, repeated ones once."""
    chosen = found.where("chosen").select(F.col("doc_id").alias("simhash__id"), F.col("th").alias("simhash__th")).distinct()
    d = docs.withColumns({"simhash__own": F.col("doc_id").cast("long"), "simhash__text": F.xxhash64("text")})
    d = d.join(chosen, F.col("simhash__own").eqNullSafe(F.col("simhash__id")) & (F.col("simhash__text") == F.col("simhash__th")), "left_semi")
    return d.dropDuplicates(["simhash__own", "simhash__text"]).drop("simhash__own", "simhash__text")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """doc_id, th, fp, component_id and chosen (a document of its component with the smallest id), one row per document."""
    marks = written(fingerprints(docs, shingle), "fingerprints")
    roots = written(components(links(marks.select("fp").distinct(), most)), "roots")
    return choice(marks, roots, "fp")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id (of several texts under it, of the smallest hash)."""
    return only_chosen(docs, near_duplicates(docs, shingle, most))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(documents(spark, sf_dir))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
