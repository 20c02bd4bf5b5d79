"""Benchmark decontamination by latent semantic retrieval.

1. A passage of PASSAGE words is a TF-IDF vector over the terms of the benchmark; document frequencies count all passages that
   tile all documents.
2. One more pass over these adds up Y = A'A R for the passage matrix A and a random R, task by task and then term by term; with the
   benchmark's own passages added at equal weight, a Nystroem step on Y gives the leading right singular vectors (randomised SVD).
3. Benchmark passages are projected there, and text passages, now each beginning half a passage after the one before, compared
   with them. One whose cosine with a benchmark passage's latent image (both as vectors over the terms) reaches MIN_COSINE is a
   candidate.
4. Around a candidate the longest common subsequence of words with the whole item is measured. It is a leak if it covers STRONG of
   the item, or WEAK of it while the item's answer (its last line or sentence) is there to ANSWER.

The benchmark is the query set: it goes to the tasks in blocks of at most BLOCK_TERMS terms and BLOCK_QUERIES passages, each with passes of its own over the
documents, so what is broadcast and what a task adds up (terms by terms) has a bound. Null or empty texts and items leak nothing. Repeated rows are judged alike, each on its own;
of repeated item ids all texts count. A text's passages are compared HALVES half-passages at a time, so a very long text takes about ten times its own size in memory. Other columns are kept, whatever
their names; only one called like the column asked for gives way to it. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, documents, lean, spare, text_groups, word_hashes

PASSAGE = 64
HALF = PASSAGE // 2
#: Half-passages whose products with all queries are in memory at a time, whatever the length of a text.
HALVES = 256
BLOCK_TERMS, BLOCK_QUERIES = 6000, 1000
MOST_RANK, OVERSAMPLE = 256, 8
MIN_COSINE = 0.35
STRONG, WEAK, ANSWER = 0.75, 0.5, 0.8
#: Terms in more passages than e ** -MIN_IDF of all tell little; they count only for items that have few others.
MIN_IDF, MIN_TERMS = 3.5, 4
#: Latent weights of a term below this share of its idf are taken for none.
LEAST_SHARE = 0.002
FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("lcs", T.DoubleType())]))
#: Lower case for A-Z, a space for every other ASCII character that is neither letter nor digit.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def hashed(text: bytes) -> np.ndarray:
    return word_hashes(np.frombuffer(text.translate(PLAIN), np.uint8), np.array([0, len(text)]))[0]


def answer(text: bytes) -> bytes:
    """The last line, or else the last sentence, of an item."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    if len(lines) > 1:
        return lines[-1]
    sentences = [x for x in text.replace(b"?", b".").replace(b"!", b".").split(b".") if x.strip()]
    return sentences[-1] if len(sentences) > 1 else b""


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return int(row[-1])


def terms_of(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The place of each hash in the sorted vocabulary, -1 if it has none."""
    if not len(vocabulary):
        return np.full(len(h), -1, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, -1)


def pieces(own: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of some texts: the piece of `size` words that each is in, the text of each piece, and the first piece of each text."""
    first = np.searchsorted(own, np.arange(rows))
    n = -(-np.diff(np.append(first, len(own))) // size)
    begins = np.cumsum(n) - n
    return begins[own] + (np.arange(len(own)) - first[own]) // size, np.repeat(np.arange(rows), n), begins


def weighted(p: np.ndarray, t: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, weight), each term of a passage once, in order: its count times its idf, those of a passage having length 1."""
    on = t >= 0
    on[on] = idf[t[on]] > 0
    key, times = np.unique(p[on] * max(len(idf), 1) + t[on], return_counts=True)
    p, t = key // max(len(idf), 1), key % max(len(idf), 1)
    if not len(p):
        return p, t, np.zeros(0)
    w = times * idf[t]
    return p, t, w / np.sqrt(np.bincount(p, weights=w * w))[p]


class Items:
    """A block of the benchmark: its item texts, and its passages as queries."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in rows]
        self.words = [hashed(x) for _, x in rows]
        self.answers = [hashed(answer(x)) for _, x in rows]
        self.vocabulary = np.unique(np.concatenate(self.words)) if rows else np.zeros(0, np.uint64)
        self.queries = [(k, w[at : at + PASSAGE]) for k, w in enumerate(self.words) for at in range(0, max(1, len(w) - HALF), HALF)]

    def weigh(self, df: np.ndarray, n: int) -> np.ndarray:
        idf = np.log((n + 1) / (df + 1)) + 0.1
        keep = idf >= MIN_IDF
        for w in self.words:
            t = np.unique(terms_of(w, self.vocabulary))
            if keep[t].sum() < MIN_TERMS:
                keep[t] = True
        return np.where(keep, idf, 0.0)

    def matrix(self, idf: np.ndarray) -> np.ndarray:
        q = np.zeros((len(self.queries), len(idf)))
        for k, (_, w) in enumerate(self.queries):
            t, times = np.unique(terms_of(w, self.vocabulary), return_counts=True)
            q[k, t] = times * idf[t]
        return q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)


def _groups(batch: pa.RecordBatch, column: str):
    for first, last, data, offsets in text_groups(batch, column):
        h, own = word_hashes(np.frombuffer(data.tobytes().translate(PLAIN), np.uint8), offsets)
        yield first, last, h, own


def _sums(docs: DataFrame, emit) -> dict[int, np.ndarray]:
    """Adds up rows (term, vector) of all tasks: emit(batches) gives them once a task. At most as many rows as the block has terms come back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for term, vectors in emit(batches):
            for low in range(0, len(term), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(term[low : low + 2000].astype(np.int32)), pa.array([v.astype(np.float32).tobytes() for v in vectors[low : low + 2000]], pa.binary())], names=["term", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(v, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["term", "v"])

    texts = docs.select(F.col("text").cast("string").cast("binary").alias("text"))
    total = texts.mapInArrow(lean(run), "term int, v binary").repartition("term").mapInArrow(lean(add), "term int, v binary")
    return {r["term"]: np.frombuffer(r["v"], np.float64) for r in total.toLocalIterator()}


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and passages in all."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def emit(batches: Iterator[pa.RecordBatch]):
        v = shared.value
        df = np.zeros(len(v) + 1, np.int64)
        ones = np.ones(len(v))
        for b in batches:
            for first, last, h, own in _groups(b, "text"):
                p, text_of, _ = pieces(own, last - first, PASSAGE)
                df[:-1] += np.bincount(weighted(p, terms_of(h, v), ones)[1], minlength=len(v))
                df[-1] += len(text_of)
        hit = np.flatnonzero(df)
        yield hit, np.column_stack([df[hit] // 4096, df[hit] % 4096])  # float32 keeps both parts whole

    found = _sums(docs, emit)
    df = np.zeros(len(vocabulary) + 1)
    for k, (high, low) in found.items():
        df[k] = high * 4096 + low
    return df[:-1], int(df[-1])


def singular_vectors(docs: DataFrame, items: Items, idf: np.ndarray, seed: int = 29) -> np.ndarray:
    """terms x rank: leading right singular vectors of all passages with the benchmark's own, each side weighing the same."""
    used = np.flatnonzero(idf > 0)
    q = items.matrix(idf)
    rank = min(MOST_RANK, len(items.queries) + OVERSAMPLE, len(used))
    r = np.zeros((len(idf), rank))
    r[used] = np.random.default_rng(seed).standard_normal((len(used), rank))
    shared = docs.sparkSession.sparkContext.broadcast((items.vocabulary, idf, r.astype(np.float32)))

    def emit(batches: Iterator[pa.RecordBatch]):
        v, w, start = shared.value
        n, mass = len(w), 0.0
        gram = np.zeros(n * n, np.float32)  # A'A of this task: far fewer sums than A R, and A'A R is one product in the end
        for b in batches:
            for first, last, h, own in _groups(b, "text"):
                p, t, a = weighted(pieces(own, last - first, PASSAGE)[0], terms_of(h, v), w)
                for apart in range(len(p)):
                    both = np.flatnonzero(p[apart:] == p[: len(p) - apart])
                    if not len(both):
                        break
                    np.add.at(gram, t[both] * n + t[both + apart], (a[both] * a[both + apart]).astype(np.float32))
                mass += float(len(np.unique(p)))
        gram = gram.reshape(n, n)
        y = gram @ start + gram.T @ start - gram.diagonal()[:, None] * start
        hit = np.flatnonzero(y.any(1))
        yield hit, y[hit]
        yield np.array([n]), np.full((1, start.shape[1]), mass, np.float32)

    y, mass = np.zeros(r.shape), 0.0
    for k, row in _sums(docs, emit).items():
        if k < len(idf):
            y[k] = row
        else:
            mass = float(row[0])
    own = float((q * q).sum())
    y += (mass / own if own and mass else 1.0) * (q.T @ (q @ r))
    core = r.T @ y
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    good = values > max(values.max(), 0) * 1e-9
    return np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)[0]


def with_leaks(docs: DataFrame, benchmark: DataFrame, column: str = "leaks") -> DataFrame:
    """docs with an array of (item_id, cosine, lcs) of the items that leak into the text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where("text is not null")
    held: list[tuple[int, bytes]] = []
    terms: set[int] = set()
    passages = 0
    out = docs.withColumn(column, F.array().cast(FOUND))
    for r in rows.orderBy("item_id").toLocalIterator():
        words = hashed(bytes(r["text"])).tolist()
        new, n = set(words), len(range(0, max(1, len(words) - HALF), HALF))
        if held and (len(terms | new) > BLOCK_TERMS or passages + n > BLOCK_QUERIES):
            out, held, terms, passages = _block(docs, out, Items(held), column), [], set(), 0
        held.append((r["item_id"], bytes(r["text"])))
        terms |= new
        passages += n
    return _block(docs, out, Items(held), column) if held else out


def _block(docs: DataFrame, out: DataFrame, items: Items, column: str) -> DataFrame:
    if not len(items.vocabulary):
        return out
    idf = items.weigh(*frequencies(docs, items.vocabulary))
    v = singular_vectors(docs, items, idf)
    q = items.matrix(idf) @ v
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    latent = (v * idf[:, None]) @ q.T  # what one word of a term adds to the product with each query, in the latent space
    latent[np.abs(latent) < LEAST_SHARE * idf[:, None]] = 0
    term, query = np.nonzero(latent)
    shared = docs.sparkSession.sparkContext.broadcast(Search(items, idf, np.searchsorted(term, np.arange(len(idf) + 1)), query, latent[term, query]))
    helper = spare(out, f"{column}__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value
        for b in batches:
            found: list[dict[int, tuple[float, float]]] = [{} for _ in range(b.num_rows)]
            for first, last, h, own in _groups(b, helper):
                for row, item, cosine, lcs in search.leaks(h, own, last - first):
                    before = found[first + row].get(item, (0.0, 0.0))
                    found[first + row][item] = max(before[0], cosine), max(before[1], lcs)
            at = b.schema.get_field_index
            old = b.column(at(column)).to_pylist()
            new = [[*o, *({"item_id": search.items.ids[i], "cosine": c, "lcs": x} for i, (c, x) in sorted(f.items()))] for o, f in zip(old, found, strict=True)]
            keep = [x for x in b.schema.names if x not in (helper, column)]
            yield pa.RecordBatch.from_arrays([*(b.column(at(x)) for x in keep), pa.array(new, pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64())])))], names=[*keep, column])

    schema = T.StructType([*(f for f in out.schema.fields if f.name != column), T.StructField(column, FOUND)])
    return out.withColumn(helper, F.col("text").cast("string").cast("binary")).mapInArrow(lean(run), schema)


@dataclass
class Search:
    """What a task needs to find leaks: the items, and by term the queries it adds to and how much (begin, query, gain)."""

    items: Items
    idf: np.ndarray
    begin: np.ndarray
    query: np.ndarray
    gain: np.ndarray

    def leaks(self, h: np.ndarray, own: np.ndarray, rows: int) -> Iterator[tuple[int, int, float, float]]:
        """(row, item, cosine, share of the item's words) of leaks in some texts' words; the products of HALVES half-passages are in memory at a time."""
        items, idf, n_q = self.items, self.idf, len(self.items.queries)
        item_of = np.array([i for i, _ in items.queries])
        half, text_of, begins = pieces(own, rows, HALF)
        t = terms_of(h, items.vocabulary)
        on = t >= 0
        on[on] = idf[t[on]] > 0
        if not on.any():
            return
        t, hs = t[on], half[on]
        norm2 = np.bincount(hs, weights=idf[t] ** 2, minlength=len(text_of))
        inner = np.append(text_of[1:] == text_of[:-1], False)  # a passage is a half and the next one of its text
        norm2[:-1] += np.where(inner[:-1], norm2[1:], 0)
        word_at = np.searchsorted(own, np.arange(rows + 1))
        for low in range(0, len(text_of), HALVES):
            high = min(low + HALVES, len(text_of))
            a, b = np.searchsorted(hs, (low, high + 1))
            if a == b:
                continue
            product = self._products(t[a:b], hs[a:b] - low, high + 1 - low)
            product[:-1] += np.where(inner[low:high, None], product[1:], 0)
            # Words counted one by one, a passage is at most as long as its vector: no cosine is above this.
            bound = product[:-1] / np.sqrt(np.maximum(norm2[low:high], 1e-9))[:, None]
            length: dict[int, float] = {}
            for k, j in zip(*np.nonzero(bound >= MIN_COSINE), strict=True):
                p = low + int(k)
                if p not in length:
                    mine = t[np.searchsorted(hs, p) : np.searchsorted(hs, p + 1 + int(inner[p]))]
                    term, times = np.unique(mine, return_counts=True)
                    length[p] = float(np.linalg.norm(times * idf[term]))
                cosine = float(product[k, j]) / length[p]
                if cosine < MIN_COSINE:
                    continue
                row, item = int(text_of[p]), int(item_of[j])
                w = h[word_at[row] : word_at[row + 1]]
                at = (p - int(begins[row])) * HALF
                m = len(items.words[item])
                near = w[max(0, at - m) : at + PASSAGE + m]
                share = float(np.isin(items.words[item], near).mean())  # no subsequence is longer
                if share < WEAK:
                    continue
                lcs = common_length(items.words[item], near) / m
                known = items.answers[item]
                if lcs >= STRONG or (lcs >= WEAK and len(known) and common_length(known, near) >= ANSWER * len(known)):
                    yield row, item, cosine, lcs

    def _products(self, t: np.ndarray, half: np.ndarray, halves: int) -> np.ndarray:
        """half-passages x queries: the words' gains added up."""
        n_q = len(self.items.queries)
        n = self.begin[t + 1] - self.begin[t]
        at = np.repeat(self.begin[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(np.repeat(half, n) * n_q + self.query[at], weights=self.gain[at], minlength=halves * n_q).reshape(-1, n_q)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with their own columns."""
    leaks = spare(docs, "decontamination__leaks")
    return with_leaks(docs, benchmark, leaks).where(F.size(leaks) == 0).drop(leaks)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_leaks(documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return d.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", F.round("leak.cosine", 6).alias("cosine"), F.round("leak.lcs", 6).alias("lcs"))
