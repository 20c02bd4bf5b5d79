"""Language by nearest centroid.

A text is a vector of its hashed letter n-grams (1 to 3 letters, words set apart by one space), log counts times inverse document
frequency, of length 1. Every language has CENTROIDS clustered centroids; the one with the largest cosine names the
language. A text farther from it than that centroid's own training texts reach is marked `rejected`.

Document frequencies cover all training rows. The clusters are fitted on at most FIT_ROWS (expected number) training rows a
language, chosen by hash; that bound is a documented parameter.

Null text, and text without a letter: `und` with score 0. Null lang: never trained on, predicted like any other. Null doc_id: held
out. Without any training row every text is `und`. Repeated rows each get their row; an empty table gives an empty result.
Texts of any length are read whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents, written

DIM_BITS = 13
DIM = 1 << DIM_BITS
CENTROIDS = 3
FIT_ROWS = 400
ROUNDS = 8
BLOCK = 1 << 19
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_SHIFT = np.uint32(32 - DIM_BITS)
#: Broadcast centroids stay below this many bytes, whatever the number of languages.
MOST_BYTES = 256 << 20


def letters() -> np.ndarray:
    """True at the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str | None, is_letter: np.ndarray) -> np.ndarray | None:
    """n-gram counts of a text; None if it has no letter."""
    out, any_letter, kept = None, False, np.zeros(0, np.uint32)
    for at in range(0, len(text or ""), BLOCK):
        c = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        ok = is_letter[c]
        any_letter = any_letter or bool(ok.any())
        c = np.where(ok, c, np.uint32(32))
        c = np.concatenate([kept, c]) if at else np.concatenate([np.array([32], np.uint32), c])
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        if out is None:
            out = np.zeros(DIM, np.int64)
        h1 = c * _MULT[0]
        h2 = (h1[:-1] ^ (c[1:] + np.uint32(0x7F4A7C15))) * _MULT[1]
        h3 = (h2[:-1] ^ (c[2:] + np.uint32(0x165667B1))) * _MULT[2]
        new = len(kept) if at else 0  # n-grams that end in what was kept have been counted
        for k, h in enumerate((h1, h2, h3)):
            out += np.bincount((h ^ (h >> np.uint32(15)))[max(0, new - k) :] * _MULT[0] >> _SHIFT, minlength=DIM)
        kept = c[-2:]
    return out if any_letter else None


def vectors(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(np.array(rows, np.float32).reshape(-1, DIM)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def cluster(x: np.ndarray, k: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: at most k centroids of length 1, and the largest distance that their own rows usually have."""
    rng = np.random.default_rng(seed)
    c = x[:1]
    for _ in range(min(k, len(x)) - 1):  # the next start is a row far from all starts so far
        far = np.maximum(1 - (x @ c.T).max(1), 0) ** 2
        if far.sum() <= 1e-9:
            break
        c = np.concatenate([c, x[rng.choice(len(x), p=far / far.sum())][None]])
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    cos = x @ c.T
    own, far = cos.argmax(1), 1 - cos.max(1)
    return c, np.array([far[own == j].mean() + 4 * far[own == j].std() + 0.05 if (own == j).any() else 0.0 for j in range(len(c))])


def training(docs: DataFrame) -> DataFrame:
    return docs.where("lang is not null and not held_out")


def _with_split(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return d.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True)))


def fit(docs: DataFrame, seed: int = 17) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language of each centroid, centroids, radii, idf) from rows with doc_id, text, lang, held_out."""
    spark = docs.sparkSession
    train = training(docs)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, is_letter = np.zeros(DIM, np.int64), 0, letters()
        for b in batches:
            for t in b.column(0).to_pylist():
                c = counts(t, is_letter)
                if c is not None:
                    df += c > 0
                    n += 1
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1).astype(np.int32)), pa.array(np.append(df[hit], n))], names=["bucket", "n"])

    idf, total = np.zeros(DIM, np.float32), 0
    for r in train.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # DIM + 1 rows
        if r["bucket"] < 0:
            total = r["n"]
        else:
            idf[r["bucket"]] = r["n"]
    idf = np.where(idf > 0, np.log((total + 1) / (idf + 1)) + 0.1, 0.0).astype(np.float32)
    if not total:
        return [], np.zeros((0, DIM), np.float32), np.zeros(0), idf
    shared = spark.sparkContext.broadcast(idf)
    per_lang = train.groupBy("lang").agg(F.count(F.lit(1)).alias("lang_rows"))
    key = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    sample = train.join(F.broadcast(per_lang), "lang").where(key < F.lit(FIT_ROWS) / F.col("lang_rows") * (1 << 30)).select("lang", "doc_id", "text")

    def centroids(table: pa.Table) -> pa.Table:
        is_letter = letters()
        rows = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True), key=lambda r: (r[0], r[1] or ""))
        x = [c for c in (counts(t, is_letter) for _, t in rows) if c is not None]
        c, far = cluster(vectors(x, shared.value), CENTROIDS) if x else (np.zeros((0, DIM)), np.zeros(0))
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(c), pa.string()), "k": pa.array(np.arange(len(c)), pa.int64()), "v": pa.array([r.astype(np.float32).tobytes() for r in c], pa.binary()), "far": pa.array(far, pa.float64())})

    found = written(sample.groupBy("lang").applyInArrow(centroids, "lang string, k long, v binary, far double"), "language-centroids")
    if found.count() * DIM * 4 > MOST_BYTES:
        raise ValueError("too many languages for one broadcast: lower CENTROIDS or DIM_BITS")
    found = found.orderBy("lang", "k").collect()
    return [r["lang"] for r in found], np.array([np.frombuffer(r["v"], np.float32) for r in found]).reshape(-1, DIM), np.array([r["far"] for r in found]), idf


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, one row per row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    d = _with_split(docs)
    model = spark.sparkContext.broadcast(fit(d))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, c, far, idf = model.value
        is_letter = letters()
        for b in batches:
            texts = b.column(2).to_pylist()
            lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            for first in range(0, len(texts), 256):
                rows = [(i, v) for i, v in ((i, counts(texts[i], is_letter)) for i in range(first, min(first + 256, len(texts)))) if v is not None]
                if not rows or not langs:
                    continue
                cos = vectors([v for _, v in rows], idf) @ c.T
                best = cos.argmax(1)
                for (i, _), j, s in zip(rows, best, cos[np.arange(len(best)), best], strict=True):
                    lang[i], score[i], rejected[i] = langs[j], min(1.0, max(0.0, float(s))), 1 - s > far[j]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return d.select("doc_id", "held_out", "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
