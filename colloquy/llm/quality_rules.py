"""Quality rules: an isolation forest on rule statistics, its threshold calibrated on labelled rows.

Each tree splits a random sample of documents at random values of random statistics until they stand alone; documents
that few splits isolate are odd. The trees need SAMPLE documents each, as the method prescribes; scores and calibration
cover all rows.

Null text has no words: all counts 0, base_failed. Null or doubled labels: a document counts as bad if any row of it says so,
as unlabelled if none says anything. Repeated rows each get their row. With no labelled rows of both kinds the forest
rejects nothing. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, distinct, documents, keyed_text, mix, random_words, text_groups, word_hashes, words, written

TREES, SAMPLE = 100, 256
#: Rows that the trees are drawn from at most (expected number); a documented bound, see the README.
FIT_ROWS = 20_000
#: Share of good labelled rows that the threshold may reject.
GOOD_LOST = 0.01
BINS = 2000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines", "n_distinct")
STATS = ("log_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "line_words", "distinct")
SYMBOLS = b"#*$%&|<>"
_SYMBOLS = np.frombuffer(SYMBOLS, np.uint8)
#: Bytes that begin no character of a word: white space, and those after the first of a character.
_NO_CHAR = np.array([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])
_CHARS, _SYMBOL, _UPPER = (np.isin(np.arange(256), x) for x in (np.setdiff1d(np.arange(256), _NO_CHAR), _SYMBOLS, np.arange(65, 91)))
_THREE = random_words(721, 3)


def counts(text: bytes | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    w = words(text)
    n = len(w)
    ids: dict[bytes, int] = {}
    x = np.fromiter(map(ids.setdefault, w, range(n)), np.int64, n)  # a word's number is its first place
    repeated = 0
    threes = x[:0]
    if n >= 3:
        pairs = x[:-1] * n + x[1:]
        if n >= 1 << 21:
            pairs = np.unique(pairs, return_inverse=True)[1]  # numbered anew, so that three words fit 64 bits
        threes = pairs[:-1] * n + x[2:]
        ordered = np.sort(threes)
    if len(threes) and (ordered[1:] == ordered[:-1]).any():
        _, at, times = np.unique(threes, return_inverse=True, return_counts=True)
        hit = times[at] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= hit
        repeated = int(covered.sum())
    lines = [line for line in text.split(b"\n") if line.strip()]
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - int(seen[_NO_CHAR].sum())
    return n, chars, int(seen[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated, int(seen[65:91].sum()), len(lines), len(ids)


def batch_counts(batch: pa.RecordBatch, column: str = "text") -> np.ndarray:
    """The COUNTS of every text of a batch, a row each, of many texts at a time; words are told apart by 48 bits of their hashes, and so are three words."""
    out = np.zeros((batch.num_rows, len(COUNTS)), np.int64)
    for first, last, data, offsets in text_groups(batch, column):
        h, own = word_hashes(data, offsets)
        rows, top = last - first, own.astype(np.uint64) << np.uint64(48)
        per = lambda at, rows=rows: np.bincount(at, minlength=rows)
        part = out[first:last]
        part[:, 0] = per(own)
        part[:, 7] = per((distinct(top | (h >> np.uint64(16))) >> np.uint64(48)).astype(np.int64))
        if len(h) > 2:
            inside = np.flatnonzero(own[2:] == own[:-2])
            threes = top[inside] | (mix(h[inside] * _THREE[0] + h[inside + 1] * _THREE[1] + h[inside + 2] * _THREE[2]) >> np.uint64(16))
            ordered = np.sort(threes)
            again = distinct(ordered[1:][ordered[1:] == ordered[:-1]])
            if len(again):
                some = np.flatnonzero(np.isin(own[inside], (again >> np.uint64(48)).astype(np.int64)))
                at = np.minimum(np.searchsorted(again, threes[some]), len(again) - 1)
                at = inside[some[again[at] == threes[some]]]
                covered = np.zeros(len(h), bool)
                for k in range(3):
                    covered[at + k] = True
                part[:, 4] = per(own[covered])
        full = np.diff(offsets) > 0
        part[full, 1] = np.add.reduceat(_CHARS[data].view(np.uint8), offsets[:-1][full], dtype=np.int64) if full.any() else 0
        for k, table in ((2, _SYMBOL), (5, _UPPER)):
            part[:, k] = per(np.searchsorted(offsets, np.flatnonzero(table[data]), side="right") - 1)
        whole = data.tobytes()
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            lines = [line for line in whole[a:b].split(b"\n") if line.strip()]
            part[i, 3], part[i, 6] = len(lines) - len(set(lines)), len(lines)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS, one row per document."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([counts(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], names=["doc_id", *COUNTS])

    return keyed_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def rule_columns() -> list:
    n, chars, lines = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1)), F.greatest("n_lines", F.lit(1))
    made = (F.log1p("n_words"), F.col("word_chars") / n, F.col("n_symbols") / chars, F.col("n_dup_lines") / lines, F.col("n_repeat_words") / n, F.col("n_upper") / chars, F.log1p(n / lines), F.col("n_distinct") / n)
    return [c.cast("double").alias(s) for c, s in zip(made, STATS, strict=True)]


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth at which a search tree of n keys gives up: 2 H(n - 1) - 2 (n - 1) / n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(rows: np.ndarray, seed: int) -> list[tuple[np.ndarray, ...]]:
    """TREES trees as arrays (feature, value, left child, right child, path length); a leaf has feature -1."""
    rng, trees = np.random.default_rng(seed), []
    for _ in range(TREES if len(rows) > 1 else 0):
        part = rows[rng.choice(len(rows), min(SAMPLE, len(rows)), replace=False)]
        top = int(np.ceil(np.log2(len(part))))
        nodes: list[list[float]] = []

        def split(x: np.ndarray, depth: int, nodes=nodes, top=top) -> int:
            k = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + float(_mean_path(len(x)))])
            free = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 and depth < top else []
            if len(free):
                f = int(rng.choice(free))
                v = float(rng.uniform(x[:, f].min(), x[:, f].max()))
                low = x[:, f] < v
                nodes[k][:2] = [f, v]
                nodes[k][2:4] = [split(x[low], depth + 1), split(x[~low], depth + 1)]
            return k

        split(part, 0)
        t = np.array(nodes)
        trees.append((t[:, 0].astype(np.int64), t[:, 1], t[:, 2].astype(np.int64), t[:, 3].astype(np.int64), t[:, 4]))
    return trees


def anomaly(rows: np.ndarray, trees: list, size: int) -> np.ndarray:
    """2 ** -(mean path / expected path): near 1 for rows that few splits isolate."""
    if not trees or not len(rows):
        return np.zeros(len(rows))
    total, at_row = np.zeros(len(rows)), np.arange(len(rows))
    for feature, value, left, right, path in trees:
        at = np.zeros(len(rows), np.int64)
        while (inner := feature[at] >= 0).any():
            i = at_row[inner]
            node = at[i]
            at[i] = np.where(rows[i, feature[node]] < value[node], left[node], right[node])
        total += path[at]
    return 2.0 ** (-total / len(trees) / max(float(_mean_path(min(SAMPLE, size))), 1e-9))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and bad (0 or 1), one row per document that has a label."""
    bad = F.when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 0)
    return labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), bad.alias("bad")).where("bad is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"))


def threshold(histogram: list) -> float:
    """The lowest score at which at most GOOD_LOST of the good rows are rejected, and only where bad rows are denser than good ones.

    histogram: (bin, good, bad) rows of all labelled documents.
    """
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for r in histogram:
        good[r["bin"]], bad[r["bin"]] = r["good"], r["bad"]
    if not good.sum() or not bad.sum():
        return np.inf
    lost, caught = good[::-1].cumsum()[::-1] / good.sum(), bad[::-1].cumsum()[::-1] / bad.sum()
    gain = np.where(lost <= GOOD_LOST, caught - 5 * lost, -1.0)
    best = int(gain.argmax())
    return best / BINS if gain[best] > 0 else np.inf


def quality_rules(docs: DataFrame, labels: DataFrame, seed: int = 5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly."""
    spark = docs.sparkSession
    stats = written(statistics(docs), "rule-statistics")
    stats = stats.select("*", *rule_columns())
    n = stats.count()
    # The sample is a fixed share of the hash range; its expected size is FIT_ROWS however many rows there are.
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id", *COUNTS), F.lit(1 << 30)) < int(min(1.0, FIT_ROWS / max(n, 1)) * (1 << 30))
    sample = np.array([tuple(r) for r in stats.where(share & (F.col("n_words") > 0)).select(*STATS).orderBy(*STATS).limit(2 * FIT_ROWS).collect()], float).reshape(-1, len(STATS))
    forest = spark.sparkContext.broadcast((grow(sample, seed), len(sample)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, size = forest.value
        for b in batches:
            x = np.column_stack([b.column(b.schema.get_field_index(s)).to_numpy(zero_copy_only=False) for s in STATS]) if b.num_rows else np.zeros((0, len(STATS)))
            keep = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", *COUNTS)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(anomaly(x, trees, size))], names=["doc_id", *COUNTS, "anomaly"])

    scored = written(stats.mapInArrow(score, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", anomaly double"), "rule-scores")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = scored.where(~failed).join(labelled(labels), "doc_id").groupBy(F.floor(F.least(F.col("anomaly"), F.lit(1.0)) * BINS).cast("int").alias("bin"))
    cut = threshold(rows.agg(F.sum(1 - F.col("bad")).alias("good"), F.sum("bad").alias("bad")).collect())
    return scored.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & (F.col("anomaly") < F.lit(float(cut)))).alias("kept"), "anomaly")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
