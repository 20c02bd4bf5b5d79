"""Quality classifier from weak labels.

Two things make a document bad: low quality and toxicity. For each, overlapping heuristic labellers vote bad, good or nothing
on every document, and the `labels` rows vote as one more labeller where they exist. Expectation-maximisation estimates each
labeller's rates from votes counted over all documents, which gives a document a posterior of being bad. The posteriors
train a logistic scorer on hashed words and word beginnings (and rule statistics, for quality) that decides on every text: `kept` is
false where either probability reaches CUT. A beginning counts once, twice and three times, by the distinct words that have it: families of
words tell more than each of their forms, in languages for which there is no list of words.

Vote patterns are counted before the estimation: its input has at most 3 ** labellers rows at any size. Which words tell is counted over
every document on which some labeller or label of the target votes, besides the sample. The weights are fitted on all documents, one of several
copies: a sample of FIT_ROWS documents (expected number, chosen by hash, labelled ones first) gives the weights to begin with, from which
every part of PART_ROWS documents goes on learning with all of its own, and the parts' weights are averaged. Documents that the
sample has less of count less there too, so that the sample bears on where learning begins, not on what is learnt from.

Null or empty text: kept false. Null labels vote nothing; doubled labels vote bad if any row does. Repeated rows get
a row each. Without labels nothing tells how good labellers are that never vote for good, and little is rejected. An empty table gives
an empty result.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_BYTES, IS_SPACE, bounded_batches, distinct, documents, lean, mix, random_words, swept, text_groups, word_hashes, written
from .quality_rules import COUNTS, STATS, batch_counts, rule_columns

FIT_ROWS = 6_000
#: Documents (expected number) that learn one after another, in parts that don't depend on how Spark deals the rows.
PART_ROWS = 8_000
#: Bytes of word beginnings that are features.
STARTS = (4, 6, 8)
#: A hash becomes a feature if its documents are bad this many standard deviations more or less often than all are.
MIN_Z, MIN_DOCS = 5.0, 4
#: Parts of one in which posteriors are added up, so that sums don't depend on their order; distinct hashes a task holds.
MICRO, HELD = 1_000_000, 1 << 20
#: Weights that cross between tasks in one row.
STATE = 1 << 14
#: Sums cross between tasks by blocks of hashes that agree in all but this many low bits, of 31.
BLOCK_BITS = 21
#: Texts whose so many smallest word hashes agree count as copies of one.
ALIKE = 16
EPOCHS, RATE, L2 = 15, 0.3, 1e-4
CUT = 0.5
#: The prior of bad stays below this: documents on which nobody votes would otherwise leave it undetermined.
MOST_BAD = 0.15
ROUNDS = 60
#: Common English insults, fixed values of one labeller.
INSULTS = "bastard clown creep disgusting dumb fool garbage idiot imbecile jerk loser moron pathetic scum scumbag stupid trash ugly vermin worthless"
#: target -> labeller -> (condition for bad, condition for good); neither: no vote. Their rates are estimated, not set.
LABELLERS: dict[str, dict[str, tuple[str, str]]] = {
    "quality": {
        "symbols": ("symbols > 0.05", "false"),
        "upper": ("upper > 0.3", "false"),
        "repeats": ("repeats > 0.4", "false"),
        "distinct": ("distinct < 0.25", "false"),
        "dup_lines": ("dup_lines > 0.3", "false"),
        "mean_word": ("mean_word < 2 or mean_word > 14", "false"),
        "plain": ("false", "symbols < 0.01 and upper < 0.1 and repeats < 0.1 and distinct > 0.3 and dup_lines < 0.1 and n_words > 0"),
    },
    "toxic": {"insults": ("n_insults > 0", "false")},  # a text in another language insults in other words
}
#: The columns that count how many texts have a word, and how bad they are; see word_counts().
_SHARES = [(k, t) for t in LABELLERS for k in ("n", "bad")]
GOLD = {"quality": "quality = 0", "toxic": "toxic = 1"}


def votes(target: str) -> list[Column]:
    """1 bad, 0 good, -1 nothing."""
    return [F.when(F.expr(bad), 1).when(F.expr(good), 0).otherwise(-1).alias(f"v_{target}_{k}") for k, (bad, good) in LABELLERS[target].items()]


def estimate(patterns: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Prior of bad, and rates[labeller, class, vote], by EM on vote patterns (-1, 0, 1) with their numbers of documents.

    Rates start from labellers that are right four times in five, the given labels from nearly always; a little is added
    to every count, so that no rate becomes 0.
    """
    k = patterns.shape[1]
    v = patterns + 1
    right = np.append(np.full(k - 1, 0.8), 0.9)
    rates = np.empty((k, 2, 3))
    for c in range(2):
        rates[:, c, 0] = 0.3
        rates[:, c, 1 + c], rates[:, c, 2 - c] = 0.7 * right, 0.7 * (1 - right)
    prior = 0.15
    for _ in range(ROUNDS):
        p = posterior(patterns, prior, rates)
        prior = float(np.clip((p * n).sum() / max(n.sum(), 1), 0.005, MOST_BAD))
        for j in range(k):
            # The added counts keep the orientation: a vote for a class is never taken as one against it.
            bad = np.bincount(v[:, j], weights=p * n, minlength=3)[1:] + [0.5, 4.0]
            good = np.bincount(v[:, j], weights=(1 - p) * n, minlength=3)[1:] + [4.0, 0.5]
            rates[j, 0, 1:], rates[j, 1, 1:] = good / good.sum(), bad / bad.sum()
            # What a one-sided labeller's vote tells is how much more often it fires on one class.
            if not (v[:, j] == 1).any() or not (v[:, j] == 2).any():
                fires = 2 if (v[:, j] == 2).any() else 1
                on = [(((1 - p) if c == 0 else p) * n * (v[:, j] == fires)).sum() / max((((1 - p) if c == 0 else p) * n).sum(), 1e-9) for c in range(2)]
                odds = np.clip((on[1] + 1e-4) / (on[0] + 1e-4), 1.5, 200) if fires == 2 else np.clip((on[0] + 1e-4) / (on[1] + 1e-4), 1.5, 20)
                hi, lo = odds / (1 + odds), 1 / (1 + odds)
                rates[j, 0, 1:], rates[j, 1, 1:] = (hi, lo), (lo, hi)
    return prior, rates


def posterior(patterns: np.ndarray, prior: float, rates: np.ndarray) -> np.ndarray:
    """Abstaining tells nothing: only votes count."""
    log = np.tile(np.log([1 - prior, prior]), (len(patterns), 1))
    for j in range(patterns.shape[1]):
        voted = patterns[:, j] >= 0
        share = rates[j, :, 1:] / rates[j, :, 1:].sum(1, keepdims=True)
        log[voted] += np.log(share[:, patterns[voted, j]]).T
    return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))


_LETTER, _PLACE = random_words(701, 256), random_words(702, 8)
_TIMES = {2: np.uint64(0x9E3779B97F4A), 3: np.uint64(0xC2B2AE3D27D4)}
_LOW = np.uint64((1 << 48) - 1)


def feature_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A key for every distinct word and beginning of some texts laid end to end: the text in the high 16 bits, a hash in the low 48.

    Words stand between single spaces, and a batch has fewer than 2 ** 16 texts.
    """
    h, own = word_hashes(data, offsets)
    if not len(h):
        return np.zeros(0, np.uint64)
    letter = ~IS_SPACE[data]
    head, tail = letter.copy(), letter.copy()
    head[1:] &= ~letter[:-1]
    tail[:-1] &= ~letter[1:]
    full = np.diff(offsets) > 0
    head[offsets[:-1][full]], tail[offsets[1:][full] - 1] = letter[offsets[:-1][full]], letter[offsets[1:][full] - 1]
    starts = np.flatnonzero(head)
    sizes = np.flatnonzero(tail) + 1 - starts
    key = (own.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    order = np.argsort(key)
    one = order[np.flatnonzero(np.diff(key[order], prepend=~key[order[0]]))]
    found = key[one]
    starts, sizes, own = starts[one], sizes[one], own[one].astype(np.uint64) << np.uint64(48)
    keys, acc = [found], np.zeros(len(one), np.uint64)
    for j in range(max(STARTS)):
        acc += _LETTER[data[np.minimum(starts + j, len(data) - 1)]] * _PLACE[j]
        if j + 1 in STARTS:
            long = sizes > j
            u, n = np.unique(own[long] | (mix(acc[long] + np.uint64(j)) >> np.uint64(16)), return_counts=True)
            keys += [u, *(u[n >= k] ^ c for k, c in _TIMES.items())]
    return np.concatenate(keys)


def hash_of(keys: np.ndarray) -> np.ndarray:
    return ((keys & _LOW) >> np.uint64(17)).astype(np.int32)


def text_features(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted 31-bit hashes of its distinct words and of their beginnings) of each text."""
    for first, last, data, offsets in text_groups(batch, column, 1 << 19):
        every = np.sort(feature_keys(data, offsets))
        at = np.searchsorted(every >> np.uint64(48), np.arange(last - first + 1).astype(np.uint64))
        for i in range(last - first):
            yield first + i, distinct(hash_of(every[at[i] : at[i + 1]]))


def plain_words(text: Column) -> Column:
    """Lower case, words only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ").cast("binary")


def rule_values(c: tuple[int, ...]) -> np.ndarray:
    """The STATS of one text's COUNTS, as rule_columns() has them."""
    n_words, chars, symbols, dup, repeat, upper, lines, distinct = c
    n, ch, ln = max(n_words, 1), max(chars, 1), max(lines, 1)
    return np.array([np.log1p(n_words), chars / n, symbols / ch, dup / ln, repeat / n, upper / ch, np.log1p(n / ln), distinct / n])


class Scorer:
    """Logistic regression on the presence of some hashed words and on statistics."""

    def __init__(self, words: np.ndarray, w: np.ndarray, stat_w: np.ndarray, bias: float, mean: np.ndarray, scale: np.ndarray):
        self.words, self.w, self.stat_w, self.bias, self.mean, self.scale = words, w, stat_w, bias, mean, scale
        #: Squared gradients so far, of AdaGrad.
        self.gw, self.gs, self.gb = np.ones(len(w)), np.ones(len(stat_w)), 1.0

    def copy(self) -> Scorer:
        made = Scorer(self.words, self.w.copy(), self.stat_w.copy(), self.bias, self.mean, self.scale)
        made.gw, made.gs, made.gb = self.gw.copy(), self.gs.copy(), self.gb
        return made

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -8, 8)

    def learn(self, own: np.ndarray, x: np.ndarray, y: float, weight: float) -> None:
        """One step of AdaGrad: own are the places of a document's words, x its scaled() statistics, y how likely it is bad."""
        m = self.bias + self.w[own].sum() + x @ self.stat_w
        g = weight * (1 / (1 + np.exp(-min(max(m, -30.0), 30.0))) - y)
        each = g + L2 * self.w[own]
        self.gw[own] += each * each
        self.w[own] -= RATE * each / np.sqrt(self.gw[own])
        self.gs += (g * x) ** 2
        self.stat_w -= RATE * g * x / np.sqrt(self.gs)
        self.gb += g * g
        self.bias -= RATE * g / np.sqrt(self.gb)

    def state(self) -> np.ndarray:
        return np.concatenate([self.w, self.stat_w, [self.bias]])

    def with_state(self, state: np.ndarray) -> Scorer:
        n = len(self.words)
        return Scorer(self.words, state[:n], state[n:-1], float(state[-1]), self.mean, self.scale)

    def word_margins(self, keys: np.ndarray, texts: int) -> np.ndarray:
        """What its words add to the margin of each text, from the keys of some texts."""
        if not len(self.words):
            return np.zeros(texts)
        h = hash_of(keys)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = self.words[at] == h
        return np.bincount((keys[hit] >> np.uint64(48)).astype(np.int64), weights=self.w[at[hit]], minlength=texts)

    def probability(self, word_margin: float, stats: np.ndarray) -> float:
        m = self.bias + word_margin + float(self.scaled(stats) @ self.stat_w)
        return float(1 / (1 + np.exp(-np.clip(m, -30, 30))))


def both_margins(low: Scorer, toxic: Scorer, batch: pa.RecordBatch, column: str) -> np.ndarray:
    """word_margins of both scorers for every text of a batch; most keys are ruled out by the high bits of their hash."""
    out = np.zeros((2, batch.num_rows))
    may = np.zeros(1 << 20, bool)
    may[low.words >> 11] = may[toxic.words >> 11] = True
    for first, last, data, offsets in text_groups(batch, column, 1 << 19):
        keys = feature_keys(data, offsets)
        keys = keys[may[hash_of(keys) >> 11]]
        for k, m in enumerate((low, toxic)):
            out[k, first:last] = m.word_margins(keys, last - first)
    return out


def train(vocabulary: np.ndarray, words: list[np.ndarray], stats: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 9) -> Scorer:
    """AdaGrad over documents with hashed words (those of the sorted vocabulary only), statistics, and probabilities of being bad."""
    k = stats.shape[1]
    if not len(y):
        return Scorer(np.zeros(0, np.int32), np.zeros(0), np.zeros(k), -5.0, np.zeros(k), np.ones(k))
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    made = Scorer(vocabulary, np.zeros(len(vocabulary)), np.zeros(k), float(np.log(share / (1 - share))), stats.mean(0), stats.std(0) + 1e-6)
    x = made.scaled(stats)
    own = [np.flatnonzero(np.isin(vocabulary, w, assume_unique=True)) for w in words]
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            made.learn(own[i], x[i], y[i], weight[i])
    return made


def packed(words: set[bytes]) -> tuple[int, bytes]:
    """The words of a text, sorted and compressed, behind their size: all that counting needs, in less than half of the bytes."""
    w = b" ".join(sorted(words))
    return len(w), zlib.compress(w, 1)


def packed_words(plain: DataFrame) -> DataFrame:
    """doc_id and, for plain, its distinct words as packed() has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [packed(set((p.as_py() or b"").split())) for p in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([z for _, z in rows], pa.binary())], names=["doc_id", "size", "packed"])

    return plain.select("doc_id", "plain").mapInArrow(lean(run), "doc_id long, size long, packed binary")


def unpacked(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch with plain for size and packed, in parts of BATCH_BYTES of text at most, or of one row."""
    if "packed" not in b.schema.names:
        yield b
        return
    size, packed = (b.column(b.schema.get_field_index(c)) for c in ("size", "packed"))
    ends = np.cumsum(size.to_numpy())
    first = 0
    while first < b.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BATCH_BYTES, side="right")))
        rest = b.slice(first, last - first).drop_columns(["size", "packed"])
        yield rest.append_column("plain", pa.array([zlib.decompress(z) for z in packed.slice(first, last - first).to_pylist()], pa.binary()))
        first = last


def added(words: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each word once, sorted, and its rows of sums added up."""
    w = np.concatenate(words)
    order = np.argsort(w, kind="stable")
    w = w[order]
    cuts = np.flatnonzero(np.diff(w, prepend=w[0] - 1 if len(w) else 0))
    return w[cuts], np.add.reduceat(np.concatenate(sums)[order], cuts) if len(w) else np.concatenate(sums)


_COLUMN = random_words(703, 2 * len(LABELLERS))


def _planes(x: np.ndarray) -> bytes:
    """Byte by byte of all numbers, which compresses better than number by number."""
    return np.ascontiguousarray(np.ascontiguousarray(x).reshape(-1, 1).view(np.uint8).T).tobytes()


def _numbers(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def coded(w: np.ndarray, s: np.ndarray) -> bytes:
    """Sorted words and their sums, compressed: gaps between words, and for each which of the different rows of sums it has; most have one of a few."""
    _, one, code = np.unique((s.astype(np.uint64) * _COLUMN[: s.shape[1]]).sum(1), return_index=True, return_inverse=True)
    if not np.array_equal(s[one][code], s):  # different sums that look alike
        one = code = np.arange(len(s))
    head = np.array([len(w), len(one)], "<i8").tobytes()
    return zlib.compress(head + _planes(np.diff(w, prepend=0).astype("<i4")) + _planes(code.astype("<i4")) + _planes(s[one].astype("<i8")), 1)


def decoded(z: bytes, columns: int) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(z)
    n, different = np.frombuffer(data[:16], "<i8").tolist()
    gap, code, sums = data[16 : 16 + 4 * n], data[16 + 4 * n : 16 + 8 * n], data[16 + 8 * n :]
    return np.cumsum(_numbers(gap, "<i4"), dtype=np.int64), _numbers(sums, "<i8").reshape(different, columns)[_numbers(code, "<i4")]


def word_counts(weighted: DataFrame) -> DataFrame:
    """word and, for each target, in how many texts (n_<target>) and how many of them bad, in MICRO parts (bad_<target>).

    weighted has plain (or size and packed, see packed_words()) and the same columns for a text. Each task adds up, and gives away its sums where they pass HELD words,
    in one coded() row for each block of hashes: rows of single words would be several times as large.
    """
    names = [f"{k}_{t}" for t in LABELLERS for k in ("n", "bad")]
    none = np.zeros(0, np.int64), np.zeros((0, len(names)), np.int64)

    def given(w: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        blocks = w >> BLOCK_BITS
        cuts = np.flatnonzero(np.diff(blocks, prepend=-1))
        for some in np.split(cuts, range(64, len(cuts), 64)) if len(cuts) else ():
            ends = np.append(cuts, len(w))[np.searchsorted(cuts, some) + 1]
            rows = [coded(w[a:b], s[a:b]) for a, b in zip(some, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks[some].astype(np.int32)), pa.array(rows, pa.binary())], names=["block", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = none
        for b in (part for whole in batches for part in unpacked(whole)):
            own = np.stack([b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in names], 1)
            for first, _, data, offsets in text_groups(b, "plain", 1 << 19):
                keys = feature_keys(data, offsets)
                keys = distinct((keys & ~_LOW) | hash_of(keys).astype(np.uint64))  # once a text
                part = added([(keys & _LOW).astype(np.int64)], [own[first + (keys >> np.uint64(48)).astype(np.int64)]])
                held, sums = added([held, part[0]], [sums, part[1]])
                if len(held) > HELD:
                    yield from given(held, sums)
                    held, sums = none
        yield from given(held, sums)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block: what is held are the sums of one block, and parts of it that are not added yet."""
        at, parts, size = None, [none], 0
        for b in batches:
            for block, z in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if block != at or size > HELD:
                    parts, size = [added(*map(list, zip(*parts, strict=True)))], 0
                    if block != at:
                        yield from rows(*parts[0])
                        at, parts = block, [none]
                parts.append(decoded(z.as_py(), len(names)))
                size += len(parts[-1][0])
        yield from rows(*added(*map(list, zip(*parts, strict=True))))

    def rows(w: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(w):
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), *(pa.array(np.ascontiguousarray(s[:, k])) for k in range(len(names)))], names=["word", *names])

    made = weighted.select(*(c for c in weighted.columns if c in ("plain", "size", "packed")), *names).mapInArrow(lean(run), "block int, sums binary")
    return made.repartition("block").sortWithinPartitions("block").mapInArrow(lean(total), "word int, " + ", ".join(f"{c} long" for c in names))


def telling_words(weighted: DataFrame) -> dict[str, np.ndarray]:
    """For each target the sorted hashes whose documents are bad clearly more or less often than all that count; see word_counts()."""
    total = weighted.agg(*(F.coalesce(F.sum(f"bad_{t}") / F.sum(f"n_{t}") / MICRO, F.lit(0.0)).alias(t) for t in LABELLERS)).first()
    told = []
    for t in LABELLERS:
        share, n = min(max(total[t], 1e-4), 1 - 1e-4), F.col(f"n_{t}")
        z = (F.col(f"bad_{t}") / MICRO - share * n) / F.sqrt(share * (1 - share) * n + 0.5)
        told.append(((n >= MIN_DOCS) & (F.abs(z) >= MIN_Z)).alias(t))
    found = word_counts(weighted).select("word", *told).where(" or ".join(LABELLERS)).toArrow()
    word = found.column("word").to_numpy()
    return {t: np.sort(word[found.column(t).to_numpy()]).astype(np.int32) for t in LABELLERS}


def gold(labels: DataFrame) -> DataFrame:
    """doc_id and one vote a target: bad if any row of the document says so, good if all that say something say good."""
    vote = {t: F.max(F.when(F.expr(bad), 1).when(F.col(t).isNotNull(), 0)).alias(f"v_{t}_label") for t, bad in GOLD.items()}
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*vote.values())


def fit(docs: DataFrame, labels: DataFrame, seed: int = 21) -> dict[str, Scorer]:
    insults = set(INSULTS.encode().split())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alike, told, z = [0] * b.num_rows, [0] * b.num_rows, [(0, b"")] * b.num_rows
            for first, last, data, offsets in text_groups(b, "plain"):
                h, own = word_hashes(data, offsets)
                ends = np.searchsorted(own, np.arange(last - first + 1))
                for i in range(last - first):
                    alike[first + i] = int(np.uint64(xxhash.xxh64_intdigest(distinct(h[ends[i] : ends[i + 1]])[:ALIKE].tobytes())).view(np.int64))
            for i, p in enumerate(b.column(2)):
                words = set((p.as_py() or b"").split())
                told[i], z[i] = len(insults & words), packed(words)
            rows = batch_counts(b, "text")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(alike, pa.int64()), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(COUNTS))), pa.array(told, pa.int64()), pa.array([n for n, _ in z], pa.int64()), pa.array([x for _, x in z], pa.binary())], names=["doc_id", "alike", *COUNTS, "n_insults", "size", "packed"])

    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), plain_words(text).alias("plain"))
    # Words and rules are taken from the texts once; all that follows reads this table, counting the words alone, the rest its other columns.
    measured = written(d.mapInArrow(lean(measure), "doc_id long, alike long, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_insults", "size")) + ", packed binary"), "quality-words")
    words = measured.where("doc_id is not null").select("doc_id", "size", "packed", *COUNTS)
    stats = measured.select("*", *rule_columns()).select("doc_id", "alike", *STATS, *(v for t in LABELLERS for v in votes(t)))
    named = {t: [*(f"v_{t}_{k}" for k in LABELLERS[t]), f"v_{t}_label"] for t in LABELLERS}
    last = [n[-1] for n in named.values()]
    stats = written(stats.join(gold(labels), "doc_id", "left").fillna(-1, last), "quality-votes")
    flat = [c for n in named.values() for c in n]
    found = stats.groupBy(*flat).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** labellers rows
    chance: dict[str, dict[tuple, float]] = {}
    for t, names in named.items():
        patterns = np.array([[r[c] for c in names] for r in found], np.int64).reshape(-1, len(names))
        n = np.array([r["n"] for r in found], float)
        chance[t] = {tuple(p): float(q) for p, q in zip(patterns, posterior(patterns, *estimate(patterns, n)), strict=True)} if found else {}
    marked = sum(r["n"] for r in found if max(r[c] for c in last) >= 0)
    rest = sum(r["n"] for r in found) - marked
    p_marked, p_rest = min(1.0, FIT_ROWS / max(marked, 1)), min(1.0, max(FIT_ROWS - marked, FIT_ROWS / 6) / max(rest, 1))
    pick = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < F.when(F.greatest(*last) >= 0, int(p_marked * (1 << 30))).otherwise(int(p_rest * (1 << 30)))
    sample = stats.where(pick).drop("alike").dropDuplicates(["doc_id"])

    likely = docs.sparkSession.createDataFrame([(*(int(r[c]) for c in flat), *(chance[t][tuple(r[c] for c in named[t])] for t in named)) for r in found], ", ".join(f"{c} int" for c in flat) + ", " + ", ".join(f"bad_{t} double" for t in named))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in unpacked(whole)):
            out: list[bytes | None] = [None] * b.num_rows
            for i, w in text_features(b, "plain"):
                out[i] = w.tobytes()
            at = b.schema.get_field_index
            yield pa.RecordBatch.from_arrays([b.column(at("doc_id")), pa.array(out, pa.binary()), *(b.column(at(c)) for c in (*STATS, *flat))], names=["doc_id", "words", *STATS, *flat])

    schema = "doc_id long, words binary, " + ", ".join(f"{s} double" for s in STATS) + ", " + ", ".join(f"{v} int" for v in flat)
    chosen = words.drop(*COUNTS).join(F.broadcast(sample), "doc_id").mapInArrow(lean(reduced), schema).join(F.broadcast(likely), flat)
    # Copies count once, or else their words would look like signs of whatever they are.
    chosen = written(chosen.withColumn("alike", F.substring("words", 1, 4 * ALIKE)).dropDuplicates(["alike"]).drop("alike"), "quality-sample")
    # Here too one of several copies counts, a labelled one if there is any.
    labelled = F.greatest(*last) >= 0
    one = F.max(F.struct(labelled.alias("marked"), "doc_id", *flat, pick.alias("pick")))
    apart = stats.where("doc_id is not null").groupBy("alike").agg(one.alias("one")).select("one.*").dropDuplicates(["doc_id"]).join(F.broadcast(likely), flat)
    counts_if = {t: (F.greatest(*names) >= 0) | F.col("pick") for t, names in named.items()}
    shares = [c for t, yes in counts_if.items() for c in (yes.cast("long").alias(f"n_{t}"), F.when(yes, F.round(F.col(f"bad_{t}") * MICRO)).otherwise(0).cast("long").alias(f"bad_{t}"))]
    # The sample's balance of labelled documents and others holds for all of them.
    balance = F.when(labelled, 1.0).otherwise(min(1.0, p_rest / p_marked))
    steps = [(F.when(F.col(n[-1]) >= 0, 1.0).otherwise(0.5) * balance).alias(f"weight_{t}") for t, n in named.items()]
    weights = written(apart.select("doc_id", *shares, *(f"bad_{t}" for t in named), *steps).toDF("doc_id", *(f"{k}_{t}" for k, t in _SHARES), *(f"y_{t}" for t in named), *(f"weight_{t}" for t in named)), "quality-weights")
    # Weights are as many as documents: they are merged with the words at every size, and not sent whole to all tasks while they are few.
    voted = weights.where(" or ".join(f"n_{t} > 0" for t in named)).select("doc_id", *(f"{k}_{t}" for k, t in _SHARES))
    vocabulary = telling_words(words.drop(*COUNTS).join(voted.hint("merge"), "doc_id"))
    start = {t: _fitted(chosen, t, names[-1], vocabulary[t]) for t, names in named.items()}
    swept(docs.sparkSession)  # the shuffle of all words goes before the next one comes
    return learnt(start, words, weights, sum(r["n"] for r in found))


def learnt(start: dict[str, Scorer], words: DataFrame, weights: DataFrame, n: int) -> dict[str, Scorer]:
    """Scorers that went on from start with every document of weights (doc_id, y_<target>, weight_<target>), each part by itself, averaged.

    words: doc_id, size, packed and COUNTS. A part's rows come one after another, weights before the words of their document. States are added up as whole
    numbers, in MICRO parts, so that the sums don't depend on their order.
    """
    begin = words.sparkSession.sparkContext.broadcast(start)
    parts = max(1, round(n / PART_ROWS))
    marks = [f"{k}_{t}" for t in start for k in ("y", "weight")]

    def dealt(d: DataFrame) -> DataFrame:
        at = F.xxhash64(F.lit(47), "doc_id")
        return d.withColumns({"at": at, "part": F.pmod(at, F.lit(parts))})

    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    rows = dealt(weights.select("doc_id", none("size", "long"), none("packed", "binary"), *(none(c, "long") for c in COUNTS), *marks))
    rows = rows.union(dealt(words.select("doc_id", "size", "packed", *COUNTS, *(none(c, "double") for c in marks))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets = list(begin.value)
        now: dict[str, Scorer] = {}
        part, mark, total, done = None, None, {t: np.zeros(len(m.state()), np.int64) for t, m in begin.value.items()}, 0

        def close() -> None:
            nonlocal done
            for t, m in now.items():
                total[t] += np.rint(m.state() * MICRO).astype(np.int64)
            done += bool(now)

        for whole in batches:
            col = lambda c, whole=whole: whole.column(whole.schema.get_field_index(c))
            # Each row of words with its document's weights, which may have come with the batch before.
            ids, own, sizes, told = (col(c).to_pylist() for c in ("doc_id", "part", "size", marks[0]))
            given = np.column_stack([col(c).to_numpy(zero_copy_only=False) for c in marks])
            use, y = [], []
            for i in range(whole.num_rows):
                if told[i] is not None:
                    mark = own[i], ids[i], given[i]
                elif sizes[i] is not None and mark is not None and mark[:2] == (own[i], ids[i]):
                    use.append(i)
                    y.append(mark[2])
            at = 0
            for b in unpacked(whole.take(pa.array(use, pa.int64()))) if use else ():
                stats = [rule_values(c) for c in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in COUNTS), strict=True)]
                dealt_to = b.column(b.schema.get_field_index("part")).to_pylist()
                places = {t: _places(begin.value[t].words, b) for t in targets}
                for i in range(b.num_rows):
                    if dealt_to[i] != part:
                        close()
                        part, now = dealt_to[i], {t: m.copy() for t, m in begin.value.items()}
                    for k, t in enumerate(targets):
                        m = now[t]
                        m.learn(places[t][i], m.scaled(stats[i] * (t == "quality")), *y[at][2 * k : 2 * k + 2])
                    at += 1
        close()
        if done:
            yield from told_apart((t, at, done, total[t][at : at + STATE]) for t in targets for at in range(0, len(total[t]), STATE))

    def told_apart(blocks: Iterable[tuple[str, int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for t, at, n, sums in blocks:
            yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([at], pa.int64()), pa.array([n], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["target", "place", "parts", "sums"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come sorted by target and place: one is held."""
        every = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True))
        for (t, at), block in itertools.groupby(every, lambda r: r[:2]):
            n, sums = 0, np.zeros(1, np.int64)
            for _, _, parts_in, z in block:
                n, sums = n + parts_in, sums + np.frombuffer(z, np.int64)
            yield from told_apart([(t, at, n, sums)])

    schema, by = "target string, place long, parts long, sums binary", ("target", "place")
    made = rows.repartition("part").sortWithinPartitions("part", "at", "doc_id", F.col("size").isNotNull(), "size", "packed").mapInArrow(lean(run), schema)
    states = {t: m.state() for t, m in start.items()}
    for r in made.repartition(*by).sortWithinPartitions(*by).mapInArrow(lean(summed), schema).collect():
        sums = np.frombuffer(r["sums"], np.int64)
        states[r["target"]][r["place"] : r["place"] + len(sums)] = sums / r["parts"] / MICRO
    return {t: m.with_state(states[t]) for t, m in start.items()}


def _places(vocabulary: np.ndarray, b: pa.RecordBatch) -> list[np.ndarray]:
    """For each text of a batch the places of its words in the sorted vocabulary."""
    out = [np.zeros(0, np.int64)] * b.num_rows
    if not len(vocabulary):
        return out
    for first, last, data, offsets in text_groups(b, "plain", 1 << 19):
        keys = feature_keys(data, offsets)
        h = hash_of(keys)
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        hit = vocabulary[at] == h
        keys = distinct((keys[hit] & ~_LOW) | at[hit].astype(np.uint64))
        cuts = np.searchsorted(keys >> np.uint64(48), np.arange(last - first + 1).astype(np.uint64))
        for i in range(last - first):
            out[first + i] = (keys[cuts[i] : cuts[i + 1]] & _LOW).astype(np.int64)
    return out


def _fitted(chosen: DataFrame, target: str, label: str, vocabulary: np.ndarray) -> Scorer:
    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index
            own = [np.intersect1d(np.frombuffer(w, np.int32), vocabulary, assume_unique=True).tobytes() for w in b.column(at("words")).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(at("doc_id")), pa.array(own, pa.binary()), *(b.column(at(c)) for c in (*STATS, "bad", "label"))], names=["doc_id", "words", *STATS, "bad", "label"])

    d = chosen.select("doc_id", "words", *STATS, F.col(f"bad_{target}").alias("bad"), F.col(label).alias("label"))
    rows = d.mapInArrow(lean(telling), "doc_id long, words binary, " + ", ".join(f"{s} double" for s in STATS) + ", bad double, label int").orderBy("doc_id", "words").collect()
    stats = np.array([[r[s] for s in STATS] for r in rows], float).reshape(-1, len(STATS)) * (target == "quality")
    return train(vocabulary, [np.frombuffer(r["words"], np.int32) for r in rows], stats, np.array([r["bad"] for r in rows]), np.array([1.0 if r["label"] >= 0 else 0.5 for r in rows]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of docs, and behind them quality__low, quality__toxic (probabilities) and quality__kept."""
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels))
    text = F.col("text").cast("string")
    helpers = ("quality__plain", "quality__raw")
    d = docs.withColumns({helpers[0]: plain_words(text), helpers[1]: text.cast("binary")})
    made = {"quality__low": T.DoubleType(), "quality__toxic": T.DoubleType(), "quality__kept": T.BooleanType()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, toxic = model.value["quality"], model.value["toxic"]
        for b in batches:
            p = np.ones((b.num_rows, 2))
            margins = both_margins(low, toxic, b, helpers[0])
            for i, c in enumerate(batch_counts(b, helpers[1]).tolist()):
                if c[0]:
                    s = rule_values(c)
                    p[i] = low.probability(margins[0][i], s), toxic.probability(margins[1][i], s)
            own = [k for k, name in enumerate(b.schema.names) if name not in helpers]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in own), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p.max(1) < CUT)], names=[*(b.schema.names[k] for k in own), *made])

    return d.mapInArrow(lean(score), T.StructType([*docs.schema.fields, *(T.StructField(k, t) for k, t in made.items())]))


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    return classify(docs, labels).where("quality__kept").drop("quality__low", "quality__toxic", "quality__kept")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = classify(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality__low").alias("low_quality"), F.col("quality__toxic").alias("toxic"), F.col("quality__kept").alias("kept"))
