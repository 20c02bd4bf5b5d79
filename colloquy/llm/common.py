"""Helpers shared by the training-data operators: whole-text batches, words, and tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 spelling of a word: a run of characters other than space and the five ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch, so that a batch of very long documents stays small in a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spare(df: DataFrame, name: str) -> str:
    """A column name that df hasn't got: the name itself or, where it is taken, with underscores behind it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at BATCH_ROWS rows or BATCH_BYTES bytes, whichever comes first."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which its worker gives back the memory that it has freed.

    Workers stay for later tasks, also of other stages, and the allocators keep what was freed: an executor would hold the peaks of several workers at once.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc
                libc.malloc_trim(0)

    return made


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one is named only where none is set (single-machine runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def swept(spark: SparkSession) -> None:
    """Asks the driver to collect its garbage, after which Spark removes the shuffles that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, what: str, *partition_by: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and survives lost executors.

    Nothing reads the shuffles behind it any more. Spark's cleaner removes them once the driver has collected its garbage, which can take
    many stages, so it is asked to: else the disks hold the shuffles of all stages at once.
    """
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    swept(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the text as UTF-8 bytes, and the columns named; other columns stay behind, whatever their names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *more)


def words(text: bytes | None) -> list[bytes]:
    """bytes.split() cuts at space and tab to carriage return, and at nothing else."""
    return text.split() if text else []


def text_groups(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20):
    """(first row, last row, bytes, offsets) of runs of whole texts with about `most` bytes together; nulls count as empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    rows = [t or b"" for t in texts.to_pylist()]
    first, size = 0, 0
    for i, t in enumerate(rows):
        size += len(t)
        if size >= most or i == len(rows) - 1:
            part = rows[first : i + 1]
            ends = np.cumsum([len(x) for x in part])
            yield first, i + 1, np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], ends]).astype(np.int64)
            first, size = i + 1, 0


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted values, each once; sorting is faster here than np.unique()."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def random_words(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same in every task."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = random_words(11, 256)
_BYTE[IS_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Its inverse in 64 bits.
_UNDO = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[np.uint64, np.ndarray] = {}


def _powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    made = _POWERS.get(base)
    if made is None or len(made) < n:
        made = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 12) - 1, base)]))
        if n <= 2 * HASHED:
            _POWERS[base] = made
    return made[:n]


#: Bytes of text that are hashed at a time; they end at white space, so only a word longer than this takes more.
HASHED = 1 << 18


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of some texts laid end to end, and the text that each word is in."""
    parts, at = [], 0
    while len(data) - at > HASHED:
        end = at + HASHED
        while end < len(data) and not len(space := np.flatnonzero(IS_SPACE[data[end : end + HASHED]])):
            end += HASHED
        end = min(len(data), end + (int(space[0]) if end < len(data) else 0))
        parts.append(_word_hashes(data[at:end], np.clip(offsets, at, end) - at))
        at = end
    parts.append(_word_hashes(data[at:], np.clip(offsets, at, None) - at))
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letter = (data - np.uint8(9) > 4) & (data != 32)
    head = letter.copy()
    head[1:] &= ~letter[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    head[begins] = letter[begins]
    starts = np.flatnonzero(head)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # Powers run on over all words; what stood before a word is divided out of its sum.
    sums = np.cumsum(_BYTE[data] * _powers(len(data)))
    h = (np.append(sums[starts[1:] - 1], sums[-1]) - np.where(starts > 0, sums[starts - 1], np.uint64(0))) * _powers(len(data), _UNDO)[starts]
    return mix(h), np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
