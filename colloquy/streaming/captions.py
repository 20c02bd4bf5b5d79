"""Streams of versioned captions and of session exports."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import shared_path

UPSERT_SCHEMA = "session long, key string, version long, text string, start_ms long, end_ms long, accepted long"
STATE_SCHEMA = "version long, text string, start_ms long, end_ms long, accepted long"


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder as a file stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 64).parquet(folder)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def drained(stream: DataFrame, what: str, mode: str = "append") -> DataFrame:
    """Everything a stream gives for what is there now, as a table: batch, and its columns.

    Each micro-batch replaces its own folder, so a batch run again after a failure leaves its rows once.
    """
    spark = stream.sparkSession
    path, state = shared_path(spark, what), shared_path(spark, f"{what}-checkpoint")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    return spark.read.schema(f"{_ddl(stream)}, batch long").parquet(path)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def accept_versions(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps the newest version of a caption; a late or repeated version changes nothing and emits nothing."""
    top = state.get if state.exists else (-1, None, None, None, 0)
    before = top[0]
    for row in pd.concat(list(frames)).sort_values(["at_ms", "ord"]).itertuples(index=False):
        if row.version > top[0]:
            start = row.at_ms if top[2] is None else top[2]
            top = (int(row.version), row.text, int(start), max(int(row.at_ms), top[3] or 0), top[4] + 1)
    if top[0] > before:
        state.update(top)
        yield pd.DataFrame([[key[0], key[1], *top]], columns=[c.split()[0] for c in UPSERT_SCHEMA.split(", ")])


def version_upserts(events: DataFrame) -> DataFrame:
    """A stream of UPSERT_SCHEMA rows, one a key and micro-batch that accepts a version; events: session, key, ord, version, text, at_ms."""
    return events.groupBy("session", "key").applyInPandasWithState(accept_versions, UPSERT_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)


def latest(upserts: DataFrame) -> DataFrame:
    """The state of every key after all upserts."""
    cols = ("version", "text", "start_ms", "end_ms", "accepted")
    return upserts.groupBy("session", "key").agg(F.max_by(F.struct(*cols), "version").alias("s")).select("session", "key", "s.*")


def finalised(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Utterances of a key: events no more than gap apart, closed by inactivity; events later than `late` are dropped."""
    return events.withWatermark("at", late).groupBy("session", "key", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("events"), F.min("at").alias("first_at"), F.max("at").alias("last_at")).drop("session_window")


def first_seen(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Events once a key, within the watermark: state of keys older than `late` is let go."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)
