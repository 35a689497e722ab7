"""Keyed upsert from a stream, into a table of generations.

A table is a folder: ``batches`` holds one reduced folder per micro-batch,
``snapshots`` what :func:`compact` made of all batches up to one, ``manifest``
one row per snapshot, written last. The newest row of the manifest is the
current generation: a reader takes its snapshot and the batches after it. Older
folders go by :func:`retire`, but not while a reader holds their generation.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from songloom.operators.state import upsert_latest
from songloom.session import delete_path
from songloom.streaming.replay import run_batches

_SCHEMA = "key {key}, value string, ts bigint, seq bigint"


def stream_upsert(writes: DataFrame, table: str, name: str = "upsert") -> DataFrame:
    """Keep the latest section per key in the Parquet table at ``table``.

    Each micro-batch is reduced to one row per key and written to its own
    folder, replacing what a repeated batch left there; readers take the latest
    over the newest snapshot and the batches after it. A batch therefore costs
    its own size, not the table's. :func:`compact` and :func:`retire` may run
    between batches. Null is a key like any other.
    """
    key_type = writes.schema["key"].dataType.simpleString()

    def each(batch: DataFrame, batch_id: int) -> None:
        upsert_latest(batch).write.mode("overwrite").parquet(f"{table}/batches/batch={batch_id}")

    run_batches(writes, name, each)
    return read_latest(writes.sparkSession, table, key_type)


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What lies at ``path``, nothing if it is not there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _largest(spark: SparkSession, path: str, column: str) -> int:
    """The greatest number there, -1 if none."""
    found = _rows(spark, path, f"{column} bigint").agg(F.max(column)).first()[0]
    return -1 if found is None else found


def generation(spark: SparkSession, table: str) -> int:
    """The last batch folded into the current snapshot, -1 without a snapshot."""
    return _largest(spark, f"{table}/manifest", "upto")


def _state(spark: SparkSession, table: str, key_type: str, upto: int) -> DataFrame:
    """Rows that the state of a generation follows from: its snapshot and all batches after it."""
    schema = _SCHEMA.format(key=key_type)
    newer = _rows(spark, f"{table}/batches", f"{schema}, batch bigint").where(F.col("batch") > upto).drop("batch")
    if upto < 0:
        return newer
    return spark.read.schema(schema).parquet(f"{table}/snapshots/upto={upto}").unionByName(newer)


def read_latest(spark: SparkSession, table: str, key_type: str = "bigint") -> DataFrame:
    """The current state; use :func:`reading` where folders may be retired meanwhile."""
    return upsert_latest(_state(spark, table, key_type, generation(spark, table)))


def compact(spark: SparkSession, table: str, key_type: str = "bigint") -> int:
    """Fold all batches so far into a snapshot, named by the last of them; returns that batch.

    The snapshot counts only once its row is in the manifest, which is the last
    thing written: readers see the old generation or the new one. A repeated
    call overwrites its own snapshot.
    """
    upto = generation(spark, table)
    last = _largest(spark, f"{table}/batches", "batch")
    if last > upto:
        rows = _state(spark, table, key_type, upto)
        upsert_latest(rows).write.mode("overwrite").parquet(f"{table}/snapshots/upto={last}")
        spark.range(1).select(F.lit(last).cast("bigint").alias("upto")).coalesce(1).write.mode("append").parquet(f"{table}/manifest")
    return max(last, upto)


@contextmanager
def reading(spark: SparkSession, table: str, key_type: str = "bigint") -> Iterator[DataFrame]:
    """The current state, whose folders stay until the block ends.

    The reader leaves a note of its generation and then looks whether that was
    being retired; :func:`retire` announces what it retires and then looks for
    notes. Whichever comes second sees the other.
    """
    while True:
        upto, note = generation(spark, table), f"{table}/readers/reader={uuid.uuid4().hex}"
        spark.range(1).select(F.lit(upto).cast("bigint").alias("upto")).coalesce(1).write.parquet(note)
        if _largest(spark, f"{table}/retired", "upto") <= upto:
            break
        delete_path(spark, note)
    try:
        yield upsert_latest(_state(spark, table, key_type, upto))
    finally:
        delete_path(spark, note)


def _held(spark: SparkSession, table: str, newest: int) -> int:
    """The oldest generation that a reader holds, ``newest`` if none does."""
    found = _rows(spark, f"{table}/readers", "upto bigint").agg(F.min("upto")).first()[0]
    return newest if found is None else min(found, newest)


def retire(spark: SparkSession, table: str) -> int:
    """Delete snapshots and batches that no reader needs any more; returns the oldest generation kept."""
    oldest = _held(spark, table, generation(spark, table))
    if oldest < 0:
        return oldest
    spark.range(1).select(F.lit(oldest).cast("bigint").alias("upto")).coalesce(1).write.mode("append").parquet(f"{table}/retired")
    oldest = _held(spark, table, oldest)
    for folder, column, gone in (("snapshots", "upto", F.col("upto") < oldest), ("batches", "batch", F.col("batch") <= oldest)):
        numbers = _rows(spark, f"{table}/{folder}", f"{column} bigint").where(gone).select(column).distinct()
        for row in numbers.toLocalIterator():
            delete_path(spark, f"{table}/{folder}/{column}={row[0]}")
    return oldest
