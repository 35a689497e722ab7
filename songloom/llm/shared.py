"""Small helpers of the operators in this package."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def worker_value(key: tuple, build: Callable):
    """A value kept for the life of a Python worker, which outlives the functions it is sent.

    One value is kept, so a long-lived worker holds no more than its last stage needs.
    """
    store = sys.modules.setdefault("songloom_worker_values", types.ModuleType("songloom_worker_values")).__dict__
    kept = store.setdefault("kept", {})
    if key not in kept:
        while kept:
            kept.pop(next(iter(kept)))
        kept[key] = build()
    return kept[key]


def small_batches(spark: SparkSession, rows: int = 2048) -> None:
    """Let rows of whole texts go to Python in batches of a few megabytes instead of tens."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(df: DataFrame, text: str = "text") -> Column:
    """The text as a string, null as the empty one."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def sha(c: Column) -> Column:
    """Lowercase hex of the SHA-256 of a string's UTF-8 or of a binary."""
    return F.sha2(c.cast("binary"), 256)


def crc(c: Column) -> Column:
    """Unsigned CRC-32 of a string's UTF-8."""
    return F.crc32(c.cast("binary"))
