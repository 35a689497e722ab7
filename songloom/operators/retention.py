"""Retention of cached voice files. Nothing is deleted here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# File pattern, retention and sweep period.
CACHE_PATTERN = r"^sing_.*\.wav$"
RETENTION_DAYS = 5
SWEEP_S = 24 * 3600
DAY_US = 86_400_000_000


def is_cached_voice(name: Column) -> Column:
    return name.rlike("(?s)" + CACHE_PATTERN)


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("bigint")


def retention_expired(files: DataFrame, now, days: int = RETENTION_DAYS) -> DataFrame:
    """Cached voice files older than ``days`` at ``now`` (microseconds or a column).

    ``files(name, mtime)``. Zero or fewer days keeps everything.
    """
    if days <= 0:
        return files.select("name", "mtime").where(F.lit(False))
    old = F.col("mtime") < _column(now) - days * DAY_US
    return files.where(is_cached_voice(F.col("name")) & old).select("name", "mtime")


def sweep_tick(mtime: Column, start: Column, days: int = RETENTION_DAYS, period_s: int = SWEEP_S) -> Column:
    """First sweep strictly later than the moment a file falls out of retention."""
    period = F.lit(period_s * 1_000_000).cast("bigint")
    late = mtime + days * DAY_US - start
    return F.greatest(start, start + period * ((late - F.pmod(late, period)) / period + 1).cast("bigint"))


def retention_sweep(files: DataFrame, start, days: int = RETENTION_DAYS, period_s: int = SWEEP_S) -> DataFrame:
    """Files removed by each sweep, sweeps running at ``start`` and each period after."""
    if days <= 0:
        return files.select(F.lit(None).cast("bigint").alias("tick"), F.lit(0).cast("bigint").alias("removed")).where(F.lit(False))
    return (
        files.where(is_cached_voice(F.col("name")))
        .groupBy(sweep_tick(F.col("mtime"), _column(start), days, period_s).alias("tick"))
        .agg(F.count(F.lit(1)).alias("removed"))
    )
