"""Retention counts on a stream of file times."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from songloom.operators.retention import RETENTION_DAYS, is_cached_voice


def stream_retention(
    files: DataFrame, days: int = RETENTION_DAYS, period: str = "1 day", lateness: str = "10 minutes"
) -> DataFrame:
    """Files removed by each periodic sweep: ``tick`` (timestamp), ``removed``.

    ``files(name, mtime_ts)``. Sweeps fall on multiples of the period since the
    epoch. A file leaves in the first sweep after its retention ends, which is
    the end of the tumbling window that holds that moment.
    """
    due = files.where(is_cached_voice(F.col("name"))).withWatermark("mtime_ts", lateness)
    return (
        due.groupBy(F.window("mtime_ts", period).alias("w"))
        .agg(F.count(F.lit(1)).alias("removed"))
        .select((F.col("w.end") + F.expr(f"INTERVAL {days} DAYS")).alias("tick"), "removed")
    )
