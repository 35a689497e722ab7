"""Outcomes of voice deliveries: deadlines, late confirmations, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from songloom.functions.columns import seconds_to_micros

# Deadlines in seconds, size gate in bytes, method order.
SEND_DEADLINE_S = 180
LATE_WATCH_S = 1800
FALLBACK_MAX_BYTES = 8 * 1024 * 1024
METHODS = ("voiceurl", "record", "voice")


def outcome_of(latency_us: Column, result: Column, deadline_s: float = SEND_DEADLINE_S) -> Column:
    """``sent``/``failed``/``unknown`` from the latency and ``true``/``false``/``raised``."""
    in_time = F.coalesce(latency_us <= seconds_to_micros(deadline_s), F.lit(False))
    return (
        F.when(in_time & (result == "true"), "sent").when(in_time & (result == "false"), "failed").otherwise("unknown")
    )


def notice_of(
    latency_us: Column, result: Column, deadline_s: float = SEND_DEADLINE_S, watch_s: float = LATE_WATCH_S
) -> Column:
    """What the watch of a late attempt ends in; null if it was never watched."""
    soft, last = seconds_to_micros(deadline_s), seconds_to_micros(deadline_s + watch_s)
    return (
        F.when(latency_us <= soft, F.lit(None).cast("string"))
        .when(latency_us.isNull() | (latency_us > last), "abandoned")
        .when(result == "true", "notice")
        .otherwise("silent")
    )


def _latencies(sends: DataFrame, results: DataFrame) -> DataFrame:
    """Attempts with the first result of each; further results of an attempt say nothing new."""
    first = results.where(F.col("returned").isNotNull()).groupBy("attempt_id").agg(F.min(F.struct("returned", "result")).alias("_r"))
    joined = sends.select("attempt_id", "sent").join(first.select("attempt_id", "_r.returned", "_r.result"), "attempt_id", "left")
    return joined.withColumn("_lat", F.col("returned") - F.col("sent"))


def delivery_outcome(sends: DataFrame, results: DataFrame, deadline_s: float = SEND_DEADLINE_S) -> DataFrame:
    """Outcome per attempt. ``sends(attempt_id, sent)``, ``results(attempt_id,
    returned, result)``, times in microseconds; the first result counts, none means unknown."""
    return _latencies(sends, results).select(
        "attempt_id", outcome_of(F.col("_lat"), F.col("result"), deadline_s).alias("outcome")
    )


def late_confirm(
    sends: DataFrame, results: DataFrame, deadline_s: float = SEND_DEADLINE_S, watch_s: float = LATE_WATCH_S
) -> DataFrame:
    """Watched attempts only: one ``notice``, ``silent`` or ``abandoned`` each."""
    return (
        _latencies(sends, results)
        .select("attempt_id", notice_of(F.col("_lat"), F.col("result"), deadline_s, watch_s).alias("notice"))
        .where(F.col("notice").isNotNull())
    )


def method_rank(method: Column) -> Column:
    order = F.create_map(*[F.lit(v) for i, m in enumerate(METHODS, start=1) for v in (m, i)])
    return F.try_element_at(order, method)


def delivery_fallback(attempts: DataFrame, max_bytes: int = FALLBACK_MAX_BYTES) -> DataFrame:
    """Method that settles each message. ``attempts(message_id, method, outcome, size)``.

    The first method in order that did not fail settles it; ``unknown`` is never
    retried. Files over the gate have no second method; methods outside the order
    settle nothing.
    """
    rank = method_rank(F.col("method"))
    allowed = attempts.withColumn("_rank", rank).where(
        (F.col("_rank") == 1) | F.col("_rank").isNotNull() & (F.col("size") <= max_bytes)
    )
    settled = F.struct((F.col("outcome") == "failed").alias("failed"), F.when(F.col("outcome") == "failed", -F.col("_rank")).otherwise(F.col("_rank")).alias("order"))
    return (
        allowed.groupBy("message_id")
        .agg(F.min_by(F.struct("method", "outcome"), settled).alias("s"))
        .select("message_id", "s.method", "s.outcome", (F.col("s.outcome") == "sent").alias("delivered"))
    )


def transport_plan(files: DataFrame, max_bytes: int = FALLBACK_MAX_BYTES) -> DataFrame:
    """Rows and base64 bytes per stream and route. ``files(stream, size)``."""
    encoded = F.lit(4).cast("bigint") * F.ceil(F.col("size") / 3)
    route = F.when(F.col("size") <= max_bytes, "base64").otherwise("file_only")
    return (
        files.select("stream", route.alias("route"), encoded.alias("_e"))
        .groupBy("stream", "route").agg(F.count(F.lit(1)).alias("n"), F.sum("_e").cast("bigint").alias("encoded_bytes"))
    )
