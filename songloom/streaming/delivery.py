"""Deliveries on two streams: what was sent and what came back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from songloom.functions.columns import micros
from songloom.operators.delivery import LATE_WATCH_S, SEND_DEADLINE_S, notice_of, outcome_of


def stream_delivery(
    sends: DataFrame, results: DataFrame, deadline_s: int = SEND_DEADLINE_S, watch_s: int = LATE_WATCH_S,
    lateness: str = "10 minutes",
) -> DataFrame:
    """``attempt_id, outcome, notice`` per attempt.

    ``sends(attempt_id, sent_ts)``, ``results(attempt_id, returned_ts, result)``.
    A result is matched only inside deadline plus watch; an attempt without one
    is emitted as abandoned once both watermarks have passed that range.
    """
    s = sends.withWatermark("sent_ts", lateness).alias("s")
    r = results.withWatermark("returned_ts", lateness).alias("r")
    span = F.expr(f"INTERVAL {deadline_s + watch_s} SECONDS")
    joined = s.join(
        r,
        (F.col("s.attempt_id") == F.col("r.attempt_id"))
        & (F.col("r.returned_ts") >= F.col("s.sent_ts"))
        & (F.col("r.returned_ts") <= F.col("s.sent_ts") + span),
        "leftOuter",
    )
    latency = micros(F.col("r.returned_ts")) - micros(F.col("s.sent_ts"))
    return joined.select(
        F.col("s.attempt_id").alias("attempt_id"),
        outcome_of(latency, F.col("r.result"), deadline_s).alias("outcome"),
        notice_of(latency, F.col("r.result"), deadline_s, watch_s).alias("notice"),
    )
