"""Login sessions on a stream of polls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from songloom.operators.state import QUICK_TIMEOUT_S, emit_transitions, transition_aggregates


def stream_sessions(
    polls: DataFrame, gap: str, timeout_s: float = QUICK_TIMEOUT_S, reminder_after_s: float | None = None,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Reports of each session, emitted when ``gap`` passes without a poll.

    ``polls(session, start, t, seq, state, ts)``. The session window keeps only
    the mergeable minima of the batch form, never the list of polls.
    """
    closed = (
        polls.withWatermark("ts", lateness)
        .groupBy("session", F.session_window("ts", gap).alias("w"))
        .agg(*transition_aggregates(timeout_s, reminder_after_s))
    )
    return emit_transitions(closed, timeout_s, reminder_after_s)
