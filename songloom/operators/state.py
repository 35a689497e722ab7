"""Login poll logs, keyed sections and key sharding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from songloom.functions.columns import seconds_to_micros
from songloom.functions.hashing import hash33

# Poll limits in seconds.
QUICK_TIMEOUT_S = 180
PATIENT_TIMEOUT_S = 600
REMINDER_AFTER_S = 60
TERMINAL = ("expired", "success")


def transition_aggregates(timeout_s: float, reminder_after_s: float | None) -> list[Column]:
    """Mergeable aggregates over ``start, t, seq, state`` that decide a session.

    Only minima are kept, so a session of any length combines map-side.
    """
    waited = F.col("t") - F.col("start")
    alive = waited <= seconds_to_micros(timeout_s)
    when = F.struct("t", "seq")
    cols = [
        F.min("start").alias("_start"),
        F.min(F.when(alive & (F.col("state") == "scanned"), when)).alias("_scanned"),
        F.min(F.when(alive & F.col("state").isin(*TERMINAL), F.struct("t", "seq", "state"))).alias("_end"),
    ]
    if reminder_after_s is not None:
        late = waited > seconds_to_micros(reminder_after_s)
        cols.append(F.min(F.when(alive & late, when)).alias("_late"))
    return cols


def emit_transitions(sessions: DataFrame, timeout_s: float, reminder_after_s: float | None) -> DataFrame:
    """Rows from the aggregates: first scan, reminder, then the end or a timeout."""
    before_end = lambda c: c.isNotNull() & (
        F.col("_end").isNull() | (F.struct(c["t"], c["seq"]) <= F.struct(F.col("_end")["t"], F.col("_end")["seq"]))
    )
    row = lambda state, at, terminal: F.struct(
        state.alias("state"), at.cast("bigint").alias("at_ts"), F.lit(terminal).alias("terminal")
    )
    scanned = F.when(before_end(F.col("_scanned")), row(F.lit("scanned"), F.col("_scanned")["t"], False))
    rows = [scanned]
    if reminder_after_s is not None:
        # the first poll that is both late enough and not before the scan
        at = F.greatest(F.col("_late"), F.col("_scanned"))
        due = F.col("_late").isNotNull() & F.col("_scanned").isNotNull() & before_end(at)
        rows.append(F.when(due, row(F.lit("reminded"), at["t"], False)))
    timeout = F.col("_start") + seconds_to_micros(timeout_s)
    rows.append(row(F.coalesce(F.col("_end")["state"], F.lit("timeout")), F.coalesce(F.col("_end")["t"], timeout), True))
    return sessions.select("session", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("session", "r.*")


def state_transitions(
    polls: DataFrame, timeout_s: float = QUICK_TIMEOUT_S, reminder_after_s: float | None = None
) -> DataFrame:
    """What a login session reports. ``polls(session, start, t, seq, state)``.

    The first scan is reported once, the first expiry or success ends the
    session, later polls are ignored, and without an end the session times out.
    With ``reminder_after_s`` one reminder follows a scan that waits longer.
    """
    sessions = polls.groupBy("session").agg(*transition_aggregates(timeout_s, reminder_after_s))
    return emit_transitions(sessions, timeout_s, reminder_after_s)


def upsert_latest(writes: DataFrame) -> DataFrame:
    """Latest value per key. ``writes(key, value, ts, seq)``; ``seq`` breaks ties."""
    return (
        writes.groupBy("key").agg(F.max_by(F.struct("value", "ts", "seq"), F.struct("ts", "seq")).alias("w"))
        .select("key", "w.value", "w.ts", "w.seq")
    )


def upsert_into(snapshot: DataFrame, writes: DataFrame) -> DataFrame:
    """Snapshot with written keys replaced and all others kept; null is a key like any other."""
    fresh = upsert_latest(writes)
    written = fresh.select(F.col("key").alias("_key"))
    kept = snapshot.select("key", "value", "ts", "seq").join(written, F.col("key").eqNullSafe(F.col("_key")), "left_anti")
    return kept.unionByName(fresh)


def hash33_shards(rows: DataFrame, column: str, shards: int, seed: int = 0) -> DataFrame:
    """Rows per shard of a text key."""
    shard = F.pmod(hash33(F.col(column), seed), F.lit(shards).cast("bigint"))
    return rows.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
