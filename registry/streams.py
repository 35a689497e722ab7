"""Streaming queries: the event table replayed as a stream until nothing is left.

A last row far in the future moves the watermark past everything, so the
streams give whole results; no stream ever emits that row itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import state as batch, views as v
from registry.core import query, table
from songloom.operators import state
from songloom.session import fresh_path
from songloom.streaming import dedup, delivery, replay, retention, sessions, upsert

FAR = "2200-01-01 00:00:00"


def _stream(spark, schema, folder, name):
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def event_stream(spark, sf):
    """Events as a stream, with ``ts`` as a timestamp and ``t`` in microseconds."""
    events = table(spark, sf, "events")
    last = fresh_path(spark, "last-row")
    events.sparkSession.range(1).select(
        F.lit(-1).cast("bigint").alias("event_id"), F.lit(FAR).cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("bigint").alias("user_id"),
        F.lit("purchase").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    ).coalesce(1).write.parquet(last)
    both = _stream(spark, events.schema, sf.rstrip("/"), "events.parquet").unionByName(_stream(spark, events.schema, last, "*.parquet"))
    return both.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("t", F.unix_micros("ts"))


@query("stream_dedup_window", batch._COUNTS.format(tag="user"), ("runs_user",))
def stream_dedup_window(spark, sf):
    decided = dedup.stream_dedup_requests(v.as_requests(event_stream(spark, sf), "ts"))
    return batch.dedup.dedup_window(replay.run_available(decided, "dedup"))


@query("stream_dedup_leader", "SELECT id AS request_id, stream, leader_id, reused, ok FROM runs_user", ("runs_user",))
def stream_dedup_leader(spark, sf):
    return replay.run_available(dedup.stream_dedup_requests(v.as_requests(event_stream(spark, sf), "ts")), "dedup")


@query("stream_dedup_unfinished", "SELECT id AS request_id, leader_id, reused, ok FROM runs_open_user", ("runs_open_user",))
def stream_dedup_unfinished(spark, sf):
    """Some requests have not ended: whatever follows on their key joins them."""
    requests = batch.unfinished(v.as_requests(event_stream(spark, sf), "ts"))
    return replay.run_available(dedup.stream_dedup_requests(requests), "dedup").select("request_id", "leader_id", "reused", "ok")


@query("stream_delivery", f"SELECT attempt_id, {batch._OUTCOME} AS outcome, {batch._NOTICE} AS notice FROM attempts", ("attempts",))
def stream_delivery(spark, sf):
    sent = event_stream(spark, sf).select(F.col("event_id").alias("attempt_id"), F.col("ts").alias("sent_ts"))
    back = v.as_results(event_stream(spark, sf)).select(
        "attempt_id", F.timestamp_micros("returned").alias("returned_ts"), "result")
    done = replay.run_available(delivery.stream_delivery(sent, back), "delivery")
    return done.where(F.col("attempt_id") >= 0)


@query("stream_retention", """SELECT (mtime // 86400000000 + 6) * 86400000000 AS tick, count(*) AS removed FROM files
WHERE name LIKE 'sing\\_%.wav' ESCAPE '\\' GROUP BY 1""", ("files",))
def stream_retention(spark, sf):
    files = event_stream(spark, sf).select(v.file_name().alias("name"), F.col("ts").alias("mtime_ts"))
    swept = replay.run_available(retention.stream_retention(files), "retention")
    return swept.select(F.unix_micros("tick").alias("tick"), "removed")


@query("stream_sessions", batch._with_polls(batch._sessions(600, 60)))
def stream_sessions(spark, sf):
    polls = v.as_polls(event_stream(spark, sf))
    return replay.run_available(sessions.stream_sessions(polls, "1 day", 600, 60), "sessions")


@query("stream_upsert", """SELECT user_id AS key, arg_max(props, (t, event_id)) AS value, max(t) AS ts FROM ev GROUP BY user_id""", ("ev",))
def stream_upsert(spark, sf):
    writes = v.as_sections(event_stream(spark, sf).where(F.col("event_id") >= 0))
    return upsert.stream_upsert(writes, fresh_path(spark, "sections")).drop("seq")


@query("stream_upsert_compacted", """SELECT user_id AS key, arg_max(props, (t, event_id)) AS value, max(t) AS ts FROM ev GROUP BY user_id""", ("ev",))
def stream_upsert_compacted(spark, sf):
    """Half of the events, a snapshot, then the others into the same table."""
    path = fresh_path(spark, "sections")
    events = v.events(spark, sf)
    half = F.pmod("event_id", F.lit(2)) == 0
    state.upsert_latest(v.as_sections(events.where(half))).write.parquet(f"{path}/batches/batch=0")
    upsert.compact(spark, path)
    state.upsert_latest(v.as_sections(events.where(~half))).write.parquet(f"{path}/batches/batch=1")
    return upsert.read_latest(spark, path).drop("seq")
