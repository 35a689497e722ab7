"""Streams over several micro-batches against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from registry import state as state_queries, streams, views as v
from songloom.operators import dedup, delivery, retention, state
from songloom.session import fresh_path
from songloom.streaming import dedup as sd, delivery as sv, replay, retention as sr, sessions as ss, upsert as su
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def parts(spark):
    """Events in eight files, rows of neighbouring files mixed, then a far last row."""
    folder = fresh_path(spark, "parts")
    ev = spark.read.parquet(f"{SMALL}/events.parquet").orderBy("event_id").toPandas()
    n, rnd = len(ev), random.Random(1)
    # rows move by up to an hour or so of log time, less than the lateness used below
    order = sorted(range(n), key=lambda i: i + rnd.uniform(0, 3))
    schema = spark.read.parquet(f"{SMALL}/events.parquet").schema
    for k in range(8):
        chunk = ev.iloc[order[k * n // 8:(k + 1) * n // 8]]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(folder)
    spark.range(1).select(
        F.lit(-1).cast("bigint").alias("event_id"), F.lit(streams.FAR).cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("bigint").alias("user_id"),
        F.lit("purchase").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    ).coalesce(1).write.mode("append").parquet(folder)
    return folder, schema


@pytest.fixture
def stream(spark, parts):
    folder, schema = parts
    return lambda: (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        .withColumn("ts", F.col("ts").cast("timestamp")).withColumn("t", F.unix_micros("ts")))


LATE = "3 days"


def rows(df, *cols):
    return sorted(df.select(*cols).collect(), key=str)


@pytest.mark.parametrize("window_s", [600, 86400])
def test_dedup(spark, stream, window_s):
    out = replay.run_available(sd.stream_dedup_requests(v.as_requests(stream(), "ts"), window_s, LATE), "dedup")
    want = dedup.dedup_requests(v.requests(spark, SMALL), window_s)
    cols = ["request_id", "leader_id", "reused", "ok"]
    assert rows(out, *cols) == rows(want, *cols)


@pytest.mark.parametrize("groups", [1, 3])
def test_dedup_state_does_not_grow_with_keys(spark, stream, groups):
    """Keys of a group share its state: an entry per micro-batch at most, whatever the number of keys."""
    requests = state_queries.unfinished(v.as_requests(stream(), "ts"))
    base = fresh_path(spark, "groups")
    out = sd.stream_dedup_requests(requests, 600, LATE, groups=groups)
    query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # per group: the list, its length, the current runs, and a timer in two columns
    assert 0 < max(held) <= groups * (8 + 4)
    want = dedup.dedup_requests(state_queries.unfinished(v.requests(spark, SMALL)), 600)
    cols = ["request_id", "leader_id", "reused", "ok"]
    assert rows(spark.read.schema(out.schema).parquet(f"{base}/out"), *cols) == rows(want, *cols)


def test_dedup_in_flight_over_a_restart(spark, parts):
    """Requests without an end, eight micro-batches, the query stopped and taken up again halfway."""
    folder, schema = parts
    # the row that moves the watermark past everything comes last
    files = [r.path for r in spark.read.schema(schema).parquet(folder).groupBy(F.input_file_name().alias("path")).agg(F.max("ts").alias("t")).orderBy("t").collect()]
    early, late = files[: len(files) // 2], files[len(files) // 2:]
    base = fresh_path(spark, "restart")
    fed = f"{base}/in"

    def run(some):
        for path in some:
            spark.read.schema(schema).parquet(path).coalesce(1).write.mode("append").parquet(fed)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(fed)
        source = source.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("t", F.unix_micros("ts"))
        out = sd.stream_dedup_requests(state_queries.unfinished(v.as_requests(source, "ts")), 600, "60 days")
        query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return out.schema

    run(early)
    out = spark.read.schema(run(late)).parquet(f"{base}/out")
    want = dedup.dedup_requests(state_queries.unfinished(v.requests(spark, SMALL)), 600)
    cols = ["request_id", "leader_id", "reused", "ok"]
    assert rows(out, *cols) == rows(want, *cols)
    assert out.where("ok IS NULL").count() > 0


def test_delivery(spark, stream):
    sent = stream().select(F.col("event_id").alias("attempt_id"), F.col("ts").alias("sent_ts"))
    back = v.as_results(stream()).select("attempt_id", F.timestamp_micros("returned").alias("returned_ts"), "result")
    out = replay.run_available(sv.stream_delivery(sent, back, lateness=LATE), "delivery").where("attempt_id >= 0")
    sends, results = v.sends(spark, SMALL), v.results(spark, SMALL)
    want = delivery.delivery_outcome(sends, results).join(delivery.late_confirm(sends, results), "attempt_id", "left")
    cols = ["attempt_id", "outcome", "notice"]
    assert rows(out, *cols) == rows(want, *cols)


def test_retention(spark, stream):
    files = stream().select(v.file_name().alias("name"), F.col("ts").alias("mtime_ts"))
    out = replay.run_available(sr.stream_retention(files, lateness=LATE), "retention").select(F.unix_micros("tick").alias("tick"), "removed")
    want = retention.retention_sweep(v.files(spark, SMALL), 0)
    assert rows(out, "tick", "removed") == rows(want, "tick", "removed")


def test_sessions(spark, stream):
    out = replay.run_available(ss.stream_sessions(v.as_polls(stream()), "1 day", 600, 60, LATE), "sessions")
    want = state.state_transitions(v.polls(spark, SMALL), 600, 60)
    cols = ["session", "state", "at_ts", "terminal"]
    assert rows(out, *cols) == rows(want, *cols)


def test_upsert_and_compaction(spark, stream):
    table = fresh_path(spark, "sections")
    out = su.stream_upsert(v.as_sections(stream()), table).where("key >= 0")
    want = state.upsert_latest(v.sections(spark, SMALL))
    cols = ["key", "value", "ts", "seq"]
    assert rows(out, *cols) == rows(want, *cols)
    assert su.compact(spark, table) >= 0 and su.compact(spark, table) >= 0
    assert rows(su.read_latest(spark, table).where("key >= 0"), *cols) == rows(want, *cols)
