"""Keyed state, time and delivery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import views as v
from registry.core import query, sql_view, table
from songloom.operators import dedup, delivery, retention, state


# The check walks the runs of each key: the next one starts at the first later
# request that is not before the expiry of the current one.
def _dedup_views(tag: str, stream: str, window_s: int) -> None:
    sql_view(f"req_{tag}", f"""SELECT event_id AS id, {stream} AS stream, t, event_type <> 'error' AS ok,
      t + CAST(round_even(value * 20e6, 0) AS BIGINT) + CASE WHEN event_type <> 'error' THEN {window_s}000000 ELSE 0 END AS expiry,
      row_number() OVER (PARTITION BY {stream} ORDER BY t, event_id) AS rn FROM ev""", ("ev",))
    sql_view(f"runs_{tag}", f"""SELECT stream, rn, id, id AS leader_id, expiry, ok, false AS reused FROM req_{tag} WHERE rn = 1
      UNION ALL SELECT r.stream, r.rn, r.id, CASE WHEN r.t < p.expiry THEN p.leader_id ELSE r.id END,
        CASE WHEN r.t < p.expiry THEN p.expiry ELSE r.expiry END, CASE WHEN r.t < p.expiry THEN p.ok ELSE r.ok END, r.t < p.expiry
      FROM runs_{tag} p JOIN req_{tag} r ON r.stream = p.stream AND r.rn = p.rn + 1""", (f"req_{tag}",))


_dedup_views("user", "user_id", 600)
_dedup_views("user6h", "user_id", 21600)
_dedup_views("type", "event_type", 600)
_dedup_views("type5d", "event_type", 432000)
_COUNTS = "SELECT stream, count(*) FILTER (WHERE NOT reused) AS new_runs, count(*) FILTER (WHERE reused) AS reused FROM runs_{tag} GROUP BY stream"


@query("dedup_window", _COUNTS.format(tag="user"), ("runs_user",))
def dedup_window(spark, sf):
    return dedup.dedup_window(dedup.dedup_requests(v.requests(spark, sf)))


@query("dedup_window_six_hours", _COUNTS.format(tag="user6h"), ("runs_user6h",))
def dedup_window_six_hours(spark, sf):
    return dedup.dedup_window(dedup.dedup_requests(v.requests(spark, sf), window_s=21600))


def _open_views(tag: str, stream: str) -> None:
    sql_view(f"req_{tag}", f"""SELECT event_id AS id, {stream} AS stream, t, CASE WHEN event_id % 500 <> 7 THEN event_type <> 'error' END AS ok,
      CASE WHEN event_id % 500 = 7 THEN 4611686018427387904 ELSE t + CAST(round_even(value * 20e6, 0) AS BIGINT) + CASE WHEN event_type <> 'error' THEN 600000000 ELSE 0 END END AS expiry,
      row_number() OVER (PARTITION BY {stream} ORDER BY t, event_id) AS rn FROM ev""", ("ev",))
    sql_view(f"runs_{tag}", f"""SELECT stream, rn, id, id AS leader_id, expiry, ok, false AS reused FROM req_{tag} WHERE rn = 1
      UNION ALL SELECT r.stream, r.rn, r.id, CASE WHEN r.t < p.expiry THEN p.leader_id ELSE r.id END,
        CASE WHEN r.t < p.expiry THEN p.expiry ELSE r.expiry END, CASE WHEN r.t < p.expiry THEN p.ok ELSE r.ok END, r.t < p.expiry
      FROM runs_{tag} p JOIN req_{tag} r ON r.stream = p.stream AND r.rn = p.rn + 1""", (f"req_{tag}",))


_open_views("open", "event_type")
_open_views("open_user", "user_id")


def unfinished(requests):
    """Every five hundredth request has not ended."""
    open_ = F.pmod("request_id", F.lit(500)) == 7
    return requests.withColumn("dur", F.when(~open_, F.col("dur"))).withColumn("ok", F.when(~open_, F.col("ok")))


@query("dedup_unfinished", "SELECT id AS request_id, leader_id, reused, ok FROM runs_open", ("runs_open",))
def dedup_unfinished(spark, sf):
    """Some requests have not ended: whatever follows on their key joins them."""
    return dedup.dedup_leader(dedup.dedup_requests(unfinished(v.requests(spark, sf, "event_type")), partitions=8))


@query("dedup_window_hot_keys", _COUNTS.format(tag="type"), ("runs_type",))
def dedup_window_hot_keys(spark, sf):
    """Five keys hold all rows, so every key runs over several slices."""
    return dedup.dedup_window(dedup.dedup_requests(v.requests(spark, sf, "event_type"), partitions=32))


@query("dedup_window_dense", _COUNTS.format(tag="type5d"), ("runs_type5d",))
def dedup_window_dense(spark, sf):
    """Five keys and a window longer than a slice: a run reaches over several slices."""
    return dedup.dedup_window(dedup.dedup_requests(v.requests(spark, sf, "event_type"), window_s=432000, partitions=64))


@query("dedup_leader", "SELECT id AS request_id, leader_id, reused, ok FROM runs_user", ("runs_user",))
def dedup_leader(spark, sf):
    return dedup.dedup_leader(dedup.dedup_requests(v.requests(spark, sf)))


_OUTCOME = "CASE WHEN lat <= 180000000 AND result = 'true' THEN 'sent' WHEN lat <= 180000000 AND result = 'false' THEN 'failed' ELSE 'unknown' END"
_NOTICE = "CASE WHEN lat IS NULL OR lat > 1980000000 THEN 'abandoned' WHEN lat <= 180000000 THEN NULL WHEN result = 'true' THEN 'notice' ELSE 'silent' END"


@query("delivery_outcome", f"SELECT attempt_id, {_OUTCOME} AS outcome FROM attempts", ("attempts",))
def delivery_outcome(spark, sf):
    return delivery.delivery_outcome(v.sends(spark, sf), v.results(spark, sf))


@query("delivery_outcome_repeated", f"SELECT attempt_id, {_OUTCOME} AS outcome, {_NOTICE} AS notice FROM attempts", ("attempts",))
def delivery_outcome_repeated(spark, sf):
    """Every result comes back three times, later ones with other contents: the first one counts."""
    again = v.results(spark, sf).withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "attempt_id", (F.col("returned") + F.col("_k") * 7_000_000).alias("returned"), F.when(F.col("_k") == 0, F.col("result")).otherwise("true").alias("result"))
    sends = v.sends(spark, sf)
    outcomes, notices = delivery.delivery_outcome(sends, again), delivery.late_confirm(sends, again)
    return outcomes.join(notices, "attempt_id", "left").select("attempt_id", "outcome", "notice")


@query("late_confirm", f"SELECT attempt_id, {_NOTICE} AS notice FROM attempts WHERE {_NOTICE} IS NOT NULL", ("attempts",))
def late_confirm(spark, sf):
    return delivery.late_confirm(v.sends(spark, sf), v.results(spark, sf))


sql_view("tries", """SELECT event_id AS message_id, CAST(trunc(value * 60000) AS BIGINT) AS size,
  ['sent', 'failed', 'unknown'][(event_id * 7 + 1 * (event_id // 3)) % 3 + 1] AS o1,
  ['sent', 'failed', 'unknown'][(event_id * 7 + 2 * (event_id // 3)) % 3 + 1] AS o2,
  ['sent', 'failed', 'unknown'][(event_id * 7 + 3 * (event_id // 3)) % 3 + 1] AS o3 FROM events""")


@query("delivery_fallback", """SELECT message_id, method, outcome, outcome = 'sent' AS delivered FROM (SELECT message_id,
  CASE WHEN o1 <> 'failed' OR size > 8388608 THEN 'voiceurl' WHEN o2 <> 'failed' THEN 'record' ELSE 'voice' END AS method,
  CASE WHEN o1 <> 'failed' OR size > 8388608 THEN o1 WHEN o2 <> 'failed' THEN o2 ELSE o3 END AS outcome FROM tries)""", ("tries",))
def delivery_fallback(spark, sf):
    return delivery.delivery_fallback(v.method_attempts(spark, sf))


@query("transport_plan", """SELECT user_id AS stream, CASE WHEN size <= 8388608 THEN 'base64' ELSE 'file_only' END AS route, count(*) AS n,
  CAST(sum(4 * ((size + 2) // 3)) AS BIGINT) AS encoded_bytes FROM (SELECT user_id, CAST(trunc(value * 60000) AS BIGINT) AS size FROM events) GROUP BY ALL""")
def transport_plan(spark, sf):
    sizes = v.events(spark, sf).select(F.col("user_id").alias("stream"), (F.col("value") * 60000).cast("bigint").alias("size"))
    return delivery.transport_plan(sizes)


@query("retention_expired", """SELECT name, mtime FROM files WHERE name LIKE 'sing\\_%.wav' ESCAPE '\\'
AND mtime < (SELECT max(mtime) FROM files) - 5 * 86400000000""", ("files",))
def retention_expired(spark, sf):
    files = v.files(spark, sf)
    return retention.retention_expired(files, files.agg(F.max("mtime")).scalar())


@query("retention_sweep", """SELECT CASE WHEN late < 0 THEN start ELSE start + 86400000000 * (late // 86400000000 + 1) END AS tick, count(*) AS removed
FROM (SELECT s.start, mtime + 5 * 86400000000 - s.start AS late FROM files, (SELECT min(mtime) + 6 * 86400000000 AS start FROM files) s
      WHERE name LIKE 'sing\\_%.wav' ESCAPE '\\') GROUP BY 1""", ("files",))
def retention_sweep(spark, sf):
    files = v.files(spark, sf)
    start = files.agg((F.min("mtime") + 6 * v.DAY_US)).scalar()
    return retention.retention_sweep(files, start)


def _sessions(timeout_s: int, reminder_s: int | None) -> str:
    limit = timeout_s * 1_000_000
    remind = "" if reminder_s is None else f"""
    UNION ALL SELECT session, 'reminded', min(t), false FROM open JOIN firsts USING (session)
      WHERE t - start > {reminder_s * 1_000_000} AND (t, seq) >= (scan_t, scan_seq) GROUP BY session"""
    return f""", ends AS (SELECT session, any_value(start) AS start, min((t, seq, state)) FILTER (WHERE state IN ('expired', 'success') AND t - start <= {limit}) AS e FROM polls GROUP BY session),
  open AS (SELECT p.* FROM polls p JOIN ends USING (session) WHERE p.t - p.start <= {limit} AND (e IS NULL OR (p.t, p.seq) <= (e[1], e[2]))),
  firsts AS (SELECT session, min((t, seq))[1] AS scan_t, min((t, seq))[2] AS scan_seq FROM open WHERE state = 'scanned' GROUP BY session)
  SELECT session, 'scanned' AS state, scan_t AS at_ts, false AS terminal FROM firsts {remind}
  UNION ALL SELECT session, coalesce(e[3], 'timeout'), coalesce(e[1], start + {limit}), true FROM ends"""


def _with_polls(tail: str) -> str:
    from registry.core import with_views

    return with_views("", ("polls",)).rstrip() + tail


@query("state_transitions", _with_polls(_sessions(180, None)))
def state_transitions(spark, sf):
    return state.state_transitions(v.polls(spark, sf))


@query("state_transitions_patient", _with_polls(_sessions(600, 60)))
def state_transitions_patient(spark, sf):
    return state.state_transitions(v.polls(spark, sf), state.PATIENT_TIMEOUT_S, state.REMINDER_AFTER_S)


@query("upsert_latest", """SELECT user_id AS key, arg_max(props, (t, event_id)) AS value, max(t) AS ts FROM ev GROUP BY user_id""", ("ev",))
def upsert_latest(spark, sf):
    return state.upsert_latest(v.sections(spark, sf)).drop("seq")


@query("upsert_into", """SELECT key, value, ts FROM (SELECT user_id AS key, arg_max(props, (t, event_id)) AS value, max(t) AS ts FROM ev GROUP BY user_id)
UNION ALL SELECT c_custkey, c_name, 0 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""", ("ev",))
def upsert_into(spark, sf):
    """The sections of every customer, replaced where events wrote one."""
    base = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("value"), F.lit(0).cast("bigint").alias("ts"), F.lit(-1).cast("bigint").alias("seq"))
    return state.upsert_into(base, v.sections(spark, sf)).drop("seq")


sql_view("written", """SELECT CASE WHEN user_id % 10 > 0 THEN user_id END AS key, arg_max(props, (t, event_id)) AS value, max(t) AS ts FROM ev GROUP BY 1""", ("ev",))


@query("upsert_into_null_key", """SELECT * FROM written UNION ALL
SELECT CASE WHEN c_custkey > 1 THEN c_custkey END, c_name, 0 FROM customer
WHERE NOT EXISTS (SELECT 1 FROM written w WHERE w.key IS NOT DISTINCT FROM CASE WHEN c_custkey > 1 THEN c_custkey END)""", ("written",))
def upsert_into_null_key(spark, sf):
    """The null key is a key: its old row goes when one is written."""
    base = table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") > 1, F.col("c_custkey")).alias("key"), F.col("c_name").alias("value"), F.lit(0).cast("bigint").alias("ts"),
        F.lit(-1).cast("bigint").alias("seq"))
    writes = v.sections(spark, sf).withColumn("key", F.when(F.pmod("key", F.lit(10)) > 0, F.col("key")))
    return state.upsert_into(base, writes).drop("seq")


@query("hash33_shards", """SELECT h % 16 AS shard, count(*) AS n FROM (
  SELECT list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(url, ''), lambda c: CAST(unicode(c) AS BIGINT))),
    lambda h, c: (h * 33 + c) & 2147483647) AS h FROM pages) GROUP BY 1""")
def hash33_shards(spark, sf):
    return state.hash33_shards(table(spark, sf, "pages"), "url", 16, seed=5381)
