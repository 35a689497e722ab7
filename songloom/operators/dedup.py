"""Single-run rule for repeated requests.

A request joins the current run of its key while that run is in flight, or
when the run succeeded less than ``window`` ago; otherwise it starts a run of
its own. The window counts from the completion of the run that was started, so
duplicates never extend it, and each decision depends on the one before.

Rows are range-partitioned by (key, time, id), which spreads a hot key over as
many slices as its share of rows. Inside a slice the rule reduces to "the next
run starts at the first request at or after the current expiry". A slice is
therefore summarised by a step function from the expiry that enters it to the
one that leaves it. Only a slice's first key can continue from the slice
before, so at most one entry value per slice has to be handed over.

Steps point on: whoever leaves by a step enters a later slice by the first step
at or after the expiry. The functions are composed in parallel by doubling these
pointers, so a chain over n slices takes log2(n) joins on step numbers, and no
task ever folds the slices of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from songloom.functions.columns import seconds_to_micros, strip
from songloom.functions.ordering import range_slices
from songloom.session import materialized

# Reuse window in seconds.
DEDUP_WINDOW_S = 600

NEVER = -(2**62)
# expiry of a run that has not ended: later than any time
IN_FLIGHT = 2**62


def request_key() -> list[Column]:
    return [
        F.col("stream"), F.lower(strip(F.col("query"))).alias("query"), F.col("model"), F.col("flag"),
    ]


def _sliced(requests: DataFrame, window_us: int, partitions: int | None) -> DataFrame:
    keyed = requests.select(
        "request_id", F.col("stream").alias("_stream"),
        F.to_json(F.struct(*request_key())).alias("_key"),
        F.col("t").cast("bigint").alias("_t"), F.coalesce("ok", F.lit(False)).alias("ok"),
        # earliest time at which a request after this one would start anew
        F.coalesce(
            (F.col("t") + F.col("dur") + F.when(F.col("ok"), F.lit(window_us)).otherwise(F.lit(0))).cast("bigint"),
            F.lit(IN_FLIGHT),
        ).alias("_expiry"),
    )
    return range_slices(keyed, ["_key", "_t", "request_id"], partitions)


def _slice_steps(slices: DataFrame) -> DataFrame:
    """Step functions of the first and the last key of every slice.

    A row says: an entering expiry up to ``_upto`` makes ``_leader`` the last
    run started in the slice, and ``_leave`` the expiry that leaves it. ``_step``
    numbers the rows in order of slice and time; ``_after`` is the expiry, but not before
    the last request of the slice. A last key has one row, of what leaves.
    """

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        def row(key, slice_no, at, upto, after, leave, leader, ok, first):
            return pd.DataFrame({
                "_key": key, "_slice": slice_no, "_step": (slice_no << 32) + np.asarray(at, dtype=np.int64), "_upto": upto,
                "_after": np.maximum(leave, after), "_leave": leave, "_leader": leader, "_leader_ok": ok, "_first": first,
            })

        head, parts, slice_no = None, [], None  # rows of the slice's first key
        tail, tail_from, run = None, None, None  # current run of its last key
        for batch in batches:
            if not len(batch):
                continue
            keys = batch["_key"].to_numpy()
            columns = [batch[c].to_numpy() for c in ("_t", "_expiry", "request_id", "ok")]
            if head is None:
                head, slice_no = keys[0], int(batch["_slice"].iat[0])
            other = np.flatnonzero(keys != head)
            n_head = int(other[0]) if len(other) else len(keys)
            if n_head:
                parts.append([c[:n_head] for c in columns])
            if n_head == len(keys):
                continue
            before = np.flatnonzero(keys != keys[-1])
            i = int(before[-1]) + 1 if len(before) else 0
            t, expiry, ids, oks = columns
            if keys[-1] != tail:
                tail, tail_from, run = keys[-1], int(t[i]), None
            while i < len(t):
                i = i if run is None else max(i, int(np.searchsorted(t[i:], run[0], side="left")) + i)
                if i < len(t):
                    run = (int(expiry[i]), int(ids[i]), bool(oks[i]))
                    i += 1
        if head is None:
            return
        t, expiry, ids, oks = (np.concatenate(c) for c in zip(*parts))
        n = len(t)
        nxt = np.maximum(np.searchsorted(t, expiry, side="left"), np.arange(n) + 1).tolist()
        last = list(range(n))
        for i in range(n - 1, -1, -1):
            if nxt[i] < n:
                last[i] = last[nxt[i]]
        last = np.asarray(last)
        ends = np.flatnonzero(np.append(last[1:] != last[:-1], True))
        final = last[ends]
        yield row(head, slice_no, ends + 1, t[ends], t[-1], expiry[final], ids[final], oks[final], True)
        if tail is not None:
            yield row(tail, slice_no, [0], [tail_from], tail_from, *([x] for x in run), False)

    return slices.mapInPandas(
        summarise,
        "_key string, _slice int, _step bigint, _upto bigint, _after bigint, _leave bigint, "
        "_leader bigint, _leader_ok boolean, _first boolean",
    )


def _following_steps(steps: DataFrame) -> DataFrame:
    """``(_step, _to)``: the step by which a later slice is entered, for steps whose expiry reaches one.

    An as-of join in sorted slices of both sides' times: each looks up in its own
    slice first, then takes the first step of the slices after it.
    """
    none = F.lit(None).cast("bigint")
    entered = steps.where("_first").select("_key", F.col("_upto").alias("_time"), F.col("_step").alias("_place"), F.col("_step").alias("_is"), none.alias("_of"))
    # at equal times whoever leaves a slice stands behind its steps and before those of the next
    edge = F.shiftleft(F.shiftright("_step", 32) + 1, 32)
    leaving = steps.select("_key", F.col("_after").alias("_time"), edge.alias("_place"), none.alias("_is"), F.col("_step").alias("_of"))
    points = range_slices(entered.unionByName(leaving), ["_key", "_time", "_place"])
    back = W.partitionBy("_key", "_slice").orderBy(F.desc("_time"), F.desc("_place")).rowsBetween(W.unboundedPreceding, W.currentRow)
    nearest = points.withColumn("_to", F.last("_is", ignorenulls=True).over(back))
    later = W.partitionBy("_key").orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)
    firsts = points.groupBy("_key", "_slice").agg(F.min("_is").alias("_least")).withColumn("_next", F.last("_least", ignorenulls=True).over(later))
    # at most two keys per slice
    edges = firsts.select(F.col("_key").alias("_k"), F.col("_slice").alias("_s"), "_next")
    return (
        nearest.where("_of IS NOT NULL").join(edges, (F.col("_key") == F.col("_k")) & (F.col("_slice") == F.col("_s")))
        .select(F.col("_of").alias("_step"), F.coalesce("_to", "_next").alias("_to")).where("_to IS NOT NULL")
    )


def _slice_entries(steps: DataFrame) -> DataFrame:
    """Run that is current when each slice's first key begins; at most one row per slice."""
    steps = materialized(steps, "steps")
    spread = steps.groupBy(F.col("_key").alias("_k")).agg(
        F.countDistinct("_slice").alias("_slices"), F.min("_step").alias("_start")
    ).where("_slices > 1")
    # only keys that go on over an edge: at most one per slice
    starts = materialized(spread, "starts")
    most = starts.agg(F.max("_slices")).first()[0] or 1
    going = materialized(steps.join(F.broadcast(starts.select("_k")), F.col("_key") == F.col("_k")).drop("_k"), "going-steps")
    jumps = [materialized(_following_steps(going), "jumps")] if most > 1 else []
    while 1 << len(jumps) < most:
        last = jumps[-1]
        further = last.select(F.col("_step").alias("_via"), F.col("_to").alias("_far"))
        jumps.append(materialized(last.join(further, F.col("_to") == F.col("_via")).select("_step", F.col("_far").alias("_to")), "jumps"))
    reached = starts.select(F.col("_start").alias("_step"))
    for jump in reversed(jumps):  # from all steps known so far; a path enters a slice once at most
        reached = materialized(reached.unionByName(reached.join(jump, "_step").select(F.col("_to").alias("_step"))).distinct(), "reached")
    run = F.struct(F.col("_leave").alias("_entry"), F.col("_leader").alias("_entry_leader"), F.col("_leader_ok").alias("_entry_ok"))
    passed = going.join(reached, "_step").select("_key", "_slice", run.alias("_run"))
    slices = going.groupBy("_key", "_slice").agg(F.max("_first").alias("_asks")).unionByName(passed, allowMissingColumns=True)
    slices = slices.groupBy("_key", "_slice").agg(F.max("_asks").alias("_asks"), F.max("_run").alias("_run"))
    before = W.partitionBy("_key").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    return slices.withColumn("_before", F.last("_run", ignorenulls=True).over(before)).where("_asks AND _before IS NOT NULL").select("_slice", "_before.*")


def dedup_requests(
    requests: DataFrame, window_s: float = DEDUP_WINDOW_S, partitions: int | None = None
) -> DataFrame:
    """Leader of every request: ``request_id, stream, leader_id, reused, ok``.

    ``requests(request_id, stream, query, model, flag, t, dur, ok)`` with ``t``
    and ``dur`` in microseconds. A duplicate carries the outcome of its leader,
    also when the run it joined failed. A null ``dur`` is a run still in flight:
    it never expires, and its outcome is null for all who join it.
    """
    slices = _sliced(requests, seconds_to_micros(window_s), partitions)
    # at most one row per slice, so the hint is bounded by the partition count
    entries = F.broadcast(_slice_entries(_slice_steps(slices)))
    stream_type = slices.schema["_stream"].dataType.simpleString()
    schema = f"request_id bigint, stream {stream_type}, leader_id bigint, reused boolean, ok boolean"

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        key, until, leader, leader_ok = None, NEVER, NEVER, False
        for batch in batches:
            if not len(batch):
                continue
            keys = batch["_key"].to_numpy()
            t, expiry = batch["_t"].to_numpy(), batch["_expiry"].to_numpy()
            ids, oks = batch["request_id"].to_numpy(), batch["ok"].to_numpy()
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            stops = np.append(starts[1:], len(keys))
            lead = np.empty(len(keys), dtype=np.int64)
            good = np.empty(len(keys), dtype=bool)
            reused, flying = np.ones(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
            for a, b in zip(starts.tolist(), stops.tolist()):
                if keys[a] != key:
                    if key is None:  # first key of the slice may continue a run
                        until = int(batch["_entry"].iat[a])
                        leader, leader_ok = int(batch["_entry_leader"].iat[a]), bool(batch["_entry_ok"].iat[a])
                    else:
                        until = NEVER
                    key = keys[a]
                i = a
                while i < b:
                    j = i + int(np.searchsorted(t[i:b], until, side="left"))
                    lead[i:j], good[i:j], flying[i:j] = leader, leader_ok, until == IN_FLIGHT
                    if j < b:
                        leader, leader_ok, until = int(ids[j]), bool(oks[j]), int(expiry[j])
                        lead[j], good[j], reused[j], flying[j] = leader, leader_ok, False, until == IN_FLIGHT
                        j += 1
                    i = j
            yield pd.DataFrame({
                "request_id": ids, "stream": batch["_stream"], "leader_id": lead, "reused": reused,
                "ok": pd.Series(good, dtype=object).mask(flying, None),
            })

    # no nulls in the handed-over columns: pandas would turn BIGINT into doubles
    return slices.join(entries, "_slice", "left").select(
        "request_id", "_stream", "_key", "_t", "_expiry", "ok",
        F.coalesce("_entry", F.lit(NEVER)).alias("_entry"),
        F.coalesce("_entry_leader", F.lit(NEVER)).alias("_entry_leader"),
        F.coalesce("_entry_ok", F.lit(False)).alias("_entry_ok"),
    ).mapInPandas(decide, schema)


def dedup_window(decided: DataFrame) -> DataFrame:
    """New runs and reused requests per stream."""
    return decided.groupBy("stream").agg(
        F.count(F.when(~F.col("reused"), 1)).alias("new_runs"), F.count(F.when(F.col("reused"), 1)).alias("reused")
    )


def dedup_leader(decided: DataFrame) -> DataFrame:
    return decided.select("request_id", "leader_id", "reused", "ok")
