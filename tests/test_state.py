import random

import pytest

from pyspark.sql import functions as F

from songloom.operators import dedup, delivery, retention, state

S = 1_000_000
REQ = "request_id long, stream string, query string, model string, flag boolean, t long, dur long, ok boolean"


def brute_dedup(rows, window_us):
    """Walk all requests in time order, one state per key."""
    runs, out = {}, {}
    for rid, stream, q, m, f, t, dur, ok in sorted(rows, key=lambda r: (r[5], r[0])):
        key = (stream, q.strip().lower(), m, f)
        leader, done, good = runs.get(key, (None, None, False))
        if leader is not None and (t < done or (good and t - done < window_us)):
            out[rid] = (leader, True, good)
        else:
            runs[key] = (rid, t + dur, ok)
            out[rid] = (rid, False, ok)
    return out


def decided(df):
    return {r.request_id: (r.leader_id, r.reused, r.ok) for r in df.collect()}


@pytest.mark.parametrize("first_ok,times,reused", [
    (True, [0, 50, 699, 700], [False, True, True, False]),
    (False, [0, 50, 100], [False, True, False]),
])
def test_dedup_cards(spark, first_ok, times, reused):
    rows = [(i, "s", "q", "m", False, t * S, 100 * S, first_ok if i == 0 else True) for i, t in enumerate(times)]
    got = decided(dedup.dedup_requests(spark.createDataFrame(rows, REQ)))
    assert [got[i][1] for i in range(len(times))] == reused
    assert got[1] == (0, True, first_ok)  # joins in flight and shares the outcome


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("partitions", [1, 13])
def test_dedup_matches_walk_with_hot_keys(spark, seed, partitions):
    rnd = random.Random(seed)
    rows = []
    for i in range(1500):
        stream = "hot" if rnd.random() < .6 else f"s{rnd.randrange(40)}"
        rows.append((
            i, stream, rnd.choice(["Song A", " song a\t\u3000", "SONG B\n"]), rnd.choice("mn"), rnd.random() < .2,
            rnd.randrange(4000) // rnd.choice([1, 7]) * S, rnd.choice([0, 0, 5, 100, 3000]) * S, rnd.random() < .6,
        ))
    window = rnd.choice([0, 20, 600])
    got = decided(dedup.dedup_requests(spark.createDataFrame(rows, REQ), window_s=window, partitions=partitions))
    assert got == brute_dedup(rows, window * S)


def test_dedup_single_key_over_many_slices(spark):
    """Runs that span whole slices, so slices without a leader pass the run on."""
    rows = [(i, "one", "q", "m", False, i * S, (400 if i % 97 == 0 else 1) * S, i % 3 > 0) for i in range(900)]
    df = dedup.dedup_requests(spark.createDataFrame(rows, REQ), window_s=150, partitions=40)
    assert decided(df) == brute_dedup(rows, 150 * S)
    counts = {r.stream: (r.new_runs, r.reused) for r in dedup.dedup_window(df).collect()}
    assert sum(counts["one"]) == 900
    leaders = [r for r in dedup.dedup_leader(df).collect() if not r.reused]
    assert all(r.leader_id == r.request_id for r in leaders)


def test_delivery_table(spark):
    cases = [  # latency in microseconds, result, outcome, notice
        (180 * S, "true", "sent", None), (180 * S, "false", "failed", None), (180 * S, "raised", "unknown", None),
        (180 * S + 1, "true", "unknown", "notice"), (1980 * S, "true", "unknown", "notice"),
        (1980 * S, "false", "unknown", "silent"), (200 * S, "raised", "unknown", "silent"),
        (1980 * S + 1, "true", "unknown", "abandoned"), (None, None, "unknown", "abandoned"),
    ]
    sends = spark.createDataFrame([(i, 1000) for i in range(len(cases))], "attempt_id long, sent long")
    results = spark.createDataFrame(
        [(i, 1000 + c[0], c[1]) for i, c in enumerate(cases) if c[0] is not None], "attempt_id long, returned long, result string")
    outcomes = {r.attempt_id: r.outcome for r in delivery.delivery_outcome(sends, results).collect()}
    notices = {r.attempt_id: r.notice for r in delivery.late_confirm(sends, results).collect()}
    assert [outcomes[i] for i in range(len(cases))] == [c[2] for c in cases]
    assert notices == {i: c[3] for i, c in enumerate(cases) if c[3]}


def test_fallback_rules(spark):
    gate = delivery.FALLBACK_MAX_BYTES
    cases = {
        1: (10, ["sent", "sent", "sent"], ("voiceurl", "sent", True)),
        2: (10, ["unknown", "sent", "sent"], ("voiceurl", "unknown", False)),  # never sent twice
        3: (10, ["failed", "sent", "failed"], ("record", "sent", True)),
        4: (10, ["failed", "unknown", "sent"], ("record", "unknown", False)),
        5: (10, ["failed", "failed", "failed"], ("voice", "failed", False)),
        6: (gate, ["failed", "sent", "sent"], ("record", "sent", True)),
        7: (gate + 1, ["failed", "sent", "sent"], ("voiceurl", "failed", False)),
        8: (gate + 1, ["sent", "failed", "failed"], ("voiceurl", "sent", True)),
    }
    rows = [(i, m, o, size) for i, (size, outs, _) in cases.items() for m, o in zip(delivery.METHODS, outs)]
    got = delivery.delivery_fallback(spark.createDataFrame(rows, "message_id long, method string, outcome string, size long"))
    assert {r.message_id: (r.method, r.outcome, r.delivered) for r in got.collect()} == {i: c[2] for i, c in cases.items()}


def test_transport_gate(spark):
    files = spark.createDataFrame([("s", 8388608), ("s", 8388609), ("s", 0)], "stream string, size long")
    got = {r.route: (r.n, r.encoded_bytes) for r in delivery.transport_plan(files).collect()}
    assert got == {"base64": (2, 11184812), "file_only": (1, 11184812)}


def test_retention(spark):
    day = retention.DAY_US
    now = 100 * day
    files = spark.createDataFrame(
        [("sing_a.wav", now - 5 * day), ("sing_b.wav", now - 5 * day - 1), ("sing_c.mp3", 0), ("song.wav", 0), ("sing_.wav", 0)],
        "name string, mtime long")
    gone = lambda **k: sorted(r.name for r in retention.retention_expired(files, now, **k).collect())
    assert gone() == ["sing_.wav", "sing_b.wav"]
    assert gone(days=0) == [] and retention.retention_sweep(files, 0, days=0).count() == 0


def test_sweep_card(spark):
    day = retention.DAY_US
    files = spark.createDataFrame([("sing_1.wav", -S), ("sing_2.wav", 0), ("sing_3.wav", S), ("sing_4.wav", -99 * day)], "name string, mtime long")
    got = {r.tick: r.removed for r in retention.retention_sweep(files, 0).collect()}
    assert got == {5 * day: 1, 6 * day: 2, 0: 1}


def brute_session(polls, timeout, reminder):
    """The polling loop, poll by poll."""
    start, out, scanned, reminded = polls[0][0], [], False, False
    for _, t, _, st in sorted(polls, key=lambda p: (p[1], p[2])):
        if t - start > timeout * S:
            break
        if st == "scanned" and not scanned:
            scanned = True
            out.append(("scanned", t, False))
        if reminder is not None and scanned and t - start > reminder * S and not reminded:
            reminded = True
            out.append(("reminded", t, False))
        if st in ("expired", "success"):
            return out + [(st, t, True)]
    return out + [("timeout", start + timeout * S, True)]


@pytest.mark.parametrize("timeout,reminder", [(180, None), (600, 60)])
def test_sessions_match_loop(spark, timeout, reminder):
    rnd = random.Random(11)
    logs = {}
    for i in range(150):
        start = rnd.randrange(10**6) * S
        logs[f"s{i}"] = [
            (start, start + rnd.choice([0, 30, 60, 61, 180, 181, 599, 600, 601, rnd.randrange(700)]) * S, q,
             rnd.choice(["waiting"] * 4 + ["scanned"] * 3 + ["expired", "success"]))
            for q in range(rnd.randrange(1, 8))
        ]
    rows = [(k, *p) for k, v in logs.items() for p in v]
    df = spark.createDataFrame(rows, "session string, start long, t long, seq long, state string")
    got = {}
    for r in state.state_transitions(df, timeout, reminder).collect():
        got.setdefault(r.session, []).append((r.state, r.at_ts, r.terminal))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(brute_session(v, timeout, reminder)) for k, v in logs.items()}


def test_upsert(spark):
    schema = "key long, value string, ts long, seq long"
    snap = spark.createDataFrame([(1, "old", 5, 0), (2, "kept", 9, 0)], schema)
    writes = spark.createDataFrame([(1, "a", 7, 1), (1, "b", 7, 2), (3, "n", 1, 3)], schema)
    got = {r.key: r.value for r in state.upsert_into(snap, writes).collect()}
    assert got == {1: "b", 2: "kept", 3: "n"}


def test_hash33(spark):
    texts = ["", "abc", "晴天", "a" * 500, "naïve 🎵"]

    def plain(text, h=0):
        for ch in text:
            h = h * 33 + ord(ch)
        return h & 2147483647

    from pyspark.sql import functions as F
    from songloom.functions import hash33
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = {r.s: (r.a, r.b) for r in df.select("s", hash33(F.col("s")).alias("a"), hash33(F.col("s"), 5381).alias("b")).collect()}
    assert got == {t: (plain(t), plain(t, 5381)) for t in texts}


def test_methods_outside_the_order_settle_nothing(spark):
    from songloom.operators import delivery

    rows = [(1, "text", "sent", 1), (1, "voiceurl", "sent", 1), (2, "text", "sent", 1)]
    got = delivery.delivery_fallback(spark.createDataFrame(rows, "message_id long, method string, outcome string, size long")).collect()
    assert [(r.message_id, r.method) for r in got] == [(1, "voiceurl")]


def test_nan_frames_have_no_voice(spark):
    from songloom.operators import pitch

    rows = [(1, 100.0)] * 50 + [(1, float("nan"))] * 60
    got = pitch.voiced_median(spark.createDataFrame(rows, "signal_id long, hz double")).first()
    assert (got.voiced, got.median_hz) == (50, 100.0)


@pytest.mark.parametrize("seed", range(3))
def test_dedup_dense_slices(spark, seed):
    """Windows longer than many slices, equal times, runs that end before or as they start, runs in flight."""
    rnd = random.Random(seed)
    rows = []
    for i in range(700):
        ok = rnd.random() < .7
        dur = rnd.choice([0, 0, -3, 2, 90, 400]) * S
        rows.append((i, rnd.choice(["one", "one", "two"]), "q", "m", False, rnd.randrange(900) // 5 * 5 * S, dur, ok))
    got = decided(dedup.dedup_requests(spark.createDataFrame(rows, REQ), window_s=60, partitions=48))
    want, runs = {}, {}
    for rid, stream, *_, t, dur, ok in sorted(rows, key=lambda r: (r[5], r[0])):
        leader, until, good = runs.get(stream, (None, -1 << 62, False))
        if t < until:
            want[rid] = (leader, True, good)
        else:
            runs[stream] = (rid, t + dur + (60 * S if ok else 0), ok)
            want[rid] = (rid, False, ok)
    assert got == want


def test_dedup_hand_over_is_spread(spark, monkeypatch):
    """One key, a window over all slices: no task of the hand-over writes more than a few slices' share of steps."""
    parts, n = 16, 6000
    largest = {}

    def watched(df, name):
        out = dedup_materialized(df, name)
        sizes = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
        largest[name] = max([largest.get(name, 0), *sizes])
        return out

    from songloom.operators.dedup import materialized as dedup_materialized
    monkeypatch.setattr(dedup, "materialized", watched)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(parts)}
    old = {k: spark.conf.get(k) for k in settings}
    for k, x in settings.items():
        spark.conf.set(k, x)
    try:
        rows = [(i, "one", "q", "m", False, i * S, (i * 7919 % 5000) * S, True) for i in range(n)]
        got = decided(dedup.dedup_requests(spark.createDataFrame(rows, REQ), window_s=30, partitions=parts))
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    assert got == brute_dedup(rows, 30 * S)
    assert largest["jumps"] and max(largest.values()) <= 4 * n / parts, largest
