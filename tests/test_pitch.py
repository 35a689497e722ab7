import random
import statistics

import pytest
from pyspark.sql import functions as F

from songloom.functions.ordering import exact_median, numbered_within
from songloom.operators import models as m, pitch as p


def test_exact_median_and_numbering(spark):
    rnd = random.Random(1)
    groups = {k: [rnd.choice([1.5, 2.25, rnd.uniform(0, 900), rnd.uniform(10, 10.2)]) for _ in range(rnd.randrange(1, 60))] for k in range(30)}
    rows = [(k, i, x) for k, v in groups.items() for i, x in enumerate(v)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, i long, x double")
    got = {r.k: (r.n_values, r["median"]) for r in exact_median(df, "k", "x").collect()}
    assert got == {k: (len(v), pytest.approx(statistics.median(v))) for k, v in groups.items()}
    for partitions in (None, 40):
        numbered = numbered_within(df, ["k"], ["i"], "n", start=1, partitions=partitions).collect()
        assert len(numbered) == len(rows) and all(r.n == r.i + 1 for r in numbered)


def test_voicing_gates(spark):
    f0 = spark.createDataFrame(
        [(1, 100.0 + i) for i in range(50)] + [(1, 0.0)] * 80 + [(2, 200.0)] * 49 + [(3, 300.0)] * 60 + [(4, 0.0)], "signal_id long, hz double")
    lengths = spark.createDataFrame([(1, 8000, 16000), (2, 99999, 16000), (3, 7999, 16000), (4, 99999, 16000)], "signal_id long, sample_count long, sr long")
    got = {r.signal_id: (r.voiced, r.median_hz) for r in p.voiced_median(f0, lengths).collect()}
    assert got == {1: (50, 124.5), 2: (49, 0.0), 3: (60, 0.0), 4: (0, 0.0)}


def keys(spark, pairs, **options):
    songs = spark.createDataFrame([(i, i, float(song)) for i, (_, song) in enumerate(pairs)], "signal_id long, reference_id long, median_hz double")
    refs = spark.createDataFrame([(i, float(ref)) for i, (ref, _) in enumerate(pairs) if ref is not None], "reference_id long, median_hz double")
    rows = {r.signal_id: (r.n_semitones, r.reason) for r in p.auto_key(songs, refs, **options).collect()}
    return [rows[i] for i in range(len(pairs))]


def test_auto_key_cards(spark):
    assert keys(spark, [(330, 220), (220, 0), (0, 220), (None, 220)]) == [
        (5, "ok"), (None, "song_unvoiced"), (None, "reference_unvoiced"), (None, "no_reference")]
    assert keys(spark, [(220, 261.63)], offset=1) == [(-2, "ok")]
    assert keys(spark, [(440, 220)], limit=0) == [(1, "ok")]  # the limit is at least one
    assert keys(spark, [(440, 220)], limit=12, offset=-20) == [(-8, "ok")]  # offset before the limit
    rising = [k for k, _ in keys(spark, [(r, 220) for r in range(100, 500, 7)], limit=24)]
    assert rising == sorted(rising)


def test_key_priority(spark):
    rows = [(1, "cover", "a.pth", "s"), (2, "cover", "b.pth", "s"), (3, "cover", "b.pth", " "), (4, "speech", "b.pth", "s"), (5, "speech", " a.pth ", ""), (6, "cover", None, "s")]
    req = spark.createDataFrame(rows, "signal_id long, kind string, model string, sample_audio string")
    autos = spark.createDataFrame([(i, 3) for i in range(1, 6)] + [(6, None)], "signal_id long, n_semitones int")
    show = lambda df: {r.signal_id: (r.n_semitones, r.source) for r in df.collect()}
    want = {1: (-2, "manual"), 2: (3, "auto"), 3: (1, "default"), 4: (1, "default"), 5: (-2, "manual"), 6: (1, "default")}
    assert show(p.key_priority(req, autos, {"a.pth": -2}, 1)) == want
    table = spark.createDataFrame([("a.pth", -2)], "model string, key int")
    assert show(p.key_priority(req, autos, table, 1)) == want
    assert show(p.key_priority(req, autos, {}, 1, auto_enabled=False))[2] == (1, "default")


def test_transpose_keeps_unvoiced(spark):
    f0 = spark.createDataFrame([(1, 0, 220.0), (1, 1, 0.0), (2, 0, 100.0)], "signal_id long, frame_no long, hz double")
    got = {(r.signal_id, r.frame_no): r.hz for r in p.transpose_pitch(f0, spark.createDataFrame([(1, 12)], "signal_id long, n_semitones int")).collect()}
    assert got == {(1, 0): 440.0, (1, 1): 0.0, (2, 0): 100.0}


def test_incremental_profiles(spark):
    current = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5), ("d", 5)], "path string, mtime long")
    history = spark.createDataFrame([("a", 5, 111.0), ("b", 4, 1.0), ("c", 6, 1.0), ("gone", 5, 1.0)], "path string, mtime long, median_hz double")
    frames = spark.createDataFrame([(k, hz) for k, hz in (("a", 9.0), ("b", 50.0), ("c", 70.0)) for _ in range(60)] + [("d", 0.0)], "path string, hz double")
    got = {r.path: (r.median_hz, r.recomputed) for r in p.profile_incremental(current, history, frames).collect()}
    assert got == {"a": (111.0, False), "b": (50.0, True), "c": (70.0, True), "d": (None, True)}


@pytest.mark.parametrize("radius,block", [(3, 5), (4, 4096), (5, 5)])
def test_median_filter(spark, radius, block):
    rnd = random.Random(4)
    x = [rnd.choice([0.0, rnd.uniform(50, 500)]) for _ in range(43)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "signal_id long, frame_no long, hz double")
    got = {r.frame_no: r.hz for r in p.f0_median_filter(df, radius, block).collect()}
    assert got == {i: pytest.approx(statistics.median(x[max(0, i - radius):i + radius + 1])) for i in range(len(x))}
    assert {r.frame_no: r.hz for r in p.f0_median_filter(df, 2).collect()} == dict(enumerate(x))


@pytest.mark.parametrize("tile,k", [(2, 3), (64, 1)])
def test_retrieval_matches_full_scan(spark, tile, k):
    rnd = random.Random(9)
    vecs = {i: [rnd.random() for _ in range(4)] for i in range(30)}
    index = {j: [rnd.random() for _ in range(4)] for j in range(7)}
    got = {}
    df = p.retrieval_blend(
        spark.createDataFrame(list(vecs.items()), "vec_id long, embedding array<float>"),
        spark.createDataFrame(list(index.items()), "entry_id long, entry array<double>"), rate=0.25, k=k, tile=tile)
    for r in df.collect():
        got.setdefault(r.vec_id, {})[r.pos] = r.value
    for i, v in vecs.items():
        near = sorted(index.values(), key=lambda e: sum((a - b) ** 2 for a, b in zip(v, e)))[:k]
        want = [x * .75 + sum(e[d] for e in near) / k * .25 for d, x in enumerate(v)]
        assert [got[i][d] for d in range(4)] == pytest.approx(want, abs=1e-6)


def test_model_route(spark):
    assets = spark.createDataFrame([("d", "a.pth"), ("d", "b.onnx"), ("d", "c"), ("d", "c.onnx"), ("e", "z")], "dir string, name string")
    req = spark.createDataFrame([(1, "d", "a.pth"), (2, "d", "b"), (3, "d", "c"), (4, "d", "missing"), (5, "d", "missing.onnx"), (6, "e", "b")],
                                "request_id long, base_dir string, model string")
    got = {r.request_id: (r.path, r.family) for r in m.model_route(req, assets).collect()}
    assert got == {1: ("d/a.pth", "B"), 2: ("d/b.onnx", "A"), 3: ("d/c", "B"), 4: ("d/missing", "B"), 5: ("d/missing.onnx", "A"), 6: ("e/b", "B")}


def test_models_load_once_per_run_and_hot_model_spreads(spark):
    rows = [(0 if i % 3 else i % 7, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "model_id long, x long")

    def load(model_id):
        import os
        import uuid

        tag = f"{os.getpid()}-{uuid.uuid4().hex}"
        return lambda batch: batch.assign(y=batch["x"] * 10 + model_id, tag=tag)

    out = m.batch_apply_model(df, load, "model_id long, x long, y long, tag string", spread_by="x", partitions=6)
    got = out.withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r.model_id, r.x, r.y) for r in got) == sorted((k, i, i * 10 + k) for k, i in rows)
    loads = {(r.part, r.model_id, r.tag) for r in got}
    assert len(loads) == len({(a, b) for a, b, _ in loads})  # one load per model and partition
    assert len({r.part for r in got if r.model_id == 0}) > 1  # the hot model is not in one task
