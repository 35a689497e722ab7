"""Plans and paths that only show on large inputs."""

import pytest
from pyspark.sql import functions as F

from songloom.functions.ordering import exact_median
from songloom.operators import catalog as c, signals as s


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def broadcast_limit(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    yield lambda n: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(n))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture
def stored(spark, blocks, tmp_path):
    """A table larger than its per-signal rows by far."""
    signals = {i: [[float((i * 7 + k * 31) % 101) / 50 - 1 for k in range(4000)]] for i in range(8)}
    path = str(tmp_path / "blocks")
    blocks(signals, block=500).write.parquet(path)
    return spark.read.parquet(path)


def test_samples_stay_in_place_when_the_signal_table_is_small(stored, broadcast_limit, samples):
    want = samples(s.peak_normalize(s.float_to_pcm16(stored)))
    broadcast_limit(4000)  # the input and its estimates are larger, one row per signal is not
    df = s.peak_normalize(s.float_to_pcm16(stored))
    assert "BroadcastHashJoin" in plan(df) and "Exchange hashpartitioning" not in plan(df)
    assert samples(df) == want
    broadcast_limit(10)  # nothing fits: the join is shuffled
    df = s.peak_normalize(s.float_to_pcm16(stored))
    assert "SortMergeJoin" in plan(df) and samples(df) == want
    broadcast_limit(-1)
    assert samples(s.peak_normalize(s.float_to_pcm16(stored))) == want


@pytest.mark.parametrize("limit", [10, 2000])
def test_results_do_not_depend_on_the_join(spark, broadcast_limit, stored, samples, limit):
    trimmed, stitched = samples(s.trim_silence(stored, 0.5)), samples(s.stitch_chunks(s.chunk_overlap(stored, 900, 70)))
    pitch = spark.range(3000).selectExpr("id % 3 AS k", "cast(id % 977 AS double) AS x")
    medians = sorted(exact_median(pitch, "k", "x").collect())
    songs = spark.range(300).selectExpr("cast(id AS string) song_id", "concat('love ', id % 7, ' ', id % 5) name")
    asked = spark.range(20).selectExpr("concat('Love ', id % 9) query")
    ranked = sorted(c.keyword_topk(asked, songs).collect())
    broadcast_limit(limit)
    assert samples(s.trim_silence(stored, 0.5)) == trimmed
    assert samples(s.stitch_chunks(s.chunk_overlap(stored, 900, 70))) == stitched
    assert sorted(exact_median(pitch, "k", "x").collect()) == medians
    assert sorted(c.keyword_topk(asked, songs).collect()) == ranked


def test_no_registered_plan_has_a_nested_loop(spark):
    import __spark_entry__ as entry
    from tests.conftest import SMALL
    from tools.plans import summary

    for name in ("trim_silence", "mix_tracks", "keyword_topk", "candidate_expand", "best_url_by_quality", "retrieval_blend",
                 "auto_key", "model_route", "state_transitions", "retention_sweep"):
        assert not summary(plan(entry.queries()[name](spark, SMALL)))["nested_loop"], name


def test_row_local_operators_do_not_shuffle(spark):
    import __spark_entry__ as entry
    from tests.conftest import SMALL

    for name in ("pcm_to_float", "float_to_pcm16", "best_url_by_quality", "url_fallback_chain", "command_route", "request_params", "config_validate"):
        assert "Exchange" not in plan(entry.queries()[name](spark, SMALL)), name


def test_mixing_moves_each_track_once(blocks, monkeypatch):
    """Rates, layouts and channels that differ: one exchange of samples per track, none to pair them."""
    written, kept = {}, s.materialized
    monkeypatch.setattr(s, "materialized", lambda df, name: (written.update({name: plan(df)}), kept(df, name))[1])
    mixed = s.mix_tracks(blocks({1: [[0.1] * 50, [0.3] * 50]}, block=7), blocks({1: [[0.2] * 90]}, block=11, sr=36))
    assert mixed.count() == 1
    assert 1 < written["mixed"].count("Exchange hashpartitioning") <= 3, written["mixed"]


def test_frames_and_resampling_move_edges_only(blocks, broadcast_limit):
    """Frames inside a block and all resampled samples stay where they are, also with nothing broadcast."""
    broadcast_limit(-1)
    df = blocks({1: [[float(i) for i in range(4000)]]}, block=500)
    frames = s.frame_signal(s.chunk_overlap(df, 100_000, 0), frame=20, trim=2)
    assert frames.count() == 250
    moved = frames.where(F.floor((F.col("frame_no") * 16 - 2) / 500) != F.floor((F.col("frame_no") * 16 + 17) / 500))
    assert moved.count() <= 2 * 8  # frames over an edge: all that the aggregation below the union gets
    # of the two sides of each union the first makes the bulk in place, the second groups
    bulk, grouped = plan(frames).split("Union")[1].split("ObjectHashAggregate", 1)
    assert "_whole" in plan(frames) and "Exchange" in grouped
    slower = plan(s.resample_linear(df, 15))
    assert "Exchange" not in slower[slower.index("ArrowEvalPython"):].split("HashAggregate")[0], slower
