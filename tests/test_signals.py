import math
import random

import pytest

from songloom.operators import signals as s


def test_normalize_attenuates_only(blocks, samples):
    got = samples(s.peak_normalize(blocks({1: [[20000, -32000]], 2: [[100, -200]], 3: [[0, 0]], 4: [[-32768, 5]]}, kind="smallint")))
    assert got[1, 0] == [18227, -29163]
    assert got[2, 0] == [100, -200] and got[3, 0] == [0, 0]
    # the most negative sample counts as a peak of 32768
    assert got[4, 0][0] == round(-32768 * (0.89 * 32767 / 32768))


def test_silence_bounds(blocks):
    df = blocks({1: [[0, 0, .005, 1.0, .3, .01, 0, 0]], 2: [[0.0] * 5], 3: [[0.0, 0.0, 0.0, 1.0], [1.0, 0.0, 0.0, 0.0]], 4: [[]]}, block=3)
    got = {r.signal_id: (r.start_idx, r.end_idx, r.kept) for r in s.silence_bounds(df).collect()}
    assert got[1] == (2, 6, 4)  # .01 is not above the threshold; one sample of padding
    assert got[2] == (0, 5, 5)
    assert got[3] == (0, 4, 4)  # any channel counts
    assert got[4] == (0, 0, 0)


def test_trim_is_idempotent_without_padding(blocks, samples):
    df = blocks({1: [[0.0, .001, .5, 0.0, -.7, .002, 0.0, 0.0, 0.0]]}, block=2)
    once = s.trim_silence(df, pad_seconds=0)
    twice = s.trim_silence(once, pad_seconds=0)
    assert samples(once) == samples(twice) == {(1, 0): [.5, 0.0, -.7]}


def test_peaks_of_empty_and_multichannel(blocks):
    got = {r.signal_id: r.peak for r in s.peak_stats(blocks({1: [[]], 2: [[.1, -.2], [.3, .05]]})).collect()}
    assert got == {1: 0.0, 2: 0.3}


def test_downmix_and_duplicate(blocks, samples):
    df = blocks({1: [[1.0, 2.0, 3.0], [3.0, 2.0, 0.0]], 2: [[5.0]]}, block=2)
    assert samples(s.downmix_mono(df)) == {(1, 0): [2.0, 2.0, 1.5], (2, 0): [5.0]}
    assert samples(s.duplicate_mono(df)) == {(1, 0): [1, 2, 3], (1, 1): [3, 2, 0], (2, 0): [5], (2, 1): [5]}


def test_pcm_conversions(blocks, samples):
    assert samples(s.pcm_to_float(blocks({1: [[-32768, 16384]]}, kind="smallint")))[1, 0] == [-1.0, 0.5]
    assert samples(s.pcm_to_float(blocks({1: [[-1.0, 0.5]]})))[1, 0] == [-1.0, 0.5]
    got = samples(s.float_to_pcm16(blocks({1: [[2.0, -2.0, 0.0, 0.5]]})))[1, 0]
    assert got == [32439, -32439, 0, round(0.5 * 32767 * 0.99)]


def test_mix_card_and_range(blocks, samples):
    got = samples(s.mix_tracks(blocks({1: [[.5, 1.0]]}), blocks({1: [[1.0]]})))
    assert got[1, 0] == [32439, 24029]
    rnd = random.Random(3)
    a = {i: [[rnd.uniform(-2, 2) for _ in range(23)]] for i in range(10)}
    b = {i: [[rnd.uniform(-2, 2) for _ in range(rnd.randrange(1, 40))]] for i in range(10)}
    mixed = samples(s.mix_tracks(blocks(a), blocks(b)))
    assert all(len(v) == 23 and max(map(abs, v)) <= 32439 for v in mixed.values())


def test_mix_keeps_time_alignment(blocks, samples):
    """A vocal that starts late stays late against the instrumental."""
    vocal, band = [0.0] * 6 + [.5], [.25] * 7
    got = samples(s.mix_tracks(blocks({1: [vocal]}), blocks({1: [band]})))[1, 0]
    assert len(got) == 7 and got[0] == round(.25 * .85 * 32767 * .99) and got[6] > got[0]


def test_residual(blocks, samples):
    split = s.residual_track(blocks({1: [[1.5, -.5, .2]]}), blocks({1: [[-.5, .5, .1]]}), compensate=1.0)
    rest = samples(split, "residual")[1, 0]
    assert rest == pytest.approx([.99, -.495, .0495])
    assert samples(split)[1, 0] == [-.5, .5, .1]


def _reference_chunks(n, outer, margin):
    margin = min(margin, outer)
    spans = {}
    for at in range(0, n, outer):
        end = min(at + outer + margin, n)
        spans[at] = (at - (margin if at else 0), end)
        if end == n:
            break
    return spans


@pytest.mark.parametrize("n,outer,margin,want", [
    (10, 4, 1, {0: (0, 5), 4: (3, 9), 8: (7, 10)}), (9, 4, 1, {0: (0, 5), 4: (3, 9)}),
])
def test_chunk_cards(blocks, n, outer, margin, want):
    assert _reference_chunks(n, outer, margin) == want
    rows = s.chunk_overlap(blocks({1: [list(map(float, range(n)))]}, block=3), outer, margin).collect()
    assert {r.chunk_start: (r.chunk_lo, r.chunk_hi) for r in rows} == want


def test_chunk_then_stitch_is_identity(blocks, samples):
    rnd = random.Random(5)
    signals = {i: [[rnd.random() for _ in range(rnd.randrange(1, 70))]] for i in range(25)}
    df = blocks(signals, block=7).cache()
    for outer, margin in [(1, 0), (4, 1), (10, 10), (10, 25), (16, 3), (100, 5), (7, 0)]:
        chunks = s.chunk_overlap(df, outer, margin)
        spans = {(r.signal_id, r.chunk_start): (r.chunk_lo, r.chunk_hi) for r in chunks.collect()}
        assert spans == {(i, k): v for i, (x,) in signals.items() for k, v in _reference_chunks(len(x), outer, margin).items()}
        back = samples(s.stitch_chunks(chunks))
        assert back == {(i, 0): x for i, (x,) in signals.items()}, (outer, margin)


def test_frames(blocks):
    df = blocks({1: [list(map(float, range(1, 11)))]}, block=3)
    frames = s.frame_signal(s.chunk_overlap(df, 100, 0), frame=6, trim=1)
    got = {r.frame_no: r.samples for r in frames.collect()}
    padded = [0.0] + list(map(float, range(1, 11))) + [0.0] * 2 + [0.0]
    assert got == {k: padded[4 * k:4 * k + 6] for k in range(3)}
    spectra = {r.frame_no: r.magnitude for r in s.spectrum_frames(frames).collect()}
    assert spectra[0][0] == pytest.approx(sum(padded[:6])) and len(spectra[0]) == 4


@pytest.mark.parametrize("sr,target", [(20, 48), (48, 20), (20, 20), (44100, 16000)])
def test_resample_matches_plain_interpolation(blocks, samples, sr, target):
    rnd = random.Random(7)
    x = [rnd.random() for _ in range(41)]
    got = samples(s.resample_linear(blocks({1: [x]}, block=5, sr=sr), target))[1, 0]
    want = []
    for j in range(math.ceil(len(x) * target / sr)):
        i, frac = divmod(j * sr, target)
        right = x[min(i + 1, len(x) - 1)]
        want.append(x[i] + (right - x[i]) * (frac / target))
    assert got == pytest.approx(want)


def test_rms_frames_across_blocks(blocks):
    x = [float(i) for i in range(11)]
    got = {r.frame_no: r.rms for r in s.frame_rms(blocks({1: [x]}, block=4), 6).collect()}
    assert got == pytest.approx({0: math.sqrt(sum(v * v for v in x[:6]) / 6), 1: math.sqrt(sum(v * v for v in x[6:]) / 5)})
    gains = {r.frame_no: r.gain for r in s.rms_envelope_mix(blocks({1: [x]}), blocks({1: [[0.0] * 6 + [1.0] * 5]}), 6, rate=0.5).collect()}
    assert gains[0] == 1.0 and gains[1] == pytest.approx(math.sqrt(got[1]))


def test_long_form_positions(blocks):
    rows = s.long_form(blocks({1: [[1.0, 2.0, 3.0]]}, block=2)).orderBy("idx").collect()
    assert [(r.idx, r.value) for r in rows] == [(0, 1.0), (1, 2.0), (2, 3.0)]


def test_pairing_does_not_trust_block_edges(blocks, samples):
    from pyspark.sql import functions as F

    whole = blocks({1: [[0.0] * 8]}, block=6)
    moved = blocks({1: [[.1, .2, .3, .4, .5, .6, .7]]}, block=7)
    split = F.posexplode(F.array(F.slice("samples", 1, 1), F.slice("samples", 2, 6)))
    moved = moved.select("signal_id", "ch", split.alias("block_no", "samples"), "sr").withColumn("start_idx", F.col("block_no").cast("bigint"))
    assert samples(s.align_tracks(whole, moved))[1, 0] == [.1, .2, .3, .4, .5, .6, .7, 0.0]
    with pytest.raises(Exception, match="block layouts"):
        s.align_tracks(whole, moved, regular=True).collect()
    assert [len(r.samples) for r in s.reblock(moved, 3).orderBy("block_no").collect()] == [3, 3, 1]


def test_raised_part_is_clipped(blocks, samples):
    split = s.residual_track(blocks({1: [[.5, 1.0]]}), blocks({1: [[.5, 1.0]]}))
    assert samples(split)[1, 0] == pytest.approx([.5175, 1.0]) and samples(split, "residual")[1, 0] == pytest.approx([-.0175, 0.0])


def test_two_requests_of_one_song(spark, blocks):
    from songloom.plans.cover import two_stem_job
    from songloom.session import clear_written

    rows = [(i, 1, "cover", "m", "", 0, band, True) for i, band in ((10, True), (11, True), (12, False))]
    requests = spark.createDataFrame(rows, "request_id long, signal_id long, kind string, model string, sample_audio string, reference_id long, with_instrumental boolean, trim boolean")
    f0 = spark.createDataFrame([(1, 100.0)] * 3, "signal_id long, hz double")
    refs = spark.createDataFrame([(0, 200.0)], "reference_id long, median_hz double")
    job = two_stem_job(blocks({1: [[.5, .25, .5, .5]], 2: [[1.0]]}), requests, f0, refs, lambda b: b, lambda b, k: s.float_to_pcm16(b))
    got = {r.signal_id: r.n for r in job["audio"].selectExpr("signal_id", "size(samples) n").collect()}
    assert got == {10: 4, 11: 4, 12: 4} and job["keys"].count() == 3 and job["f0"].count() == 6
    assert clear_written(spark) > 0
