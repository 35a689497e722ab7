import os
import wave

import pytest

from songloom.operators.signals import float_to_pcm16, long_form
from songloom.session import fresh_path, materialized, shared_dir
from songloom.sources import assets as a, audio


def test_wav_round_trip(spark, blocks, samples, tmp_path):
    data = {1: [[1, -2, 3, 4, 5], [6, 7, 8, -9, 10]], 2: [[32767, -32768]]}
    encoded = audio.encode_wav(blocks(data, block=2, sr=8000, kind="smallint"))
    sizes = {r.signal_id: (r.sr, r.n_samples, r.n_bytes) for r in encoded.drop("wav").collect()}
    assert sizes == {"1": (8000, 5, 44 + 20), "2": (8000, 2, 44 + 4)}
    folder = str(tmp_path / "out")
    audio.write_wav_files(encoded, folder)
    audio.write_wav_files(encoded, folder)  # writing again changes nothing
    assert sorted(os.listdir(folder)) == ["1.wav", "2.wav"]
    with wave.open(f"{folder}/1.wav") as w:
        assert (w.getnchannels(), w.getframerate(), w.getnframes()) == (2, 8000, 5)
    back = audio.audio_scan(spark, folder, block=3)
    assert samples(back) == {(str(k), c): v for k, chans in data.items() for c, v in enumerate(chans)}
    assert {(r.block_no, r.start_idx) for r in back.where("signal_id = '1'").collect()} == {(0, 0), (1, 3)}


def test_long_signals_go_on_in_numbered_files(spark, blocks, samples, tmp_path):
    encoded = audio.encode_wav(blocks({"7": [list(range(11))], "7-2": [[1, 2]]}, block=2, kind="smallint"), max_samples=4)
    assert {(r.signal_id, r.part): r.n_samples for r in encoded.collect()} == {("7", 0): 4, ("7", 1): 4, ("7", 2): 3, ("7-2", 0): 2}
    audio.write_wav_files(encoded, str(tmp_path))
    assert samples(audio.audio_scan(spark, f"{tmp_path}/part=2"))["7", 0] == [8, 9, 10]


def test_other_wav_kinds_are_refused(spark, tmp_path):
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000), w.writeframes(b"\x00\x01")
    with pytest.raises(Exception, match="16-bit"):
        audio.audio_scan(spark, str(tmp_path)).collect()


def test_export_accepts_float_blocks_after_conversion(blocks):
    out = audio.audio_export(float_to_pcm16(blocks({1: [[.5, -.5]]}))).collect()
    assert [(r.n_samples, r.n_bytes) for r in out] == [(2, 48)]


def test_assets(spark, tmp_path):
    for name in ("m/b.pth", "m/a.pth", "m/c.txt", "n/x.wav", "n/a.wav", "n/deep/q.pth"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("x")
    found = a.assets_from_folder(spark, str(tmp_path))
    assert [r.name for r in a.asset_listing(found).collect()] == ["a.pth", "b.pth", "q.pth"]
    first = {r["dir"].rsplit("/", 1)[-1]: r.first_name for r in a.first_asset_per_dir(found.select("dir"), found).collect()}
    assert first == {"m": "", "n": "a.wav", "deep": ""}


def test_shared_folder_comes_from_the_session(spark, blocks):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named and fresh_path(spark, "x").startswith(named)
    df = materialized(blocks({1: [[1.0, 2.0]]}), "t")
    assert named in df.inputFiles()[0] and long_form(df).count() == 2


def test_bucketed_tracks_pair_without_a_shuffle(spark, blocks, samples):
    from songloom.operators.signals import align_tracks
    from songloom.sources.blocks import load_blocks, save_blocks

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        save_blocks(blocks({1: [[1.0, 2.0, 3.0]], 2: [[4.0]]}, block=2), "track_first", 4)
        save_blocks(blocks({1: [[5.0]], 2: [[6.0, 7.0]]}, block=2), "track_second", 4)
        df = align_tracks(load_blocks(spark, "track_first"), load_blocks(spark, "track_second"), regular=True)
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert samples(df) == {(1, 0): [5.0, 0.0, 0.0], (2, 0): [6.0]}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS track_first")
        spark.sql("DROP TABLE IF EXISTS track_second")
