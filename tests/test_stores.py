"""State kept between runs: generations of an upserted table, profiles of a folder."""

import os

import pytest

from songloom.plans.profiles import profile_folder
from songloom.session import fresh_path, materialized, written
from songloom.streaming import upsert as up

WRITES = "key long, value string, ts long, seq long"


def write(spark, table, batch, rows):
    spark.createDataFrame(rows, WRITES).write.parquet(f"{table}/batches/batch={batch}")


def state(df):
    return {r.key: r.value for r in df.collect()}


def folders(table, kind):
    path = os.path.join(table.removeprefix("file:"), kind)
    return sorted(x for x in os.listdir(path) if "=" in x) if os.path.isdir(path) else []


def test_generations(spark):
    table = fresh_path(spark, "generations")
    assert state(up.read_latest(spark, table)) == {} and up.compact(spark, table) == -1 and up.retire(spark, table) == -1
    write(spark, table, 0, [(1, "a", 1, 1), (None, "n", 1, 2)])
    write(spark, table, 1, [(1, "b", 2, 3), (2, "c", 2, 4)])
    assert up.compact(spark, table) == 1 == up.compact(spark, table)
    write(spark, table, 2, [(None, "m", 3, 5)])
    want = {1: "b", 2: "c", None: "m"}
    assert state(up.read_latest(spark, table)) == want
    # a snapshot without its row in the manifest is not there yet
    spark.createDataFrame([(9, "half", 9, 9)], WRITES).write.parquet(f"{table}/snapshots/upto=2")
    assert up.generation(spark, table) == 1 and state(up.read_latest(spark, table)) == want
    assert up.retire(spark, table) == 1 and folders(table, "batches") == ["batch=2"]
    assert state(up.read_latest(spark, table)) == want
    assert up.compact(spark, table) == 2 and up.retire(spark, table) == 2
    assert folders(table, "batches") == [] and folders(table, "snapshots") == ["upto=2"]
    assert state(up.read_latest(spark, table)) == want


def test_a_reader_keeps_its_folders(spark):
    table = fresh_path(spark, "readers")
    write(spark, table, 0, [(1, "a", 1, 1)])
    up.compact(spark, table)
    with up.reading(spark, table) as current:
        write(spark, table, 1, [(1, "b", 2, 2)])
        assert up.compact(spark, table) == 1
        assert up.retire(spark, table) == 0  # the reader's generation
        assert folders(table, "snapshots") == ["upto=0", "upto=1"] and folders(table, "batches") == ["batch=1"]
        assert state(current) == {1: "a"}
        with up.reading(spark, table) as newer:
            assert state(newer) == {1: "b"}
    assert folders(table, "readers") == []
    assert up.retire(spark, table) == 1 and folders(table, "snapshots") == ["upto=1"] and folders(table, "batches") == []
    assert state(up.read_latest(spark, table)) == {1: "b"}


@pytest.fixture
def decoded():
    """A pitch source that notes which files it is given: their lines are the pitch of a frame each."""
    names = []

    def frames_of(files):
        names.extend(sorted(r.path.rsplit("/", 1)[1] for r in files.select("path").collect()))
        lines = files.selectExpr("path", "posexplode(split(cast(content AS string), '\n')) AS (frame_no, line)")
        return lines.selectExpr("path", "frame_no", "coalesce(try_cast(line AS double), 0D) AS hz")

    return names, frames_of


def test_profiles_of_a_folder(spark, tmp_path, decoded):
    names, frames_of = decoded
    folder, store = tmp_path / "samples", fresh_path(spark, "profiles")
    folder.mkdir()

    def sample(name, *hz, changed=1_000):
        (folder / name).write_text("\n".join(map(str, hz)))
        os.utime(folder / name, (changed, changed))

    def run(**options):
        names.clear()
        rows = profile_folder(spark, str(folder), store, frames_of, min_voiced=3, **options).collect()
        return {r.path.rsplit("/", 1)[1]: (r.median_hz, r.recomputed) for r in rows}

    assert run() == {} and names == []
    sample("a.wav", 100, 200, 300)
    sample("b.wav", 0, 50, 60)
    sample("c.txt", 1, 2, 3)
    assert run() == {"a.wav": (200.0, True), "b.wav": (None, True)} and names == ["a.wav", "b.wav"]
    assert run() == {"a.wav": (200.0, False), "b.wav": (None, False)} and names == []  # nothing decoded
    sample("b.wav", 50, 60, 70, changed=900)  # an older time is a change as well
    sample("d.wav", 1, 2, 3)
    assert run(files_at_once=1) == {"a.wav": (200.0, False), "b.wav": (60.0, True), "d.wav": (2.0, True)}
    assert sorted(names) == ["b.wav", "d.wav"]
    (folder / "a.wav").unlink()
    assert run() == {"b.wav": (60.0, False), "d.wav": (2.0, False)} and names == []


def test_written_folders_go_with_their_scope(spark):
    kept = materialized(spark.range(3), "kept")
    with written(spark):
        inner = materialized(spark.range(4), "inner")
        assert inner.count() == 4
        gone = inner.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0].lstrip("/")
    assert not os.path.exists(f"/{gone}") and kept.count() == 3
