"""The cover job on tables: separate, trim, key, convert, mix."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, functions as F

from songloom.operators.pitch import AUTO_KEY_MAX, auto_key, key_priority, transpose_pitch, voiced_median
from songloom.operators.signals import (
    COMPENSATE, mix_tracks, peak_normalize, reblock, residual_track, trim_silence,
)
from songloom.session import materialized


def two_stem_job(
    songs: DataFrame,
    requests: DataFrame,
    f0: DataFrame,
    references: DataFrame,
    separate: Callable[[DataFrame], DataFrame],
    convert: Callable[[DataFrame, DataFrame], DataFrame],
    shift: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    model_keys: Mapping[str, int] | None = None,
    default_key: int = 0,
    offset: int = 0,
    limit: int = AUTO_KEY_MAX,
    lengths: DataFrame | None = None,
    compensate: float = COMPENSATE,
) -> dict[str, DataFrame]:
    """Run a batch of cover requests over block tables.

    ``songs``: block table with any number of channels. ``requests(request_id,
    signal_id, kind, model, sample_audio, reference_id, with_instrumental,
    trim)``: any number of requests per song; without a ``request_id`` each song
    is its own request. ``f0``: pitch of the vocals, by song. ``separate(blocks)`` gives the vocal blocks, ``convert(blocks,
    keys)`` the converted PCM blocks, ``shift(blocks, keys)`` moves the
    instrumental by the same keys; without it samples stay and only the pitch
    track moves.

    Every song is separated once and then stands once for each of its requests;
    from there on ``signal_id`` is the request. Vocals are trimmed only when no instrumental is mixed in: trimming would
    move them against the instrumental's time line. Returns the ``audio`` PCM
    blocks, the ``keys`` and the instrumental's transposed ``f0``.
    """
    blocks = ["signal_id", "ch", "block_no", "start_idx", "sr", "samples"]
    asked = requests.withColumnRenamed("signal_id", "song_id")
    asked = asked.withColumn("signal_id", F.col("request_id" if "request_id" in requests.columns else "song_id"))
    of_song = asked.select(F.col("song_id").alias("_song"), "signal_id", "with_instrumental", "trim")

    def per_request(by_song: DataFrame) -> DataFrame:
        return by_song.withColumnRenamed("signal_id", "_song").join(of_song, "_song").drop("_song")

    # the user functions run once; what they give is read several times below
    vocal = materialized(reblock(separate(songs).select(*blocks)), "vocals")
    whole = reblock(songs.join(asked.select(F.col("song_id").alias("signal_id")), "signal_id", "left_semi"))
    stems = per_request(materialized(residual_track(whole, vocal, compensate, regular=True), "stems"))
    vocals = stems.drop("residual")

    medians = voiced_median(f0, lengths).withColumnRenamed("signal_id", "song_id").join(
        asked.select("song_id", "signal_id", "reference_id"), "song_id"
    ).drop("song_id")
    autos = auto_key(medians, references, offset=offset, limit=limit)
    keys = materialized(key_priority(asked, autos, model_keys or {}, default_key), "keys")
    moved = keys.select("signal_id", "n_semitones")

    cut = F.col("trim") & ~F.col("with_instrumental")
    prepared = trim_silence(vocals.where(cut).select(*blocks)).unionByName(vocals.where(~cut).select(*blocks))
    converted = materialized(convert(prepared, moved).select(*blocks), "converted")
    sung = peak_normalize(converted).join(of_song.drop("_song"), "signal_id")

    instrumental = stems.where("with_instrumental").select(*blocks[:-1], F.col("residual").alias("samples"))
    if shift is not None:
        instrumental = shift(instrumental, moved)
    together = mix_tracks(sung.where("with_instrumental").select(*blocks), instrumental).select(*blocks)
    with_band = f0.withColumnRenamed("signal_id", "_song").join(
        of_song.where("with_instrumental").select("_song", "signal_id"), "_song"
    ).select(*f0.columns)
    return {
        "audio": sung.where(~F.col("with_instrumental")).select(*blocks).unionByName(together),
        "keys": keys, "f0": transpose_pitch(with_band, moved),
    }


def cover_report(job: dict[str, DataFrame]) -> DataFrame:
    """``signal_id, n_semitones, source, n_out, peak_pcm`` per produced signal."""
    sizes = job["audio"].groupBy("signal_id").agg(
        F.sum(F.size("samples")).cast("bigint").alias("n_out"),
        F.max(F.array_max(F.transform("samples", lambda x: F.abs(x.cast("int"))))).alias("peak_pcm"),
    )
    return job["keys"].select("signal_id", "n_semitones", "source").join(sizes, "signal_id")
