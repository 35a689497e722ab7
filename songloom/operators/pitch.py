"""Pitch-track statistics and voice-profile decisions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from songloom.functions.columns import blank_to_null, clamp, half_even, text
from songloom.functions.ordering import exact_median
from songloom.operators.neighbours import CELL_ENTRIES, PIVOTS, nearest_entries
from songloom.session import materialized

# Voicing gate and key limits.
MIN_VOICED_FRAMES = 50
AUTO_KEY_MAX = 5
FILTER_RADIUS = 3
INDEX_RATE = 0.5


def voiced_median(f0: DataFrame, lengths: DataFrame | None = None, min_voiced: int = MIN_VOICED_FRAMES) -> DataFrame:
    """Median pitch over voiced frames per signal, 0 when there is too little voice.

    ``lengths(signal_id, sample_count, sr)`` adds the half-second gate.
    """
    # a NaN compares as greater than every number, and is no voice
    sung = (F.col("hz") > 0) & ~F.isnan("hz")
    signals = f0.groupBy("signal_id").agg(F.count(F.when(sung, 1)).alias("voiced"))
    medians = exact_median(f0.where(sung), "signal_id", "hz", out="_median")
    joined = signals.join(medians.select("signal_id", "_median"), "signal_id", "left")
    enough = F.col("voiced") >= min_voiced
    if lengths is not None:
        joined = joined.join(lengths.select("signal_id", "sample_count", "sr"), "signal_id", "left")
        enough = enough & (F.coalesce("sample_count", F.lit(0)) >= F.floor(F.col("sr") / 2))
    return joined.select(
        "signal_id", "voiced", F.when(enough, F.col("_median")).otherwise(F.lit(0.0)).alias("median_hz")
    )


def semitones(reference_hz: Column, song_hz: Column, offset: int = 0, limit: int = AUTO_KEY_MAX) -> Column:
    """Nearest semitone distance plus offset, then limited to ±limit (at least 1)."""
    bound = max(1, int(limit))
    steps = half_even(F.lit(12.0) * F.log2(reference_hz / song_hz)).cast("int") + F.lit(int(offset))
    return clamp(steps, -bound, bound)


def auto_key(
    songs: DataFrame, references: DataFrame, by: str = "reference_id", offset: int = 0, limit: int = AUTO_KEY_MAX
) -> DataFrame:
    """Semitones that move each song's median pitch to its reference's.

    ``songs(signal_id, <by>, median_hz)``; ``references(<by>, median_hz)``.
    Without a usable pitch on either side the key is null and ``reason`` says why.
    """
    ref = references.select(by, F.col("median_hz").alias("_ref"))
    ok = (F.col("_ref") > 0) & (F.col("median_hz") > 0)
    reason = (
        F.when(F.col("_ref").isNull(), "no_reference")
        .when(~(F.coalesce("median_hz", F.lit(0.0)) > 0), "song_unvoiced")
        .when(~(F.col("_ref") > 0), "reference_unvoiced")
        .otherwise("ok")
    )
    return songs.join(materialized(ref, "references"), by, "left").select(
        "signal_id",
        F.when(ok, semitones(F.col("_ref"), F.col("median_hz"), offset, limit)).alias("n_semitones"),
        reason.alias("reason"),
    )


def key_priority(
    requests: DataFrame,
    auto_keys: DataFrame,
    model_keys: Mapping[str, int] | DataFrame,
    default_key: int = 0,
    auto_enabled: bool = True,
) -> DataFrame:
    """Manual key, else automatic key (covers only), else the default.

    ``requests(signal_id, kind, model, sample_audio)``. A mapping of manual keys
    becomes a literal map; a large one can be given as ``(model, key)`` rows.
    A request whose automatic key is null falls through to the default.
    """
    keyed = requests.withColumn("_model", text(F.col("model")))
    if isinstance(model_keys, DataFrame):
        manual = model_keys.select(F.col("model").alias("_model"), F.col("key").alias("_manual"))
        keyed = keyed.join(manual, "_model", "left")
    elif model_keys:
        pairs = [F.lit(v) for kv in model_keys.items() for v in kv]
        keyed = keyed.withColumn("_manual", F.try_element_at(F.create_map(*pairs), F.col("_model")))
    else:
        keyed = keyed.withColumn("_manual", F.lit(None).cast("int"))
    autos = auto_keys.select("signal_id", F.col("n_semitones").alias("_auto"))
    joined = keyed.join(autos, "signal_id", "left")
    usable = F.lit(bool(auto_enabled)) & blank_to_null(F.col("sample_audio")).isNotNull() & (F.col("kind") == "cover")
    auto = F.when(usable, F.col("_auto"))
    source = (
        F.when(F.col("_manual").isNotNull(), "manual").when(auto.isNotNull(), "auto").otherwise("default")
    )
    return joined.select(
        "signal_id", "kind",
        F.coalesce("_manual", auto, F.lit(int(default_key))).cast("int").alias("n_semitones"),
        source.alias("source"),
    )


def transpose_pitch(f0: DataFrame, keys: DataFrame) -> DataFrame:
    """Shift pitch tracks by ``keys(signal_id, n_semitones)``; unvoiced frames, NaN among them, are 0."""
    shift = keys.select("signal_id", "n_semitones")
    factor = F.pow(F.lit(2.0), F.coalesce("n_semitones", F.lit(0)) / F.lit(12.0))
    hz = F.when((F.col("hz") > 0) & ~F.isnan("hz"), F.col("hz") * factor).otherwise(F.lit(0.0))
    return f0.join(materialized(shift, "keys"), "signal_id", "left").withColumn("hz", hz).select(*f0.columns)


def profile_incremental(current: DataFrame, history: DataFrame, frames: DataFrame) -> DataFrame:
    """Refresh reference profiles whose ``(path, mtime)`` is not in the history.

    ``current(path, mtime)``, ``history(path, mtime, median_hz)`` and
    ``frames(path, hz)``. Any change of mtime counts, older ones too. Only the
    frames of missing paths are read into the median.
    """
    version = ["path", "mtime"]
    hits = history.join(current.select(*version), version, "left_semi").select(
        *version, "median_hz", F.lit(False).alias("recomputed")
    )
    misses = current.select(*version).join(history.select(*version), version, "left_anti")
    wanted = frames.join(materialized(misses.select("path"), "misses"), "path", "left_semi").select(
        F.col("path").alias("signal_id"), "hz"
    )
    fresh = voiced_median(wanted).select(
        F.col("signal_id").alias("path"), F.nullif("median_hz", F.lit(0.0)).alias("median_hz")
    )
    return hits.unionByName(
        misses.join(fresh, "path", "left").select(*version, "median_hz", F.lit(True).alias("recomputed"))
    )


def f0_median_filter(f0: DataFrame, radius: int = FILTER_RADIUS, block: int = 4096) -> DataFrame:
    """Median over ±radius frames, active from radius 3 on.

    The track is cut into blocks of frames; frames near an edge are copied to
    the neighbour block, so windows never span a whole signal and a hot signal
    spreads over tasks. Frame numbers must be consecutive within a signal.
    """
    if radius < 3:
        return f0.select("signal_id", "frame_no", "hz")
    if block < radius:
        raise ValueError("block must not be shorter than the radius")
    own = F.floor(F.col("frame_no") / block)
    place = F.pmod(F.col("frame_no"), F.lit(block))
    copies = F.array_compact(
        F.array(own, F.when(place < radius, own - 1), F.when(place >= block - radius, own + 1))
    )
    spread = f0.select("signal_id", "frame_no", "hz", own.alias("_own"), F.explode(copies).alias("_block"))
    near = W.partitionBy("signal_id", "_block").orderBy("frame_no").rowsBetween(-radius, radius)
    around = F.array_sort(F.collect_list("hz").over(near))
    n = F.size("_around")
    mid = (F.get("_around", F.floor((n - 1) / 2).cast("int")) + F.get("_around", F.floor(n / 2).cast("int"))) / 2
    return (
        spread.withColumn("_around", around)
        .where(F.col("_own") == F.col("_block"))
        .select("signal_id", "frame_no", mid.alias("hz"))
    )


def centroid_index(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Mean vector per label, averaged by position with partial aggregation."""
    parts = vectors.select(label, F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("entry")
    ).withColumnRenamed(label, "entry_id")


def retrieval_blend(
    vectors: DataFrame, index: DataFrame, rate: float = INDEX_RATE, k: int = 1, tile: int = CELL_ENTRIES, pivots: int = PIVOTS
) -> DataFrame:
    """Blend each vector with the mean of its ``k`` nearest index entries, component by component.

    Vectors ``(vec_id, embedding)`` and entries ``(entry_id, entry)`` are compared
    by Euclidean distance, ties by id; the search is exact, see :func:`nearest_entries`;
    at most about ``tile`` entries of a cell meet in one group.
    Null vectors and those with null or non-finite components have no rows; where
    no entry is usable, a vector stays as it is.
    """
    probes = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("_v"))
    doubles = index.select("entry_id", F.transform("entry", lambda x: x.cast("double")).alias("entry"))
    best = nearest_entries(probes, doubles, k, pivots, tile)
    zero = F.transform("_v", lambda _: F.lit(0.0))
    near = F.aggregate("_best", zero, lambda acc, e: F.zip_with(acc, e["entry"], lambda a, b: a + b))
    mixed = F.zip_with("_v", near, lambda v, s: v * (1.0 - rate) + s / F.size("_best") * rate)
    blended = F.when(F.size(F.coalesce("_best", F.array())) > 0, mixed).otherwise(F.col("_v"))
    return best.select("vec_id", F.posexplode(blended).alias("pos", "value"))
