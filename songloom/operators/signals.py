"""Signal arithmetic on block tables.

A block table holds ``signal_id, ch, block_no, start_idx, sr, samples``: one
row per channel and bounded run of samples. Per-sample work stays inside the
row (higher-order functions); only one small row per signal crosses a shuffle.
That row is written first and joined back without a hint: the planner knows its
size and broadcasts it when that allows; adaptive execution splits skewed signals
otherwise.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from songloom.functions.columns import clamp, half_even
from songloom.session import materialized

# Loudness, silence and mixing constants.
TARGET_PEAK = 0.89
INT16_MAX = 32767.0
INT16_SCALE = 32768.0
PCM_HEADROOM = 0.99
SILENCE_FACTOR = 0.01
SILENCE_PAD_SECONDS = 0.05
INSTRUMENTAL_GAIN = 0.85
COMPENSATE = 1.035
# Separation chunk layout.
CHUNK_SAMPLES = 4 * 44100
CHUNK_MARGIN = 44100
N_FFT = 6144
HOP = 1024
# Samples of a block in the regular layout.
BLOCK = 65536

SAMPLES = "array<double>"
PLACE = ("signal_id", "ch", "block_no")


def map_samples(fn, col: str = "samples") -> Column:
    return F.transform(F.col(col), fn)


def long_form(blocks: DataFrame, value: str = "samples", out: str = "value", *keep: str) -> DataFrame:
    """One row per sample: ``signal_id, [keep...], idx, value``."""
    return blocks.select(
        "signal_id", *keep, "start_idx", F.posexplode(value).alias("_pos", out)
    ).select("signal_id", *keep, (F.col("start_idx") + F.col("_pos")).cast("bigint").alias("idx"), out)


def block_peak(col: str = "samples") -> Column:
    """Largest magnitude inside one block, computed in a wider type than int16.

    From the two extremes, which generated code finds without a lambda.
    """
    high, low = F.array_max(col).cast("double"), F.array_min(col).cast("double")
    return F.greatest(F.abs(high), F.abs(low))


def _with_signal(blocks: DataFrame, per_signal: DataFrame) -> DataFrame:
    """Blocks with their signal's row, written first; samples are shuffled only if that table is large."""
    return blocks.join(materialized(per_signal, "per-signal"), "signal_id")


def _cut_array(col, lo: Column, length: Column) -> Column:
    """``length`` elements from position ``lo``; the length guard also holds for
    rows a later filter drops, since the two may be evaluated in either order."""
    return F.slice(col, (lo + 1).cast("int"), F.greatest(length, F.lit(0)).cast("int"))


def downmix_mono(blocks: DataFrame) -> DataFrame:
    """Mean over channels per sample; groups hold one block per channel."""
    grouped = blocks.groupBy("signal_id", "block_no").agg(
        F.min("start_idx").alias("start_idx"), F.max("sr").alias("sr"),
        F.array_sort(F.collect_list(F.struct("ch", "samples"))).alias("_chs"),
    )
    first = F.col("_chs")[0]["samples"]
    total = F.aggregate(
        F.slice(F.col("_chs"), 2, F.greatest(F.size("_chs") - 1, F.lit(0))),
        first.cast(SAMPLES),
        lambda acc, c: F.zip_with(acc, c["samples"], lambda a, b: a + b),
    )
    return grouped.select(
        "signal_id", F.lit(0).alias("ch"), "block_no", "start_idx", "sr",
        F.transform(total, lambda x: x / F.size("_chs")).alias("samples"),
    )


def duplicate_mono(blocks: DataFrame) -> DataFrame:
    """Mono signals become two equal channels; others pass unchanged."""
    channels = blocks.groupBy("signal_id").agg((F.max("ch") == F.min("ch")).alias("_mono"))
    mono = F.array(F.lit(0), F.lit(1))
    return _with_signal(blocks, channels).withColumn(
        "ch", F.explode(F.when(F.col("_mono"), mono).otherwise(F.array(F.col("ch").cast("int"))))
    ).select("signal_id", "ch", "block_no", "start_idx", "sr", "samples")


def pcm_to_float(blocks: DataFrame) -> DataFrame:
    """Integer samples over 32768; floating samples pass through."""
    element = blocks.schema["samples"].dataType.elementType.typeName()
    if element in ("byte", "short", "integer", "long"):
        return blocks.withColumn("samples", map_samples(lambda x: x.cast("double") / INT16_SCALE))
    return blocks.withColumn("samples", F.col("samples").cast(SAMPLES))


def pcm16_value(x: Column) -> Column:
    return half_even(clamp(x, -1.0, 1.0) * INT16_MAX * PCM_HEADROOM).cast("smallint")


def float_to_pcm16(blocks: DataFrame) -> DataFrame:
    """Clip to full scale, leave one percent headroom, round half to even."""
    return blocks.withColumn("samples", map_samples(pcm16_value))


def peak_stats(blocks: DataFrame) -> DataFrame:
    """Largest magnitude per signal over all channels, 0 for an empty one."""
    return blocks.groupBy("signal_id").agg(F.coalesce(F.max(block_peak()), F.lit(0.0)).alias("peak"))


def peak_normalize(blocks: DataFrame, target_peak: float = TARGET_PEAK) -> DataFrame:
    """Lower PCM signals to the target peak; quiet or silent ones stay as they are."""
    scaled = _with_signal(blocks, peak_stats(blocks)).withColumn("_scale", F.lit(target_peak * INT16_MAX) / F.nullif(F.col("peak"), F.lit(0.0)))
    loud = (F.col("peak") > 0) & (F.col("_scale") < 1.0)
    lowered = map_samples(lambda x: half_even(x.cast("double") * F.col("_scale")).cast("smallint"))
    return scaled.withColumn(
        "samples", F.when(loud, lowered).otherwise(map_samples(lambda x: x.cast("smallint")))
    ).drop("peak", "_scale")


def silence_bounds(
    blocks: DataFrame, threshold_factor: float = SILENCE_FACTOR, pad_seconds: float = SILENCE_PAD_SECONDS
) -> DataFrame:
    """Per signal the half-open range ``[start_idx, end_idx)`` left after trimming."""
    peaks = blocks.groupBy("signal_id").agg(F.coalesce(F.max(block_peak()), F.lit(0.0)).alias("peak"))
    limit = F.col("peak") * threshold_factor
    active = map_samples(lambda x: F.abs(x.cast("double")) > limit)
    first = F.array_position(active, True)
    last = F.array_position(F.reverse(active), True)
    size = F.size("samples")
    spans = (
        _with_signal(blocks, peaks)
        .select(
            "signal_id", "sr", "peak",
            (F.col("start_idx") + size).alias("_stop"),
            F.when(first > 0, F.col("start_idx") + first - 1).alias("_first"),
            F.when(last > 0, F.col("start_idx") + size - last).alias("_last"),
        )
        .groupBy("signal_id")
        .agg(
            F.max("sr").alias("sr"), F.max("peak").alias("peak"), F.max("_stop").alias("n"),
            F.min("_first").alias("_first"), F.max("_last").alias("_last"),
        )
    )
    pad = F.floor(F.lit(pad_seconds) * F.col("sr"))
    whole = (F.col("peak") <= 0) | F.col("_first").isNull()
    start = F.when(whole, 0).otherwise(F.greatest(F.lit(0), F.col("_first") - pad)).cast("bigint")
    end = F.when(whole, F.col("n")).otherwise(F.least(F.col("n"), F.col("_last") + 1 + pad)).cast("bigint")
    return spans.select("signal_id", start.alias("start_idx"), end.alias("end_idx"), (end - start).alias("kept"))


def cut(blocks: DataFrame, bounds: DataFrame) -> DataFrame:
    """Keep only samples inside each signal's bounds; indexes restart at 0."""
    limits = bounds.select("signal_id", F.col("start_idx").alias("_from"), F.col("end_idx").alias("_to"))
    size = F.size("samples")
    lo = F.greatest(F.col("_from") - F.col("start_idx"), F.lit(0))
    hi = F.least(F.col("_to") - F.col("start_idx"), size)
    return (
        _with_signal(blocks, limits)
        .where((F.col("start_idx") < F.col("_to")) & (F.col("start_idx") + size > F.col("_from")))
        .select(
            "signal_id", "ch", "block_no",
            (F.col("start_idx") + lo - F.col("_from")).alias("start_idx"), "sr",
            _cut_array("samples", lo, hi - lo).alias("samples"),
        )
    )


def trim_silence(
    blocks: DataFrame, threshold_factor: float = SILENCE_FACTOR, pad_seconds: float = SILENCE_PAD_SECONDS
) -> DataFrame:
    return cut(blocks, silence_bounds(blocks, threshold_factor, pad_seconds))


def reblock(blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    """The same samples in blocks of ``size``: block k holds the samples from ``k * size`` on, only the last is shorter.

    Pieces meet by block, so a group is one block whatever the signal's length.
    Blocks must not overlap; gaps are closed up only if no sample lies between.
    """
    length, kind = F.size("samples"), blocks.schema["samples"].dataType
    first, last = F.floor(F.col("start_idx") / size), F.floor((F.col("start_idx") + length - 1) / size)
    pieces = (
        blocks.where(length > 0).withColumn("_cell", F.explode(F.sequence(first, last)))
        .withColumn("_lo", F.greatest(F.col("_cell") * size - F.col("start_idx"), F.lit(0)).cast("int"))
        .withColumn("_len", (F.least((F.col("_cell") + 1) * size - F.col("start_idx"), length) - F.col("_lo")).cast("int"))
        .select(
            "signal_id", "ch", F.col("_cell").alias("block_no"), "sr",
            F.struct(
                (F.col("start_idx") + F.col("_lo")).cast("bigint").alias("at"),
                _cut_array("samples", F.col("_lo"), F.col("_len")).alias("part"),
            ).alias("_piece"),
        )
    )
    return pieces.groupBy("signal_id", "ch", "block_no").agg(
        F.max("sr").alias("sr"), F.sort_array(F.collect_list("_piece")).alias("_p")
    ).select(
        "signal_id", "ch", "block_no", F.col("_p")[0]["at"].alias("start_idx"), "sr",
        F.flatten(F.transform("_p", lambda p: p["part"])).cast(kind).alias("samples"),
    )


def _paired(first: DataFrame, second: DataFrame, regular: bool = False, place: tuple[str, ...] = PLACE) -> DataFrame:
    """Blocks of ``first`` with the samples of ``second`` at the same place.

    Missing samples are zeros and surplus ones are dropped, so the second track
    takes the first one's length. Both are brought to one regular layout first.
    Tables known to share one (as :func:`reblock` and the file scan write it)
    may pass ``regular`` and are joined as they are; blocks of one number that
    start at different places are then an error.
    """
    if not regular:
        first, second = reblock(first), reblock(second)
    other = second.select(*place, F.col("samples").cast(SAMPLES).alias("_raw"), F.col("start_idx").alias("_at"))
    joined = first.join(other, list(place), "left")
    agrees = F.col("_at").isNull() | (F.col("_at") == F.col("start_idx"))
    joined = joined.withColumn("_raw", F.when(agrees, F.col("_raw")).otherwise(
        F.raise_error(F.lit("the tracks have different block layouts")).cast(SAMPLES)
    )).drop("_at")
    size = F.size("samples")
    fitted = F.slice(F.concat("_raw", F.array_repeat(F.lit(0.0), size)), F.lit(1), size)
    return joined.withColumn(
        "other",
        F.when(F.size("_raw") == size, F.col("_raw"))
        .when(F.col("_raw").isNull(), F.array_repeat(F.lit(0.0), size))
        .otherwise(fitted),
    ).drop("_raw")


def align_tracks(first: DataFrame, second: DataFrame, regular: bool = False) -> DataFrame:
    """The second track padded with zeros or truncated to the first one's length."""
    return _paired(first, second, regular).drop("samples").withColumnRenamed("other", "samples")


def _mono_blocks(blocks: DataFrame, rate: Column, size: int = BLOCK) -> DataFrame:
    """One channel at the given rate in regular blocks, in one exchange of samples.

    A block is cut into what the output blocks need of it: the samples under
    their grid and, if the rate changes, one more on the right. The pieces of an output
    block meet as they are, channels and all; there they are averaged, then interpolated.
    """
    s, t = F.col("sr").cast("bigint"), rate.cast("bigint")
    start, length, kept = F.col("start_idx").cast("bigint"), F.size("samples"), s == t
    first = F.when(kept, start).otherwise(F.greatest(F.ceil((start - 1) * t / s), F.lit(0)).cast("bigint"))
    last = F.when(kept, start + length - 1).otherwise((F.ceil((start + length) * t / s) - 1).cast("bigint"))
    head = F.col("_cell") * size
    # the samples under an output block
    need_from = F.when(kept, head).otherwise(F.expr("_cell * {0} * sr div _rate".format(size)))
    need_to = F.when(kept, head + size).otherwise(F.expr("((_cell + 1) * {0} - 1) * sr div _rate + 2".format(size)))
    lo = F.greatest(need_from, start) - start
    pieces = (
        blocks.where(length > 0).withColumn("_rate", t)
        .withColumn("_cell", F.explode(F.sequence(F.floor(first / size), F.floor(last / size))))
        .withColumn("_lo", lo.cast("int"))
        .withColumn("_len", (F.least(need_to, start + length) - start - F.col("_lo")).cast("int"))
        .where(F.col("_len") > 0)
        .select(
            "signal_id", F.col("_cell").alias("block_no"), "sr", "_rate",
            F.struct("ch", (start + F.col("_lo")).alias("at"), _cut_array(F.col("samples").cast(SAMPLES), F.col("_lo"), F.col("_len")).alias("part")).alias("_piece"),
        )
    )
    met = pieces.groupBy("signal_id", "block_no").agg(
        F.max("sr").cast("bigint").alias("sr"), F.max("_rate").alias("_rate"), F.sort_array(F.collect_list("_piece")).alias("_p")
    )
    channels = F.array_distinct(F.transform("_p", lambda p: p["ch"]))
    whole = F.transform("_chs", lambda c: F.flatten(F.transform(F.filter("_p", lambda p: p["ch"].eqNullSafe(c)), lambda p: p["part"])))
    total = F.aggregate(
        F.slice("_whole", 2, F.greatest(F.size("_whole") - 1, F.lit(0))), F.col("_whole")[0], lambda acc, c: F.zip_with(acc, c, lambda a, b: a + b)
    )
    mono = met.withColumn("_chs", channels).withColumn("_whole", whole).withColumn("_begin", F.col("_p")[0]["at"]).select(
        "signal_id", "block_no", "sr", "_rate", "_begin", F.transform(total, lambda x: x / F.size("_chs")).alias("_mono")
    )
    stop = F.least((F.col("block_no") + 1) * size, F.ceil((F.col("_begin") + F.size("_mono")) * F.col("_rate") / F.col("sr")).cast("bigint"))

    # samples of an unchanged rate are not sent to the function
    changed = F.col("sr") != F.col("_rate")
    edge, bounds = F.when(changed, F.element_at("_mono", -1)), [F.when(changed, x).otherwise(0).cast("bigint") for x in (F.col("_begin"), F.col("block_no") * size, stop)]
    between = F.arrow_udf(_interpolate, SAMPLES)(F.when(changed, F.col("_mono")), edge, *bounds, "sr", "_rate")
    return mono.select(
        "signal_id", F.lit(0).alias("ch"), "block_no",
        F.when(changed, F.col("block_no") * size).otherwise(F.col("_begin")).cast("bigint").alias("start_idx"),
        F.col("_rate").cast("int").alias("sr"), F.when(changed, between).otherwise(F.col("_mono")).alias("samples"),
    )


def mix_tracks(
    vocal: DataFrame, instrumental: DataFrame, gain: float = INSTRUMENTAL_GAIN, regular: bool = False
) -> DataFrame:
    """Add the scaled second track, scale back if over full scale, to 16-bit PCM.

    Both tracks are mixed down to one channel and the second is resampled to the
    first one's rate, each in a single exchange of its samples. ``regular`` says that both have one channel, one rate and
    one regular layout already; they are then paired as they are. The sum is
    written once with the peak of each block and then only scaled.
    """
    first, second = pcm_to_float(vocal), pcm_to_float(instrumental)
    place = PLACE
    if not regular:
        rates = first.groupBy("signal_id").agg(F.max("sr").alias("_target"))
        second = _with_signal(second, rates)
        first, second = _mono_blocks(first, F.col("sr")), _mono_blocks(second, F.col("_target"))
        place = ("signal_id", "block_no")  # what both are grouped by already
    summed = _paired(first, second, True, place).withColumn(
        "samples", F.zip_with("samples", "other", lambda a, b: a + b * gain)
    ).drop("other")
    summed = materialized(summed.withColumn("_peak", block_peak()), "mixed")
    peaks = summed.groupBy("signal_id").agg(F.coalesce(F.max("_peak"), F.lit(0.0)).alias("peak"))
    ratio = F.when(F.col("peak") > 1.0, F.lit(1.0) / F.col("peak")).otherwise(F.lit(1.0))
    return (
        _with_signal(summed, peaks)
        .withColumn("_ratio", ratio)
        .withColumn("samples", map_samples(lambda x: pcm16_value(x * F.col("_ratio"))))
        .drop("peak", "_peak", "_ratio")
    )


def residual_track(
    whole: DataFrame, part: DataFrame, compensate: float = COMPENSATE, regular: bool = False
) -> DataFrame:
    """Whole minus the raised and clipped part; ``samples`` is the part, ``residual`` the rest.

    The pair is formed and written once, with the peak of each block's rest.
    """
    pairs = _paired(whole.withColumn("samples", F.col("samples").cast(SAMPLES)), part, regular)
    raised = F.transform("other", lambda x: clamp(x * compensate, -1.0, 1.0))
    split = pairs.withColumn("_part", raised).withColumn(
        "residual", F.zip_with("samples", "_part", lambda w, p: w - p)
    ).drop("samples", "other")
    split = materialized(split.withColumn("_peak", block_peak("residual")), "residual")
    peaks = split.groupBy("signal_id").agg(F.max("_peak").alias("peak"))
    fixed = F.when(
        F.col("peak") > 1.0, F.transform("residual", lambda x: x / F.col("peak") * PCM_HEADROOM)
    ).otherwise(F.col("residual"))
    return _with_signal(split, peaks).select(
        "signal_id", "ch", "block_no", "start_idx", "sr",
        F.col("_part").alias("samples"), fixed.alias("residual"),
    )


def chunk_overlap(blocks: DataFrame, outer: int = CHUNK_SAMPLES, margin: int = CHUNK_MARGIN) -> DataFrame:
    """Cut signals into outer chunks that share ``margin`` samples with neighbours.

    Which chunks a block belongs to is arithmetic on its position, so blocks
    are sliced in place; only the signal length is joined in. The result is a
    block table per chunk with ``chunk_start`` (its grid position) and the
    half-open range ``[chunk_lo, chunk_hi)`` it covers.
    """
    margin = min(margin, outer)
    size = F.size("samples")
    lengths = blocks.groupBy("signal_id").agg(F.max(F.col("start_idx") + size).cast("bigint").alias("n"))
    # chunk k > 0 exists while the one before it stops short of the end
    last_chunk = F.greatest(F.floor((F.col("n") - margin - 1) / outer), F.lit(0))
    lo_k = F.greatest(F.floor((F.col("start_idx") - outer - margin) / outer) + 1, F.lit(0))
    hi_k = F.least(last_chunk, F.floor((F.col("start_idx") + size - 1 + margin) / outer))
    start = F.col("_k") * outer
    placed = (
        _with_signal(blocks.where(size > 0), lengths)
        .where(lo_k <= hi_k)
        .withColumn("_k", F.explode(F.sequence(lo_k, hi_k)))
        .withColumn("chunk_start", start.cast("bigint"))
        .withColumn("chunk_lo", F.when(F.col("_k") == 0, F.lit(0)).otherwise(start - margin).cast("bigint"))
        .withColumn("chunk_hi", F.least(start + outer + margin, F.col("n")).cast("bigint"))
    )
    lo = F.greatest(F.col("chunk_lo") - F.col("start_idx"), F.lit(0))
    hi = F.least(F.col("chunk_hi") - F.col("start_idx"), size)
    return (
        placed.withColumn("_lo", lo.cast("int")).withColumn("_len", (hi - lo).cast("int"))
        .where(F.col("_len") > 0)
        .select(
            "signal_id", "ch", "block_no", "chunk_start", "chunk_lo", "chunk_hi",
            (F.col("start_idx") + F.col("_lo")).cast("bigint").alias("start_idx"), "sr",
            _cut_array("samples", F.col("_lo"), F.col("_len")).alias("samples"),
        )
    )


def stitch_chunks(chunks: DataFrame) -> DataFrame:
    """Undo :func:`chunk_overlap`: drop inner margins and put chunks end to end.

    Chunks stand on a regular grid, whose step is the second chunk's start; each
    keeps what lies before the next one. A block that a chunk ends in comes back
    in two parts with its number; :func:`reblock` makes the layout regular.
    """
    start = F.col("chunk_start")
    ends = chunks.groupBy("signal_id").agg(F.max(start).alias("_last"), F.min(F.when(start > 0, start)).alias("_step"))
    stop = F.when(start == F.col("_last"), F.col("chunk_hi")).otherwise(start + F.col("_step"))
    size = F.size("samples")
    lo = F.greatest(start - F.col("start_idx"), F.lit(0))
    hi = F.least(stop - F.col("start_idx"), size)
    return (
        _with_signal(chunks, ends)
        .withColumn("_lo", lo.cast("int")).withColumn("_len", (hi - lo).cast("int"))
        .where(F.col("_len") > 0)
        .select(
            "signal_id", "ch", "block_no", (F.col("start_idx") + F.col("_lo")).alias("start_idx"), "sr",
            _cut_array("samples", F.col("_lo"), F.col("_len")).alias("samples"),
        )
    )


def frame_signal(chunks: DataFrame, frame: int, trim: int) -> DataFrame:
    """Overlapping frames inside each chunk, with ``trim`` zeros before and after.

    Frames advance by ``frame - 2*trim``. A frame whose samples lie in one block is
    cut where the block is; only the pieces of frames over a block's edge move, less
    than two frames for each block, and are put together, one frame to a group.
    """
    hop = frame - 2 * trim
    if hop <= 0:
        raise ValueError("frame must be longer than twice the trim")
    size = F.size("samples")
    at = F.col("start_idx") - F.col("chunk_lo") + trim
    n = F.col("chunk_hi") - F.col("chunk_lo")
    n_frames = F.ceil(n / hop)
    lo_f = F.greatest(F.floor((at - frame) / hop) + 1, F.lit(0))
    hi_f = F.least(F.floor((at + size - 1) / hop), n_frames - 1)
    # where a frame's samples begin and end, without the zeros around the chunk
    real_lo, real_hi = F.greatest(F.col("_f0"), F.lit(trim)), F.least(F.col("_f0") + frame, n + trim)
    cut_out = (
        chunks.where(size > 0)
        .withColumn("_at", at.cast("bigint"))
        .withColumn("frame_no", F.explode(F.sequence(lo_f, hi_f)))
        .withColumn("_f0", F.col("frame_no") * hop)
        .withColumn("_lo", F.greatest(F.col("_f0") - F.col("_at"), F.lit(0)).cast("int"))
        .withColumn("_len", (F.least(F.col("_f0") + frame - F.col("_at"), size) - F.col("_lo")).cast("int"))
        .where(F.col("_len") > 0)
        .withColumn("_whole", (real_lo >= F.col("_at")) & (real_hi <= F.col("_at") + size))
    )
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    filled = lambda front, body: F.concat(zeros(front), body, zeros(F.lit(frame) - front - F.size(body)))
    offset = (F.col("_at") + F.col("_lo") - F.col("_f0")).cast("int")
    body = _cut_array(F.col("samples").cast(SAMPLES), F.col("_lo"), F.col("_len"))
    place = ["signal_id", "ch", "chunk_start", "frame_no"]
    in_place = cut_out.where("_whole").select(*place, "sr", filled(offset, body).alias("samples"))
    glued = (
        cut_out.where(~F.col("_whole")).select(*place, "sr", offset.alias("_off"), body.alias("_piece"))
        .groupBy(*place).agg(F.max("sr").alias("sr"), F.array_sort(F.collect_list(F.struct("_off", "_piece"))).alias("_p"))
        .withColumn("_body", F.flatten(F.transform("_p", lambda p: p["_piece"])))
        .select(*place, "sr", filled(F.col("_p")[0]["_off"], F.col("_body")).alias("samples"))
    )
    return in_place.unionByName(glued)


def spectrum_frames(frames: DataFrame) -> DataFrame:
    """Magnitude spectrum of each frame, one array of ``n/2 + 1`` bins per row."""

    @F.arrow_udf("array<double>")
    def magnitudes(samples: pa.Array) -> pa.Array:
        import numpy as np

        edges, values = np.asarray(samples.offsets), np.asarray(samples.values)
        spectra = [np.abs(np.fft.rfft(values[a:b])) for a, b in zip(edges[:-1], edges[1:])]
        sizes = np.cumsum([0] + [len(x) for x in spectra])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(spectra or [values[:0]])))

    return frames.withColumn("magnitude", magnitudes(F.col("samples").cast(SAMPLES))).drop("samples")


def _interpolate(
    samples: pa.Array, following: pa.Array, begin: pa.Array, first: pa.Array, stop: pa.Array, sr: pa.Array, to: pa.Array
) -> pa.Array:
    """Values between known samples; ``following`` is the sample after them. Null samples give none."""
    import numpy as np

    edges, values = np.asarray(samples.offsets), np.asarray(samples.values)
    out = []
    for row, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        at = np.arange(first[row].as_py(), stop[row].as_py(), dtype=np.int64) * sr[row].as_py()
        if not len(at):
            out.append(values[:0])
            continue
        known, rate = np.append(values[a:b], following[row].as_py()), to[row].as_py()
        left = at // rate - begin[row].as_py()
        out.append(known[left] + (known[left + 1] - known[left]) * (at % rate / rate))
    sizes = np.cumsum([0] + [len(x) for x in out])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(out or [values[:0]])))


def resample_linear(blocks: DataFrame, target_sr: int | None) -> DataFrame:
    """Change the sample rate by linear interpolation; None: to the rate in the column ``target_sr``.

    A block makes what lies between its own samples, in place. What follows its
    last sample needs the head of the next block: these come from a table of edge
    samples, two numbers for each block, and form a short block of their own.
    Output blocks are numbered ``2 * block_no`` and ``2 * block_no + 1``. Positions are exact integer arithmetic.
    """
    typed = blocks.where(F.size("samples") > 0).withColumn("samples", F.col("samples").cast(SAMPLES))
    t, s = (F.col("target_sr") if target_sr is None else F.lit(target_sr)).cast("bigint"), F.col("sr").cast("bigint")
    start, size = F.col("start_idx").cast("bigint"), F.size("samples")
    first, edge, stop = (F.ceil(x * t / s).cast("bigint") for x in (start, start + size - 1, start + size))
    inner = (
        typed.withColumn("_first", first).withColumn("_stop", edge).where(F.col("_first") < F.col("_stop"))
        .withColumn("_out", F.arrow_udf(_interpolate, SAMPLES)("samples", F.element_at("samples", -1), start, "_first", "_stop", s, t))
        .select(
            "signal_id", "ch", (2 * F.col("block_no")).alias("block_no"), F.col("_first").alias("start_idx"),
            t.cast("int").alias("sr"), F.col("_out").alias("samples"),
        )
    )
    none = lambda kind: F.lit(None).cast(kind)
    ends = typed.select("signal_id", "ch", F.explode(F.array(
        F.struct(
            F.col("block_no").cast("bigint").alias("no"), F.element_at("samples", -1).alias("last"), none("double").alias("next"),
            edge.alias("first"), stop.alias("stop"), s.alias("s"), t.alias("t"),
        ),
        F.struct(
            (F.col("block_no") - 1).cast("bigint").alias("no"), none("double").alias("last"), F.col("samples")[0].alias("next"),
            none("bigint").alias("first"), none("bigint").alias("stop"), none("bigint").alias("s"), none("bigint").alias("t"),
        ),
    )).alias("e")).select("signal_id", "ch", "e.*")
    met = ends.groupBy("signal_id", "ch", "no").agg(*[F.max(c).alias(c) for c in ("last", "next", "first", "stop", "s", "t")])
    after = F.coalesce("next", "last")
    between = F.transform(
        F.sequence(F.col("first"), F.col("stop") - 1), lambda j: F.col("last") + (after - F.col("last")) * (j * F.col("s") % F.col("t") / F.col("t"))
    )
    outer = met.where(F.col("last").isNotNull() & (F.col("first") < F.col("stop"))).select(
        "signal_id", "ch", (2 * F.col("no") + 1).alias("block_no"), F.col("first").alias("start_idx"), F.col("t").cast("int").alias("sr"), between.alias("samples"),
    )
    return inner.unionByName(outer.withColumn("block_no", F.col("block_no").cast(inner.schema["block_no"].dataType)))


def frame_rms(blocks: DataFrame, frame: int) -> DataFrame:
    """Root mean square per signal and frame of ``frame`` samples.

    Blocks are cut at frame edges and give one partial sum per frame, so the
    shuffle carries sums, not samples.
    """
    size = F.size("samples")
    lo_f = F.floor(F.col("start_idx") / frame)
    hi_f = F.floor((F.col("start_idx") + size - 1) / frame)
    parts = (
        blocks.where(size > 0)
        .withColumn("frame_no", F.explode(F.sequence(lo_f, hi_f)))
        .withColumn("_lo", F.greatest(F.col("frame_no") * frame - F.col("start_idx"), F.lit(0)).cast("int"))
        .withColumn(
            "_len",
            (F.least((F.col("frame_no") + 1) * frame - F.col("start_idx"), size) - F.col("_lo")).cast("int"),
        )
        .withColumn("_part", _cut_array(F.col("samples").cast(SAMPLES), F.col("_lo"), F.col("_len")))
    )
    square = F.aggregate("_part", F.lit(0.0), lambda acc, x: acc + x * x)
    return parts.groupBy("signal_id", "frame_no").agg(
        F.sqrt(F.sum(square) / F.sum("_len")).alias("rms")
    )


def rms_envelope_mix(source: DataFrame, output: DataFrame, frame: int, rate: float = 0.25) -> DataFrame:
    """Gain per frame that moves the output's loudness toward the source's."""
    src = frame_rms(source, frame).withColumnRenamed("rms", "_src")
    out = frame_rms(output, frame).withColumnRenamed("rms", "_out")
    gain = F.when(
        F.col("_out") > 0, F.pow(F.coalesce("_src", F.lit(0.0)) / F.col("_out"), F.lit(1.0 - rate))
    ).otherwise(F.lit(1.0))
    return out.join(src, ["signal_id", "frame_no"], "left").select("signal_id", "frame_no", gain.alias("gain"))
