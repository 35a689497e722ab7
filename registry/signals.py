"""Signal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import views as v
from registry.core import query, r6
from songloom.functions import r6 as round6
from songloom.operators import signals as s

OUTER, MARGIN, FRAME, TRIM = 100, 30, 64, 8
PCM = "CAST(round_even(greatest(-1e0, least(1e0, {x})) * 32767e0 * 99e-2, 0) AS SMALLINT)"


def _long(blocks, *keep, out="value", rounded=False):
    rows = s.long_form(blocks, "samples", out, *keep)
    return rows.withColumn(out, round6(F.col(out))) if rounded else rows


@query("downmix_mono", f"SELECT signal_id, idx, {r6('avg(value)')} AS value FROM sig2 GROUP BY signal_id, idx", ("sig2",))
def downmix_mono(spark, sf):
    return _long(s.downmix_mono(v.sig2(spark, sf)), rounded=True)


@query("duplicate_mono", """SELECT signal_id, c.ch, idx, value FROM sig, (VALUES (0), (1)) c(ch)
UNION ALL SELECT signal_id + 1000000, ch, idx, value FROM sig2""", ("sig", "sig2"))
def duplicate_mono(spark, sf):
    stereo = v.sig2(spark, sf).withColumn("signal_id", F.col("signal_id") + 1000000)
    return _long(s.duplicate_mono(v.sig(spark, sf).unionByName(stereo)), "ch")


@query("pcm_to_float", "SELECT signal_id, ch, idx, value / 32768e0 AS value FROM sig_pcm", ("sig_pcm",))
def pcm_to_float(spark, sf):
    return _long(s.pcm_to_float(v.sig_pcm(spark, sf)), "ch")


@query("float_to_pcm16", f"SELECT signal_id, idx, {PCM.format(x='value * 25e-1')} AS value FROM sig", ("sig",))
def float_to_pcm16(spark, sf):
    return _long(s.float_to_pcm16(v.scaled(v.sig(spark, sf), 2.5)))


@query("peak_stats", f"SELECT signal_id, {r6('max(abs(value))')} AS peak FROM sig2 GROUP BY signal_id", ("sig2",))
def peak_stats(spark, sf):
    return s.peak_stats(v.sig2(spark, sf)).withColumn("peak", round6(F.col("peak")))


@query("peak_normalize", """SELECT signal_id, idx, CAST(CASE WHEN peak > 0 AND 89e-2 * 32767e0 / peak < 1
    THEN round_even(CAST(value AS DOUBLE) * (89e-2 * 32767e0 / peak), 0) ELSE value END AS SMALLINT) AS pcm
FROM (SELECT *, max(abs(CAST(value AS DOUBLE))) OVER (PARTITION BY signal_id) AS peak FROM sig_pcm)""", ("sig_pcm",))
def peak_normalize(spark, sf):
    return _long(s.peak_normalize(v.sig_pcm(spark, sf)), out="pcm")


def _bounds_sql(factor: str, source: str = "sig2") -> str:
    return f"""SELECT signal_id, greatest(0, a - 1) AS start_idx, least(n, b + 2) AS end_idx,
  least(n, b + 2) - greatest(0, a - 1) AS kept
FROM (SELECT signal_id, max(idx) + 1 AS n, min(idx) FILTER (WHERE abs(value) > peak * {factor}) AS a,
        max(idx) FILTER (WHERE abs(value) > peak * {factor}) AS b
      FROM (SELECT *, max(abs(value)) OVER (PARTITION BY signal_id) AS peak FROM {source}) GROUP BY signal_id)"""


@query("trim_silence", _bounds_sql("1e-2"), ("sig2",))
def trim_silence(spark, sf):
    return s.silence_bounds(v.sig2(spark, sf))


@query("trim_silence_half_peak", _bounds_sql("5e-1"), ("sig2",))
def trim_silence_half_peak(spark, sf):
    return s.silence_bounds(v.sig2(spark, sf), threshold_factor=0.5)


@query("trim_silence_samples", f"""SELECT x.signal_id, x.ch, x.idx - b.start_idx AS idx, x.value
FROM sig2 x JOIN ({_bounds_sql('5e-1')}) b ON x.signal_id = b.signal_id AND x.idx >= b.start_idx AND x.idx < b.end_idx""", ("sig2",))
def trim_silence_samples(spark, sf):
    return _long(s.trim_silence(v.sig2(spark, sf), threshold_factor=0.5), "ch")


@query("align_tracks", """SELECT a.signal_id, a.idx, coalesce(b.value, 0e0) AS value
FROM sig a LEFT JOIN track_b b ON a.signal_id = b.signal_id AND a.idx = b.idx""", ("sig", "track_b"))
def align_tracks(spark, sf):
    return _long(s.align_tracks(v.sig(spark, sf), v.track_b(spark, sf)))


@query("mix_tracks", f"""SELECT signal_id, idx, {PCM.format(x='CASE WHEN peak > 1 THEN m * (1e0 / peak) ELSE m END')} AS pcm
FROM (SELECT *, max(abs(m)) OVER (PARTITION BY signal_id) AS peak
  FROM (SELECT a.signal_id, a.idx, a.value * 15e-1 + coalesce(b.value * 2e0, 0e0) * 85e-2 AS m
    FROM sig a LEFT JOIN track_b b ON a.signal_id = b.signal_id AND a.idx = b.idx))""", ("sig", "track_b"))
def mix_tracks(spark, sf):
    mixed = s.mix_tracks(v.scaled(v.sig(spark, sf), 1.5), v.scaled(v.track_b(spark, sf), 2.0))
    return _long(mixed, out="pcm")


@query("residual_track", f"""SELECT signal_id, idx, {r6('part')} AS value,
  {r6('CASE WHEN peak > 1 THEN rest / peak * 99e-2 ELSE rest END')} AS residual
FROM (SELECT *, max(abs(rest)) OVER (PARTITION BY signal_id) AS peak FROM (
  SELECT signal_id, idx, part, whole - part AS rest FROM (
    SELECT a.signal_id, a.idx, a.value * 3e0 AS whole, greatest(-1e0, least(1e0, coalesce(b.value * 25e-1, 0e0) * 1035e-3)) AS part
    FROM sig a LEFT JOIN track_b b ON a.signal_id = b.signal_id AND a.idx = b.idx)))""", ("sig", "track_b"))
def residual_track(spark, sf):
    split = s.residual_track(v.scaled(v.sig(spark, sf), 3.0), v.scaled(v.track_b(spark, sf), 2.5))
    both = split.withColumn("samples", F.arrays_zip(F.col("samples").alias("value"), F.col("residual").alias("residual")))
    rows = s.long_form(both, "samples", "p")
    return rows.select("signal_id", "idx", round6(F.col("p.value")).alias("value"), round6(F.col("p.residual")).alias("residual"))


# chunk k > 0 exists where the previous one ends short of the signal; written as a scan over grid positions
CHUNKS_SQL = f"""chunk_grid AS (
  SELECT signal_id, n, g AS chunk_start, CASE WHEN g = 0 THEN 0 ELSE g - {MARGIN} END AS lo, least(g + {OUTER} + {MARGIN}, n) AS hi
  FROM (SELECT signal_id, n, unnest(range(0, n, {OUTER})) AS g FROM (SELECT signal_id, max(idx) + 1 AS n FROM sig GROUP BY signal_id))
  WHERE g = 0 OR g + {MARGIN} < n),
chunked AS (SELECT c.*, x.idx, x.value FROM chunk_grid c JOIN sig x ON x.signal_id = c.signal_id AND x.idx >= c.lo AND x.idx < c.hi)"""


def _with_chunks(sql: str) -> str:
    from registry.core import with_views

    return with_views("", ("sig",)).rstrip() + ",\n" + CHUNKS_SQL + "\n" + sql


def _chunks(spark, sf):
    return s.chunk_overlap(v.sig(spark, sf), OUTER, MARGIN)


@query("chunk_overlap", _with_chunks("SELECT signal_id, chunk_start, idx, value FROM chunked"))
def chunk_overlap(spark, sf):
    return _long(_chunks(spark, sf), "chunk_start")


@query("stitch_chunks", "SELECT signal_id, idx, value FROM sig", ("sig",))
def stitch_chunks(spark, sf):
    return _long(s.stitch_chunks(_chunks(spark, sf)))


@query("stitch_chunks_wide_margin", "SELECT signal_id, idx, value FROM sig", ("sig",))
def stitch_chunks_wide_margin(spark, sf):
    """The margin asked for is wider than a chunk."""
    return _long(s.stitch_chunks(s.chunk_overlap(v.sig(spark, sf), 40, 90)))


@query("reblock", "SELECT signal_id, idx // 37 AS block_no, count(*) AS n, min(idx) AS start_idx, " + r6("sum(value)") + " AS total FROM sig GROUP BY ALL", ("sig",))
def reblock(spark, sf):
    """Chunks put together again have irregular blocks."""
    even = s.reblock(s.stitch_chunks(_chunks(spark, sf)), 37)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return even.select("signal_id", "block_no", F.size("samples").cast("bigint").alias("n"), "start_idx", round6(total).alias("total"))


@query("residual_of_stitched", f"""SELECT signal_id, idx, {r6('whole - part')} AS residual FROM (
  SELECT a.signal_id, a.idx, a.value AS whole, greatest(-1e0, least(1e0, coalesce(b.value, 0e0) * 1035e-3)) AS part
  FROM sig a LEFT JOIN track_b b ON a.signal_id = b.signal_id AND a.idx = b.idx)""", ("sig", "track_b"))
def residual_of_stitched(spark, sf):
    """Chunked and put together again, then paired with a track in other blocks."""
    split = s.residual_track(s.stitch_chunks(_chunks(spark, sf)), v.track_b(spark, sf))
    return _long(split.withColumn("samples", F.col("residual")), out="residual", rounded=True)


@query("align_trimmed", f"""SELECT a.signal_id, a.idx, coalesce(t.value, 0e0) AS value FROM sig a LEFT JOIN (
  SELECT x.signal_id, x.idx - b.start_idx AS idx, x.value FROM sig x
  JOIN ({_bounds_sql('5e-1', 'sig')}) b ON x.signal_id = b.signal_id AND x.idx >= b.start_idx AND x.idx < b.end_idx) t
  ON t.signal_id = a.signal_id AND t.idx = a.idx""", ("sig",))
def align_trimmed(spark, sf):
    """A trimmed track starts anew in the middle of its first block."""
    return _long(s.align_tracks(v.sig(spark, sf), s.trim_silence(v.sig(spark, sf), threshold_factor=0.5)))


_MIXED = """SELECT signal_id, idx, {pcm} AS pcm
FROM (SELECT *, max(abs(m)) OVER (PARTITION BY signal_id) AS peak FROM ({sums}))"""
_SCALED = PCM.format(x="CASE WHEN peak > 1 THEN m * (1e0 / peak) ELSE m END")
_SLOWER = """(SELECT g.signal_id, g.j AS idx, l.value + (coalesce(r.value, l.value) - l.value) * ((g.j * 48) % 20 / 20e0) AS value
  FROM (SELECT signal_id, unnest(range(0, CAST(ceil(n * 20 / 48e0) AS BIGINT))) AS j FROM (SELECT signal_id, max(idx) + 1 AS n FROM track_b GROUP BY signal_id)) g
  JOIN track_b l ON l.signal_id = g.signal_id AND l.idx = (g.j * 48) // 20
  LEFT JOIN track_b r ON r.signal_id = g.signal_id AND r.idx = (g.j * 48) // 20 + 1)"""


@query("mix_tracks_rates", _MIXED.format(pcm=_SCALED, sums=f"""SELECT a.signal_id, a.idx, a.value + coalesce(b.value, 0e0) * 85e-2 AS m
  FROM sig a LEFT JOIN {_SLOWER} b ON a.signal_id = b.signal_id AND a.idx = b.idx"""), ("sig", "track_b"))
def mix_tracks_rates(spark, sf):
    """The second track has another sample rate."""
    return _long(s.mix_tracks(v.sig(spark, sf), v.track_b(spark, sf).withColumn("sr", F.lit(48))), out="pcm")


@query("mix_tracks_stereo", _MIXED.format(pcm=_SCALED, sums="""SELECT a.signal_id, a.idx, a.value + coalesce(b.value, 0e0) * 85e-2 AS m
  FROM (SELECT signal_id, idx, sum(value) / 2 AS value FROM sig2 GROUP BY ALL) a
  LEFT JOIN track_b b ON a.signal_id = b.signal_id AND a.idx = b.idx"""), ("sig2", "track_b"))
def mix_tracks_stereo(spark, sf):
    """The first track has two channels."""
    return _long(s.mix_tracks(v.sig2(spark, sf), v.track_b(spark, sf)), out="pcm")


HOP = FRAME - 2 * TRIM
FRAMES_SQL = f"""frame_grid AS (SELECT signal_id, chunk_start, lo, hi, unnest(range(0, CAST(ceil((hi - lo) / {HOP}e0) AS BIGINT))) AS frame_no FROM chunk_grid),
framed AS (SELECT f.signal_id, f.chunk_start, f.frame_no, p.p AS idx, coalesce(c.value, 0e0) AS value
  FROM frame_grid f CROSS JOIN range({FRAME}) p(p)
  LEFT JOIN chunked c ON c.signal_id = f.signal_id AND c.chunk_start = f.chunk_start
    AND c.idx = f.lo + f.frame_no * {HOP} + p.p - {TRIM})"""


def _with_frames(sql: str) -> str:
    return _with_chunks("").rstrip() + ",\n" + FRAMES_SQL + "\n" + sql


def _frames(spark, sf):
    return s.frame_signal(_chunks(spark, sf), FRAME, TRIM)


@query("frame_signal", _with_frames("SELECT signal_id, chunk_start, frame_no, idx, value FROM framed"))
def frame_signal(spark, sf):
    return _frames(spark, sf).select("signal_id", "chunk_start", "frame_no", F.posexplode("samples").alias("_i", "value")).select(
        "signal_id", "chunk_start", "frame_no", F.col("_i").cast("bigint").alias("idx"), "value"
    )


@query("spectrum_frames", _with_frames(f"""SELECT signal_id, chunk_start, frame_no, b.b AS bin,
  {r6(f"sqrt(pow(sum(value * cos(2e0 * pi() * b.b * idx / {FRAME})), 2) + pow(sum(value * sin(2e0 * pi() * b.b * idx / {FRAME})), 2))")} AS magnitude
FROM framed CROSS JOIN range({FRAME // 2 + 1}) b(b) GROUP BY ALL"""))
def spectrum_frames(spark, sf):
    bins = s.spectrum_frames(_frames(spark, sf))
    return bins.select("signal_id", "chunk_start", "frame_no", F.posexplode("magnitude").alias("_b", "_m")).select(
        "signal_id", "chunk_start", "frame_no", F.col("_b").cast("bigint").alias("bin"), round6(F.col("_m")).alias("magnitude")
    )


@query("resample_linear", f"""SELECT g.signal_id, g.j AS out_idx, {r6("l.value + (coalesce(r.value, l.value) - l.value) * ((g.j * 20) % 48 / 48e0)")} AS value
FROM (SELECT signal_id, unnest(range(0, CAST(ceil(n * 48 / 20e0) AS BIGINT))) AS j FROM (SELECT signal_id, max(idx) + 1 AS n FROM sig GROUP BY signal_id)) g
JOIN sig l ON l.signal_id = g.signal_id AND l.idx = (g.j * 20) // 48
LEFT JOIN sig r ON r.signal_id = g.signal_id AND r.idx = (g.j * 20) // 48 + 1""", ("sig",))
def resample_linear(spark, sf):
    rows = _long(s.resample_linear(v.sig(spark, sf), 48), rounded=True)
    return rows.withColumnRenamed("idx", "out_idx")


def _rms(src: str, factor: str) -> str:
    return f"SELECT signal_id, idx // 48 AS frame_no, sqrt(avg(value * {factor} * value * {factor})) AS rms FROM {src} GROUP BY ALL"


@query("rms_envelope_mix", f"""SELECT o.signal_id, o.frame_no, {r6("CASE WHEN o.rms > 0 THEN pow(coalesce(i.rms, 0) / o.rms, 75e-2) ELSE 1e0 END")} AS gain
FROM ({_rms('track_b', '2e0')}) o LEFT JOIN ({_rms('sig', '1e0')}) i ON o.signal_id = i.signal_id AND o.frame_no = i.frame_no""", ("sig", "track_b"))
def rms_envelope_mix(spark, sf):
    gains = s.rms_envelope_mix(v.sig(spark, sf), v.scaled(v.track_b(spark, sf), 2.0), 48)
    return gains.withColumn("gain", round6(F.col("gain")))
