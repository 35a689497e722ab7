"""Pitch, key and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import views as v
from registry.core import query, r6, sql_view, table
from songloom.functions import r6 as round6
from songloom.operators import pitch as p

MODEL_KEYS = {"m0.pth": -2, "m3.pth": 4}
DEFAULT_KEY = 1


def song_f0(spark, sf):
    return p.voiced_median(v.frames(spark, sf), v.sig_len(spark, sf))


def references(spark, sf):
    per_class = v.frames(spark, sf).select(F.pmod("signal_id", F.lit(5)).alias("signal_id"), "hz")
    return p.voiced_median(per_class).select(F.col("signal_id").alias("reference_id"), "median_hz")


def auto_keys(spark, sf, **options):
    songs = song_f0(spark, sf).withColumn("reference_id", F.pmod("signal_id", F.lit(5)))
    return p.auto_key(songs, references(spark, sf), **options)


def key_requests(spark, sf):
    users = v.events(spark, sf).select(F.col("user_id").alias("signal_id")).distinct()
    return users.select(
        "signal_id", F.explode(F.array(F.lit("cover"), F.lit("speech"))).alias("kind"),
        F.concat(F.lit(" m"), F.pmod("signal_id", F.lit(7)), F.lit(".pth")).alias("model"),
        F.when(F.pmod("signal_id", F.lit(5)) == 4, "  ").otherwise("ref.wav").alias("sample_audio"),
    )


def keys(spark, sf):
    return p.key_priority(key_requests(spark, sf), auto_keys(spark, sf), MODEL_KEYS, DEFAULT_KEY)


sql_view("auto_keys", """SELECT s.signal_id,
  CASE WHEN r.median_hz > 0 AND s.median_hz > 0 THEN
    CAST(greatest(-5, least(5, round_even(12 * log2(r.median_hz / s.median_hz), 0))) AS INTEGER) END AS n_semitones,
  CASE WHEN r.median_hz IS NULL THEN 'no_reference' WHEN s.median_hz <= 0 THEN 'song_unvoiced'
    WHEN r.median_hz <= 0 THEN 'reference_unvoiced' ELSE 'ok' END AS reason
  FROM song_f0 s LEFT JOIN ref_profile r ON r.reference_id = s.signal_id % 5""", ("song_f0", "ref_profile"))
sql_view("keyed", """SELECT signal_id, kind,
  CAST(CASE WHEN signal_id % 7 = 0 THEN -2 WHEN signal_id % 7 = 3 THEN 4
       WHEN kind = 'cover' AND signal_id % 5 <> 4 AND n_semitones IS NOT NULL THEN n_semitones ELSE 1 END AS INTEGER) AS n_semitones,
  CASE WHEN signal_id % 7 IN (0, 3) THEN 'manual'
       WHEN kind = 'cover' AND signal_id % 5 <> 4 AND n_semitones IS NOT NULL THEN 'auto' ELSE 'default' END AS source
  FROM auto_keys CROSS JOIN (VALUES ('cover'), ('speech')) k(kind)""", ("auto_keys",))


sql_view("emb", "SELECT vec_id, label, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
sql_view("cents", "SELECT label, i, avg(x) AS m FROM emb GROUP BY label, i", ("emb",))


@query("voiced_median", f"SELECT signal_id, voiced, {r6('median_hz')} AS median_hz FROM song_f0", ("song_f0",))
def voiced_median(spark, sf):
    return song_f0(spark, sf).withColumn("median_hz", round6(F.col("median_hz")))


@query("auto_key", "SELECT signal_id, n_semitones, reason FROM auto_keys", ("auto_keys",))
def auto_key(spark, sf):
    return auto_keys(spark, sf)


@query("auto_key_offset", """SELECT s.signal_id,
  CASE WHEN r.median_hz > 0 AND s.median_hz > 0 THEN
    CAST(greatest(-3, least(3, round_even(12 * log2(r.median_hz / s.median_hz), 0) + 2)) AS INTEGER) END AS n_semitones,
  CASE WHEN s.median_hz <= 0 THEN 'song_unvoiced' WHEN r.median_hz <= 0 THEN 'reference_unvoiced' ELSE 'ok' END AS reason
  FROM song_f0 s LEFT JOIN ref_profile r ON r.reference_id = s.signal_id % 5""", ("song_f0", "ref_profile"))
def auto_key_offset(spark, sf):
    return auto_keys(spark, sf, offset=2, limit=3)


@query("key_priority", "SELECT signal_id, kind, n_semitones, source FROM keyed", ("keyed",))
def key_priority(spark, sf):
    return keys(spark, sf)


@query("transpose_pitch", f"""SELECT f.signal_id, f.frame_no, {r6("CASE WHEN hz > 0 THEN hz * pow(2e0, n_semitones / 12e0) ELSE 0e0 END")} AS hz
FROM f0v f JOIN keyed k ON k.signal_id = f.signal_id AND k.kind = 'cover'""", ("f0v", "keyed"))
def transpose_pitch(spark, sf):
    covers = keys(spark, sf).where(F.col("kind") == "cover")
    return p.transpose_pitch(v.f0v(spark, sf), covers).withColumn("hz", round6(F.col("hz")))


@query("profile_incremental", f"""SELECT 'user_' || signal_id || '.wav' AS path, mtime,
  CASE WHEN signal_id % 4 IN (0, 2) THEN top_hz WHEN voiced >= 50 THEN {r6('med')} END AS median_hz,
  signal_id % 4 NOT IN (0, 2) AS recomputed
FROM (SELECT user_id AS signal_id, max(t) AS mtime FROM ev GROUP BY user_id)
JOIN (SELECT signal_id, {r6('max(hz)')} AS top_hz, count(*) FILTER (WHERE hz > 0) AS voiced, median(hz) FILTER (WHERE hz > 0) AS med
  FROM f0v GROUP BY signal_id) USING (signal_id)""", ("ev", "f0v"))
def profile_incremental(spark, sf):
    path = F.concat(F.lit("user_"), F.col("signal_id"), F.lit(".wav"))
    frames = v.frames(spark, sf).select("signal_id", path.alias("path"), "hz")
    current = v.events(spark, sf).groupBy(F.col("user_id").alias("signal_id")).agg(F.max("t").alias("mtime")).select(
        "signal_id", path.alias("path"), "mtime")
    # what an earlier run left: unchanged for even users, newer or older than now for odd ones
    drift = F.when(F.pmod("signal_id", F.lit(4)) == 1, 1).when(F.pmod("signal_id", F.lit(4)) == 3, -1).otherwise(0)
    stale = frames.groupBy("path").agg(F.max("hz").alias("median_hz"))
    history = current.withColumn("mtime", F.col("mtime") + drift).join(stale, "path").select("path", "mtime", "median_hz")
    return p.profile_incremental(current, history, frames).withColumn("median_hz", round6(F.col("median_hz")))


@query("f0_median_filter", f"""SELECT signal_id, frame_no, {r6("CASE len(w) % 2 WHEN 1 THEN w[len(w) // 2 + 1] ELSE (w[len(w) // 2] + w[len(w) // 2 + 1]) / 2 END")} AS hz
FROM (SELECT signal_id, frame_no, list_sort(list(hz) OVER (PARTITION BY signal_id ORDER BY frame_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS w FROM f0v)""", ("f0v",))
def f0_median_filter(spark, sf):
    return p.f0_median_filter(v.f0v(spark, sf), block=32).withColumn("hz", round6(F.col("hz")))


@query("retrieval_blend", f"""SELECT vec_id, pos, {r6("any_value(x) * 5e-1 + avg(m) * 5e-1")} AS value FROM (
  SELECT e.vec_id, e.i AS pos, e.x, c.m FROM emb e
  JOIN (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS r FROM (
    SELECT e.vec_id, c.label, sum((e.x - c.m) * (e.x - c.m)) AS d FROM emb e JOIN cents c ON c.i = e.i GROUP BY ALL)) n
    ON n.vec_id = e.vec_id AND n.r <= 2
  JOIN cents c ON c.label = n.label AND c.i = e.i) GROUP BY vec_id, pos""", ("emb", "cents"))
def retrieval_blend(spark, sf):
    emb = table(spark, sf, "embeddings")
    return p.retrieval_blend(emb, p.centroid_index(emb), k=2, tile=4).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), round6(F.col("value")).alias("value"))
