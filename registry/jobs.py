"""Audio files and the whole cover job."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import pitch, views as v
from registry.core import query, sql_view, table
from registry.signals import PCM
from songloom.operators import signals as s
from songloom.plans.resolve import resolve_requests
from songloom.plans.cover import cover_report, two_stem_job as cover_job
from songloom.session import fresh_path, materialized
from songloom.sources import audio


def _pcm_signals(spark, sf):
    return s.float_to_pcm16(v.sig2(spark, sf)).withColumn("signal_id", F.concat(F.lit("s"), "signal_id"))


@query("audio_export", """SELECT 's' || signal_id AS signal_id, 0 AS part, 20 AS sr, count(*) // 2 AS n_samples, 44 + 2 * count(*) AS n_bytes FROM sig2 GROUP BY signal_id""", ("sig2",))
def audio_export(spark, sf):
    return audio.audio_export(_pcm_signals(spark, sf))


@query("audio_export_parts", """SELECT signal_id || c AS signal_id, idx // 64 // 2 AS part, 20 AS sr, count(*) // 4 AS n_samples, 44 + 2 * count(*) AS n_bytes
FROM sig2 CROSS JOIN (VALUES ('', 1), ('-2', 1), ('', 2), ('-2', 2)) x(c, k) GROUP BY 1, 2 HAVING count(*) > 0""", ("sig2",))
def audio_export_parts(spark, sf):
    """Four channels, parts of two blocks, and ids that look like those of a second part."""
    pcm = s.float_to_pcm16(v.sig2(spark, sf))
    four = pcm.withColumn("ch", F.explode(F.array(F.col("ch"), F.col("ch") + 2)))
    named = four.withColumn("signal_id", F.explode(F.array(F.col("signal_id").cast("string"), F.concat("signal_id", F.lit("-2")))))
    return audio.encode_wav(named, max_samples=4 * 128).drop("wav")


@query("audio_scan", f"""SELECT 's' || signal_id AS signal_id, ch, idx, 20 AS sr, {PCM.format(x='value')} AS value FROM sig2""", ("sig2",))
def audio_scan(spark, sf):
    """Write all signals as files, then read the folder back in blocks of 100 samples."""
    folder = fresh_path(spark, "wav")
    audio.write_wav_files(audio.encode_wav(_pcm_signals(spark, sf)), folder)
    return s.long_form(audio.audio_scan(spark, folder, block=100), "samples", "value", "ch", "sr").select(
        "signal_id", "ch", "idx", "sr", "value")


def recordings(spark, sf):
    """Songs over full scale with a quiet first block."""
    level = F.when(F.col("block_no") == 0, 0.003).otherwise(3.0)
    return v.sig(spark, sf).withColumn("samples", F.transform("samples", lambda x: x * level))


def separate(blocks):
    """Stand-in for a separation model."""
    return blocks.withColumn("samples", F.transform("samples", lambda x: x * 0.8))


def convert(blocks, keys):
    """Stand-in for a conversion model: louder with the key, 16-bit result."""
    gain = F.pow(F.lit(2.0), F.col("n_semitones") / F.lit(12.0))
    return blocks.join(keys, "signal_id").withColumn(
        "samples", F.transform("samples", lambda x: s.pcm16_value(x * gain))).drop("n_semitones")


def cover_requests(spark, sf):
    k = lambda n: F.pmod("signal_id", F.lit(n))
    return v.sig(spark, sf).select("signal_id").distinct().select(
        "signal_id", F.lit("cover").alias("kind"), F.concat(F.lit("m"), k(7), F.lit(".pth")).alias("model"),
        F.when(k(5) == 4, "").otherwise("ref.wav").alias("sample_audio"), k(5).alias("reference_id"),
        (k(2) == 0).alias("with_instrumental"), (k(3) != 0).alias("trim"),
    )


sql_view("cover_keys", """SELECT x.signal_id, x.signal_id % 2 = 0 AS band, x.signal_id % 3 <> 0 AS trim,
  CAST(CASE WHEN x.signal_id % 7 = 0 THEN -2 WHEN x.signal_id % 7 = 3 THEN 4
       WHEN x.signal_id % 5 <> 4 AND n_semitones IS NOT NULL THEN n_semitones ELSE 1 END AS INTEGER) AS n,
  CASE WHEN x.signal_id % 7 IN (0, 3) THEN 'manual' WHEN x.signal_id % 5 <> 4 AND n_semitones IS NOT NULL THEN 'auto' ELSE 'default' END AS source
  FROM (SELECT DISTINCT signal_id FROM sig) x LEFT JOIN auto_keys a USING (signal_id)""", ("sig", "auto_keys"))
sql_view("stems", """SELECT signal_id, idx, part, CASE WHEN peak > 1 THEN rest / peak * 99e-2 ELSE rest END AS rest FROM (
  SELECT *, max(abs(rest)) OVER (PARTITION BY signal_id) AS peak FROM (
    SELECT signal_id, idx, greatest(-1e0, least(1e0, whole * 8e-1 * 1035e-3)) AS part, whole - greatest(-1e0, least(1e0, whole * 8e-1 * 1035e-3)) AS rest
    FROM (SELECT *, value * CASE WHEN idx < 64 THEN 3e-3 ELSE 3e0 END AS whole FROM sig)))""", ("sig",))
sql_view("sung", f"""SELECT signal_id, idx, band, rest, CASE WHEN top > 0 AND 89e-2 * 32767e0 / top < 1
    THEN round_even(pcm * (89e-2 * 32767e0 / top), 0) ELSE pcm END AS pcm FROM (
  SELECT *, max(abs(pcm)) OVER (PARTITION BY signal_id) AS top FROM (
    SELECT signal_id, idx, band, rest, CAST({PCM.format(x='part * pow(2e0, n / 12e0)')} AS DOUBLE) AS pcm FROM (
      SELECT *, min(CASE WHEN abs(part) > peak * 1e-2 THEN idx END) OVER w AS a, max(CASE WHEN abs(part) > peak * 1e-2 THEN idx END) OVER w AS b
      FROM (SELECT s.*, k.n, k.band, k.trim, max(abs(part)) OVER (PARTITION BY s.signal_id) AS peak FROM stems s JOIN cover_keys k USING (signal_id))
      WINDOW w AS (PARTITION BY signal_id))
    WHERE band OR NOT trim OR peak <= 0 OR (idx >= a - 1 AND idx <= b + 1)))""", ("stems", "cover_keys"))
sql_view("produced", f"""SELECT signal_id, idx, CAST(CASE WHEN NOT band THEN pcm
    ELSE {PCM.format(x='CASE WHEN peak > 1 THEN m * (1e0 / peak) ELSE m END')} END AS INTEGER) AS pcm FROM (
  SELECT *, max(abs(m)) OVER (PARTITION BY signal_id) AS peak FROM (SELECT *, pcm / 32768e0 + rest * 85e-2 AS m FROM sung))""", ("sung",))


def _job(spark, sf):
    return cover_job(
        recordings(spark, sf), cover_requests(spark, sf), v.frames(spark, sf), pitch.references(spark, sf),
        separate, convert, model_keys=pitch.MODEL_KEYS, default_key=pitch.DEFAULT_KEY, lengths=v.sig_len(spark, sf),
    )


@query("two_stem_job", """SELECT k.signal_id, k.n AS n_semitones, k.source, count(*) AS n_out, max(abs(p.pcm)) AS peak_pcm
FROM cover_keys k JOIN produced p ON p.signal_id = k.signal_id GROUP BY ALL""", ("cover_keys", "produced"))
def two_stem_job(spark, sf):
    return cover_report(_job(spark, sf))


@query("two_stem_job_audio", """SELECT signal_id, idx - min(idx) OVER (PARTITION BY signal_id) AS idx, CAST(pcm AS SMALLINT) AS pcm FROM produced""", ("produced",))
def two_stem_job_audio(spark, sf):
    return s.long_form(_job(spark, sf)["audio"], "samples", "pcm")


def _many(spark, sf):
    """Each song is asked for one to four times; requests are numbered by song and turn."""
    base = cover_requests(spark, sf)
    turns = F.explode(F.sequence(F.lit(0), F.pmod("signal_id", F.lit(4)).cast("int")))
    return base.withColumn("turn", turns).withColumn("request_id", F.col("signal_id") * 10 + F.col("turn")).withColumn(
        "model", F.when(F.col("turn") > 0, F.lit("m3.pth")).otherwise(F.col("model"))
    ).drop("turn")


@query("two_stem_job_many_requests", """SELECT k.signal_id * 10 + t.turn AS signal_id,
  CASE WHEN t.turn > 0 THEN 4 ELSE k.n END AS n_semitones, CASE WHEN t.turn > 0 THEN 'manual' ELSE k.source END AS source, count(*) AS n_out
FROM cover_keys k JOIN produced p ON p.signal_id = k.signal_id JOIN (VALUES (0), (1), (2), (3)) t(turn) ON t.turn <= k.signal_id % 4
GROUP BY ALL""", ("cover_keys", "produced"))
def two_stem_job_many_requests(spark, sf):
    job = cover_job(
        recordings(spark, sf), _many(spark, sf), v.frames(spark, sf), pitch.references(spark, sf),
        separate, convert, model_keys=pitch.MODEL_KEYS, default_key=pitch.DEFAULT_KEY, lengths=v.sig_len(spark, sf),
    )
    return cover_report(job).drop("peak_pcm")


@query("two_stem_job_stereo", """SELECT k.signal_id, k.n AS n_semitones, k.source, count(*) * CASE WHEN k.band THEN 1 ELSE 2 END AS n_out, max(abs(p.pcm)) AS peak_pcm
FROM cover_keys k JOIN produced p ON p.signal_id = k.signal_id GROUP BY k.signal_id, k.n, k.source, k.band""", ("cover_keys", "produced"))
def two_stem_job_stereo(spark, sf):
    """Two equal channels: the mix with the band has one again."""
    job = cover_job(
        s.duplicate_mono(recordings(spark, sf)), cover_requests(spark, sf), v.frames(spark, sf), pitch.references(spark, sf),
        separate, convert, model_keys=pitch.MODEL_KEYS, default_key=pitch.DEFAULT_KEY, lengths=v.sig_len(spark, sf),
    )
    return cover_report(job)


def chat(spark, sf):
    """Each user keeps asking for the part of their number; some messages are other commands or none."""
    asked = v.events(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("user_id") == F.col("p_partkey"), "left")
    name = F.coalesce("p_name", F.lit("nothing-like-it"))
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", "hello").when(kind == "signup", "/翻唱 ").when((kind == "view") & (F.pmod("user_id", F.lit(2)) == 0), "/音色列表")
        .otherwise(F.concat(F.lit("/翻唱 -v L.pth "), name))
    )
    spelled = F.get(F.array(F.lit(" QQ"), F.lit(None), F.lit("NetEase")), F.pmod("user_id", F.lit(3)).cast("int"))
    return asked.select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("stream"), text.alias("text"), "t",
        F.rint(F.col("value") * 20e6).cast("bigint").alias("dur"), (kind != "purchase").alias("ok"), spelled.alias("platform"),
    )


def song_answers(songs):
    """What providers say about songs: files by quality for one, three sources for the other, often nothing."""
    number = F.regexp_extract("song_id", "([0-9]+)", 1).cast("int")
    k, own = F.pmod(number, F.lit(4)), F.coalesce(F.nullif(F.col("media_id"), F.lit("")), F.col("song_id"))
    file = lambda name, purl: F.struct(name.alias("filename"), purl.alias("purl"))
    return songs.select(
        "platform", "song_id", "media_id",
        F.array(
            file(F.concat(F.lit("C400"), own, F.lit(".m4a")), F.when(k > 0, F.concat("song_id", F.lit(".m4a"))).otherwise("")),
            file(F.concat(F.lit("M800"), own, F.lit(".mp3")), F.when(k == 2, F.concat(F.lit("https://h.example/"), "song_id")).otherwise(" ")),
        ).alias("files"),
        F.array(F.lit("http://s.example/")).alias("servers"), F.when(k == 1, F.concat(F.lit("http://one.example/"), "song_id")).otherwise("").alias("url_1"),
        F.when(k == 2, F.concat(F.lit("http://two.example/"), "song_id")).alias("url_2"),
        F.concat(F.lit("http://three.example/"), "song_id", F.when(k == 3, ".mp3").otherwise(".html")).alias("url_3"),
    )


sql_view("chat", """SELECT event_id AS id, user_id AS stream, t, event_type <> 'purchase' AS ok, coalesce(p_name, 'nothing-like-it') AS query,
  CASE WHEN user_id % 3 = 0 THEN 'qq' ELSE '163' END AS platform,
  t + CAST(round_even(value * 20e6, 0) AS BIGINT) + CASE WHEN event_type <> 'purchase' THEN 600000000 ELSE 0 END AS expiry,
  CASE WHEN event_type = 'error' THEN 'no command' WHEN event_type = 'signup' THEN 'no query' WHEN event_type = 'view' AND user_id % 2 = 0 THEN 'other command' END AS why
  FROM ev LEFT JOIN part ON p_partkey = user_id""", ("ev",))
sql_view("chat_runs", """SELECT *, row_number() OVER (PARTITION BY stream ORDER BY t, id) AS rn FROM chat WHERE why IS NULL""", ("chat",))
sql_view("chat_led", """SELECT stream, rn, id, id AS leader_id, expiry, false AS reused FROM chat_runs WHERE rn = 1
  UNION ALL SELECT r.stream, r.rn, r.id, CASE WHEN r.t < p.expiry THEN p.leader_id ELSE r.id END,
    CASE WHEN r.t < p.expiry THEN p.expiry ELSE r.expiry END, r.t < p.expiry
  FROM chat_led p JOIN chat_runs r ON r.stream = p.stream AND r.rn = p.rn + 1""", ("chat_runs",))
sql_view("chat_hits", """SELECT platform, query, arg_min(song_id, (-n, song_id)) AS song_id FROM (
    SELECT q.platform, q.query, s.song_id, count(DISTINCT q.w) AS n
    FROM (SELECT platform, query, unnest(string_split(lower(query), ' ')) AS w FROM (SELECT DISTINCT platform, query FROM chat WHERE why IS NULL)) q
    JOIN (SELECT platform, song_id, unnest(string_split(lower(name), ' ')) AS w FROM songs) s USING (platform, w) GROUP BY ALL)
  GROUP BY platform, query""", ("chat", "songs"))
sql_view("chat_urls", """SELECT platform, song_id, CASE WHEN artists = '' THEN name ELSE name || ' - ' || artists END AS title,
  CASE WHEN platform = 'qq' THEN CASE k WHEN 0 THEN NULL WHEN 2 THEN 'https://h.example/' || song_id ELSE 'http://s.example/' || song_id || '.m4a' END
  ELSE CASE k WHEN 1 THEN 'http://one.example/' || song_id WHEN 2 THEN 'http://two.example/' || song_id WHEN 3 THEN 'http://three.example/' || song_id || '.mp3' END END AS url
  FROM (SELECT *, CAST(regexp_extract(song_id, '([0-9]+)', 1) AS INTEGER) % 4 AS k FROM songs)""", ("songs",))


@query("request_pipeline", """SELECT m.id AS request_id,
  CASE WHEN m.why = 'no query' THEN 'rejected' WHEN m.why IS NOT NULL THEN 'ignored' WHEN l.reused THEN 'reused'
    WHEN u.url IS NULL THEN 'failed' ELSE 'resolved' END AS outcome,
  coalesce(m.why, CASE WHEN h.song_id IS NULL THEN 'no song found' WHEN u.url IS NULL THEN 'no playable audio' END) AS reason,
  l.leader_id, h.song_id, CASE WHEN h.song_id IS NOT NULL THEN m.platform END AS platform, u.title, u.url
FROM chat m LEFT JOIN chat_led l ON l.id = m.id
LEFT JOIN chat_hits h ON l.leader_id IS NOT NULL AND h.platform = m.platform AND h.query = m.query
LEFT JOIN chat_urls u ON u.platform = h.platform AND u.song_id = h.song_id""", ("chat", "chat_led", "chat_hits", "chat_urls"))
def request_pipeline(spark, sf):
    # the search of each platform, the titles and the answers read the catalog
    songs = materialized(v.songs(spark, sf), "catalog")
    return resolve_requests(chat(spark, sf), songs, song_answers(songs))
