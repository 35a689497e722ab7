"""Views over the given tables that carry the shapes the operators read.

Each view exists twice: as a DataFrame here and as SQL for the check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from registry.core import sql_view, table
from songloom.functions.ordering import numbered_within
from songloom.operators.catalog import catalog_union
from songloom.sources.payloads import good_payloads, songs_from_json_163, songs_from_json_qq

DAY_US = 86_400_000_000


# ---- signals: eight (or six) vectors in a row make one signal of several blocks

def _blocks(spark: SparkSession, sf: str, per: int) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    return emb.select(
        F.expr(f"vec_id div {per}").alias("signal_id"), F.lit(0).alias("ch"),
        F.pmod("vec_id", F.lit(per)).alias("block_no"), (F.pmod("vec_id", F.lit(per)) * 64).alias("start_idx"),
        F.lit(20).alias("sr"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"),
    )


def scaled(blocks: DataFrame, factor: float) -> DataFrame:
    return blocks.withColumn("samples", F.transform("samples", lambda x: x * factor))


def sig(spark, sf) -> DataFrame:
    return _blocks(spark, sf, 8)


def track_b(spark, sf) -> DataFrame:
    return _blocks(spark, sf, 6)


def sig2(spark, sf) -> DataFrame:
    first = sig(spark, sf)
    second = first.withColumn("ch", F.lit(1)).withColumn(
        "samples", F.transform(F.reverse("samples"), lambda x: x * 0.5)
    )
    return first.unionByName(second)


def sig_pcm(spark, sf) -> DataFrame:
    loud = F.lit(0.5) + F.lit(0.9) * F.pmod("signal_id", F.lit(3))
    pcm = lambda x: F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.rint(x * 32767.0 * loud))).cast("smallint")
    return sig(spark, sf).withColumn("samples", F.transform("samples", pcm))


_EMB = "(SELECT vec_id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
sql_view("sig", f"SELECT vec_id // 8 AS signal_id, 0 AS ch, (vec_id % 8) * 64 + i AS idx, x AS value FROM {_EMB}")
sql_view("track_b", f"SELECT vec_id // 6 AS signal_id, 0 AS ch, (vec_id % 6) * 64 + i AS idx, x AS value FROM {_EMB}")
sql_view("sig2", f"""SELECT * FROM sig UNION ALL
SELECT vec_id // 8, 1, (vec_id % 8) * 64 + 63 - i, x * 5e-1 FROM {_EMB}""", ("sig",))
sql_view("sig_pcm", """SELECT signal_id, ch, idx, CAST(greatest(-32768e0, least(32767e0,
  round_even(value * 32767e0 * (5e-1 + 9e-1 * (signal_id % 3)), 0))) AS SMALLINT) AS value FROM sig""", ("sig",))


# ---- events as pitch tracks, requests, attempts, files, polls, sections

def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))


def frames(spark, sf) -> DataFrame:
    """Pitch frames without their numbers, for statistics that need no order."""
    return events(spark, sf).select(
        F.col("user_id").alias("signal_id"), "t", "event_id",
        F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value") * 10).alias("hz"),
    )


def f0v(spark, sf) -> DataFrame:
    ev = frames(spark, sf)
    return numbered_within(ev, ["signal_id"], ["t", "event_id"], "frame_no").select(
        "signal_id", "frame_no", "hz"
    )


def sig_len(spark, sf) -> DataFrame:
    return events(spark, sf).groupBy(F.col("user_id").alias("signal_id")).agg(
        (F.count(F.lit(1)) * 1000).alias("sample_count")
    ).withColumn("sr", 16000 * (1 + F.pmod("signal_id", F.lit(12))))


sql_view("ev", "SELECT *, epoch_us(ts) AS t FROM events")
sql_view("f0v", """SELECT user_id AS signal_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS frame_no,
  CASE WHEN event_type = 'error' THEN 0e0 ELSE value * 10 END AS hz FROM ev""", ("ev",))
sql_view("sig_len", """SELECT user_id AS signal_id, count(*) * 1000 AS sample_count, 16000 * (1 + user_id % 12) AS sr
  FROM events GROUP BY user_id""")
sql_view("song_f0", """SELECT f.signal_id, count(*) FILTER (WHERE hz > 0) AS voiced,
  CASE WHEN any_value(sample_count) >= any_value(sr) // 2 AND count(*) FILTER (WHERE hz > 0) >= 50
    THEN median(hz) FILTER (WHERE hz > 0) ELSE 0e0 END AS median_hz
  FROM f0v f JOIN sig_len USING (signal_id) GROUP BY f.signal_id""", ("f0v", "sig_len"))
sql_view("ref_profile", """SELECT signal_id % 5 AS reference_id,
  CASE WHEN count(*) FILTER (WHERE hz > 0) >= 50 THEN median(hz) FILTER (WHERE hz > 0) ELSE 0e0 END AS median_hz
  FROM f0v GROUP BY 1""", ("f0v",))


def requests(spark, sf, stream: str = "user_id") -> DataFrame:
    return as_requests(events(spark, sf), "t", stream)


def as_requests(ev: DataFrame, time: str, stream: str = "user_id") -> DataFrame:
    spelled = F.when(F.pmod("event_id", F.lit(2)) == 0, "  SUNNY Day ").otherwise("sunny day")
    return ev.select(
        F.col("event_id").alias("request_id"), F.col(stream).alias("stream"), spelled.alias("query"),
        F.lit("m").alias("model"), F.lit(False).alias("flag"), time,
        F.rint(F.col("value") * 20e6).cast("bigint").alias("dur"), (F.col("event_type") != "error").alias("ok"),
    )


def _result() -> Column:
    return F.when(F.col("event_type") == "error", "raised").when(F.col("event_type") == "signup", "false").otherwise("true")


def sends(spark, sf) -> DataFrame:
    return events(spark, sf).select(F.col("event_id").alias("attempt_id"), F.col("t").alias("sent"))


def results(spark, sf) -> DataFrame:
    return as_results(events(spark, sf))


def as_results(ev: DataFrame) -> DataFrame:
    """What came back; sends with the largest values never return."""
    return ev.where(F.col("value") < 200).select(
        F.col("event_id").alias("attempt_id"),
        (F.col("t") + F.rint(F.col("value") * 20e6).cast("bigint")).alias("returned"), _result().alias("result"),
    )


sql_view("attempts", """SELECT event_id AS attempt_id,
  CASE WHEN value < 200 THEN CAST(round_even(value * 20e6, 0) AS BIGINT) END AS lat,
  CASE WHEN value >= 200 THEN NULL WHEN event_type = 'error' THEN 'raised' WHEN event_type = 'signup' THEN 'false' ELSE 'true' END AS result
  FROM events""")


def method_attempts(spark, sf) -> DataFrame:
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(i).alias("r")) for i, m in enumerate(("voiceurl", "record", "voice"), 1)])
    outcomes = F.array(F.lit("sent"), F.lit("failed"), F.lit("unknown"))
    return events(spark, sf).select(
        F.col("event_id").alias("message_id"), (F.col("value") * 60000).cast("bigint").alias("size"), F.explode(methods).alias("m"),
    ).select("message_id", "size", "m.method", F.get(outcomes, F.pmod(F.col("message_id") * 7 + F.col("m.r") * F.expr("message_id div 3"), F.lit(3)).cast("int")).alias("outcome"))


def file_name() -> Column:
    prefix = F.when(F.col("event_type").isin("view", "click"), "other_").otherwise("sing_")
    return F.concat(prefix, F.col("event_id"), F.lit(".wav"))


def files(spark, sf) -> DataFrame:
    return events(spark, sf).select(file_name().alias("name"), F.col("t").alias("mtime"))


sql_view("files", """SELECT CASE WHEN event_type IN ('view', 'click') THEN 'other_' ELSE 'sing_' END || event_id || '.wav' AS name,
  t AS mtime FROM ev""", ("ev",))

_STATES = {"view": "waiting", "signup": "waiting", "click": "scanned", "error": "expired", "purchase": "success"}


def polls(spark, sf) -> DataFrame:
    return as_polls(events(spark, sf))


def as_polls(ev: DataFrame) -> DataFrame:
    """One session per user and day; a day of log time stands for ten minutes of polling."""
    day = F.col("t") - F.pmod("t", F.lit(DAY_US))
    named = F.create_map(*[F.lit(v) for kv in _STATES.items() for v in kv])
    return ev.select(
        F.concat_ws("-", "user_id", F.expr(f"t div {DAY_US}")).alias("session"), day.alias("start"),
        (day + F.expr(f"(t % {DAY_US}) div 144")).alias("t"), F.col("event_id").alias("seq"),
        F.try_element_at(named, F.col("event_type")).alias("state"), F.col("ts").cast("timestamp").alias("ts"),
    )


sql_view("polls", f"""SELECT user_id || '-' || (t // {DAY_US}) AS session, t - t % {DAY_US} AS start,
  t - t % {DAY_US} + (t % {DAY_US}) // 144 AS t, event_id AS seq,
  CASE event_type WHEN 'click' THEN 'scanned' WHEN 'error' THEN 'expired' WHEN 'purchase' THEN 'success' ELSE 'waiting' END AS state
  FROM ev""", ("ev",))


def sections(spark, sf) -> DataFrame:
    return as_sections(events(spark, sf))


def as_sections(ev: DataFrame) -> DataFrame:
    return ev.select(F.col("user_id").alias("key"), F.col("props").alias("value"), F.col("t").alias("ts"), F.col("event_id").alias("seq"))


# ---- provider payloads: ten parts make one answer, with gaps and oddities

def _payload_rows(spark, sf) -> DataFrame:
    """Parts with a supplier that sold them, the one of the least key."""
    part, sup = table(spark, sf, "part"), table(spark, sf, "supplier").select("s_suppkey", "s_name")
    sold = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    named = sold.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "s_name")
    joined = part.join(named, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("s_name", F.coalesce("s_name", F.lit("")))
    return joined.withColumn("payload_id", F.expr("p_partkey div 10"))


def _json(*pieces) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def _mod(n: int, k: int = 0):
    return F.pmod("p_partkey", F.lit(n)) == k


def payload_a(spark, sf) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    artists = _json('[{"name":"', F.col("s_name"), '"},"solo",{"name":""},{"name":"', F.col("p_brand"), '"}]')
    album = F.when(_mod(7), F.lit("null")).when(_mod(7, 1), F.lit('"loose"')).otherwise(_json('{"name":"', F.col("p_type"), '"}'))
    entry = F.when(_mod(13), F.lit('"skip"')).otherwise(_json(
        '{"id":', F.when(_mod(17), F.lit("null")).otherwise(key), ',"name":"', F.when(_mod(11), F.lit("")).otherwise(F.col("p_name")),
        '","artists":', artists, ',"album":', album, "}",
    ))
    code = F.when(F.pmod("payload_id", F.lit(9)) == 0, "500").otherwise("200")
    return (
        _payload_rows(spark, sf).groupBy("payload_id").agg(F.array_join(F.collect_list(entry), ",").alias("_songs"))
        .select("payload_id", F.lit("163").alias("provider"), _json('{"code":', code, ',"result":{"songs":[', F.col("_songs"), "]}}").alias("payload"))
    )


def payload_b(spark, sf) -> DataFrame:
    key = F.concat(F.lit("q"), F.col("p_partkey"))
    mid = F.when(_mod(3), _json('"mid":"","songmid":"', key, '"')).otherwise(_json('"mid":"', key, '"'))
    name = F.when(_mod(11), F.lit('"name":"","songname":""')).when(_mod(4), _json('"songname":"', F.col("p_name"), '"')).otherwise(_json('"name":"', F.col("p_name"), '","songname":"other"'))
    media = F.when(_mod(5), _json('"file":{"media_mid":""},"strMediaMid":"s', key, '"')).when(_mod(5, 1), F.lit('"file":{}')).otherwise(_json('"file":{"media_mid":"f', key, '"}'))
    singers = F.when(_mod(6), F.lit("[]")).otherwise(_json('[{"name":"', F.col("p_brand"), '"},3]'))
    album = F.when(_mod(7), F.lit("null")).otherwise(_json('{"name":"', F.col("p_type"), '"}'))
    entry = _json("{", mid, ",", name, ",", media, ',"singer":', singers, ',"album":', album, "}")
    k = F.pmod("payload_id", F.lit(8))
    outer = F.when(k == 0, '"code":1,').when(k == 1, "").otherwise('"code":0,')
    inner = F.when(k == 2, '"code":2000,').when(k == 3, "").otherwise('"code":0,')
    return (
        _payload_rows(spark, sf).groupBy("payload_id").agg(F.array_join(F.collect_list(entry), ",").alias("_songs"))
        .select(
            "payload_id", F.lit("qq").alias("provider"),
            _json("{", outer, '"req_1":{', inner, '"data":{"body":{"song":{"list":[', F.col("_songs"), "]}}}}}").alias("payload"),
        )
    )


def songs(spark, sf) -> DataFrame:
    return catalog_union(
        songs_from_json_163(good_payloads(payload_a(spark, sf), "163")),
        songs_from_json_qq(good_payloads(payload_b(spark, sf), "qq")),
    )


sql_view("songs_163", """SELECT CAST(p_partkey AS VARCHAR) AS song_id, p_name AS name, concat_ws(', ', s_name, p_brand) AS artists,
  CASE WHEN p_partkey % 7 IN (0, 1) THEN '' ELSE p_type END AS album, '163' AS platform
  FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS k FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = k
  WHERE (p_partkey // 10) % 9 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 AND p_partkey % 11 <> 0""")
sql_view("songs_qq", """SELECT 'q' || p_partkey AS song_id, p_name AS name, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_brand END AS artists,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS album, 'qq' AS platform,
  CASE p_partkey % 5 WHEN 0 THEN 'sq' || p_partkey WHEN 1 THEN '' ELSE 'fq' || p_partkey END AS media_id
  FROM part WHERE (p_partkey // 10) % 8 NOT IN (0, 2) AND p_partkey % 11 <> 0""")
sql_view("songs", """SELECT song_id, name, artists, album, platform, '' AS media_id FROM songs_163
  UNION ALL SELECT song_id, name, artists, album, platform, media_id FROM songs_qq""", ("songs_163", "songs_qq"))


def searches(spark, sf) -> DataFrame:
    """Every part name as asked, with its type, and a search nothing matches."""
    asked = F.array(F.col("p_name"), F.concat_ws("  ", F.upper("p_name"), "p_type"), F.concat(F.lit("zzz-"), "p_brand"))
    return table(spark, sf, "part").select(F.explode(asked).alias("query")).distinct()


sql_view("searches", """SELECT DISTINCT unnest([p_name, upper(p_name) || '  ' || p_type, 'zzz-' || p_brand]) AS query FROM part""")
