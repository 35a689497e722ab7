"""Asset, payload and catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import views as v
from registry.core import query, sql_view, table
from songloom.operators import catalog as c, models as m
from songloom.sources import assets as a, payloads as pl


def assets(spark, sf):
    """Three kinds of file over one directory per label."""
    ext = F.get(F.array(F.lit(".pth"), F.lit(".onnx"), F.lit(".txt")), F.pmod("vec_id", F.lit(3)).cast("int"))
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("models/"), "label").alias("dir"), F.concat(F.lit("m"), "vec_id", ext).alias("name"), "vec_id", "label"
    )


sql_view("assets", """SELECT 'models/' || label AS dir, 'm' || vec_id || ['.pth', '.onnx', '.txt'][vec_id % 3 + 1] AS name, vec_id, label FROM embeddings""")


@query("asset_listing", "SELECT dir, name FROM assets WHERE name LIKE '%.pth' ORDER BY name, dir", ("assets",))
def asset_listing(spark, sf):
    return a.asset_listing(assets(spark, sf))


@query("first_asset_per_dir", """SELECT dir, coalesce(min(name) FILTER (WHERE name LIKE '%.onnx'), '') AS first_name
FROM (SELECT dir, name FROM assets UNION ALL SELECT dir || '-bare', NULL FROM assets) GROUP BY dir""", ("assets",))
def first_asset_per_dir(spark, sf):
    listing = assets(spark, sf)
    dirs = listing.select(F.explode(F.array("dir", F.concat("dir", F.lit("-bare")))).alias("dir"))
    return a.first_asset_per_dir(dirs, listing, ".onnx")


@query("model_route", """SELECT vec_id AS request_id,
  CASE WHEN NOT (model LIKE '%.onnx') AND NOT EXISTS (SELECT 1 FROM assets x WHERE x.dir = r.dir AND x.name = r.model)
    AND EXISTS (SELECT 1 FROM assets x WHERE x.dir = r.dir AND x.name = r.model || '.onnx') THEN dir || '/' || model || '.onnx'
    ELSE dir || '/' || model END AS path,
  CASE WHEN model LIKE '%.onnx' OR (NOT EXISTS (SELECT 1 FROM assets x WHERE x.dir = r.dir AND x.name = r.model)
    AND EXISTS (SELECT 1 FROM assets x WHERE x.dir = r.dir AND x.name = r.model || '.onnx')) THEN 'A' ELSE 'B' END AS family
FROM (SELECT vec_id, 'models/' || label AS dir, ['m' || vec_id, 'm' || vec_id || '.onnx', 'm' || vec_id || '.pth', 'x' || vec_id][vec_id % 4 + 1] AS model FROM embeddings) r""", ("assets",))
def model_route(spark, sf):
    stem = F.concat(F.lit("m"), "vec_id")
    names = F.array(stem, F.concat(stem, F.lit(".onnx")), F.concat(stem, F.lit(".pth")), F.concat(F.lit("x"), "vec_id"))
    wanted = assets(spark, sf).select(
        F.col("vec_id").alias("request_id"), F.col("dir").alias("base_dir"),
        F.get(names, F.pmod("vec_id", F.lit(4)).cast("int")).alias("model"),
    )
    return m.model_route(wanted, assets(spark, sf))


def linear_model(model_id):
    """Stand-in for a real model: one factor and one shift per model."""
    scale, shift = (1.0, 0.0) if model_id is None else (1.0 + model_id, model_id / 8.0)

    def apply(batch):
        out = batch.copy()
        out["embedding"] = [row * scale + shift for row in batch["embedding"]]
        return out

    return apply


@query("batch_apply_model", """SELECT label AS model_id, vec_id, i AS pos, (round(x * (1 + label) + label / 8e0, 6) + 0e0) AS value FROM emb""", ("emb",))
def batch_apply_model(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        F.col("label").alias("model_id"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    applied = m.batch_apply_model(rows, linear_model, "model_id int, vec_id bigint, embedding array<double>", spread_by="vec_id")
    return applied.select("model_id", "vec_id", F.posexplode("embedding").alias("_p", "_v")).select(
        "model_id", "vec_id", F.col("_p").cast("bigint").alias("pos"), F.round("_v", 6).alias("value"))


@query("batch_apply_model_null", """SELECT CASE WHEN vec_id % 7 <> 0 THEN label END AS model_id, count(*) AS n,
  (round(sum(CASE WHEN vec_id % 7 <> 0 THEN x * (1 + label) + label / 8e0 ELSE x END), 4) + 0e0) AS total FROM emb GROUP BY 1""", ("emb",))
def batch_apply_model_null(spark, sf):
    """Every seventh row has no model."""
    rows = table(spark, sf, "embeddings").select(
        F.when(F.pmod("vec_id", F.lit(7)) != 0, F.col("label")).alias("model_id"), "vec_id",
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    applied = m.batch_apply_model(rows, linear_model, "model_id int, vec_id bigint, embedding array<double>", spread_by="vec_id")
    values = applied.select("model_id", F.explode("embedding").alias("x"))
    return values.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("total"))


@query("songs_from_json_163", "SELECT song_id, name, artists, album, platform FROM songs_163", ("songs_163",))
def songs_from_json_163(spark, sf):
    return pl.songs_from_json_163(pl.good_payloads(v.payload_a(spark, sf), "163"))


@query("songs_from_json_qq", "SELECT song_id, name, artists, album, platform, media_id FROM songs_qq", ("songs_qq",))
def songs_from_json_qq(spark, sf):
    return pl.songs_from_json_qq(pl.good_payloads(v.payload_b(spark, sf), "qq"))


@query("payload_status_split", """SELECT p AS payload_id, provider,
  CASE WHEN provider = '163' AND p % 9 = 0 OR provider = 'qq' AND p % 8 IN (0, 2) OR p % 5 > 0 AND p % 11 = 5 THEN 'error' ELSE 'ok' END AS status
FROM (SELECT DISTINCT p_partkey // 10 AS p FROM part) CROSS JOIN (VALUES ('163'), ('qq')) x(provider)""")
def payload_status_split(spark, sf):
    """Some answers are broken: cut JSON, an error page, a list, nothing at all."""
    broken = F.get(F.array(F.col("payload"), F.expr("left(payload, 40)"), F.lit("<html>busy</html>"), F.lit("[1]"), F.lit(None)), F.pmod("payload_id", F.lit(5)).cast("int"))
    both = v.payload_a(spark, sf).unionByName(v.payload_b(spark, sf))
    return pl.payload_status_split(both.withColumn("payload", F.when(F.pmod("payload_id", F.lit(11)) == 5, broken).otherwise(F.col("payload"))))


@query("catalog_union", "SELECT song_id, name, artists, album, platform, media_id FROM songs", ("songs",))
def catalog_union(spark, sf):
    return v.songs(spark, sf)


sql_view("song_words", "SELECT DISTINCT song_id, unnest(string_split_regex(lower(trim(name)), '\\s+')) AS w FROM songs", ("songs",))
sql_view("query_words", "SELECT DISTINCT query, unnest(string_split_regex(lower(trim(query)), '\\s+')) AS w FROM searches", ("searches",))
sql_view("ranked", """SELECT query, song_id, platform, media_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, song_id) AS rank
FROM (SELECT query, song_id, CAST(count(*) AS INTEGER) AS score FROM query_words JOIN song_words USING (w) GROUP BY query, song_id)
JOIN songs USING (song_id)""", ("songs", "song_words", "query_words"))
_TOP = "SELECT query, CAST(rank AS INTEGER) AS rank, song_id, platform, media_id, score FROM ranked WHERE rank <= 5"


@query("keyword_topk", _TOP, ("ranked",))
def keyword_topk(spark, sf):
    return c.keyword_topk(v.searches(spark, sf), v.songs(spark, sf))


_COMMON = "(SELECT song_id, platform, media_id, 'the ' || name AS name FROM songs)"


@query("keyword_topk_hot_words", f"""SELECT query, CAST(rank AS INTEGER) AS rank, song_id, platform, media_id, score FROM (
  SELECT 'the ' || query AS query, song_id, platform, media_id, CAST(count(DISTINCT w) AS INTEGER) AS score,
    row_number() OVER (PARTITION BY query ORDER BY count(DISTINCT w) DESC, song_id) AS rank
  FROM (SELECT DISTINCT query, unnest(['the', w]) AS w FROM query_words)
  JOIN (SELECT DISTINCT song_id, platform, media_id, unnest(string_split_regex(lower(name), '\\s+')) AS w FROM {_COMMON} c) USING (w)
  GROUP BY query, song_id, platform, media_id) WHERE rank <= 5""", ("songs", "query_words"))
def keyword_topk_hot_words(spark, sf):
    """One word is in every title and in every search."""
    the = lambda col: F.concat(F.lit("the "), col)
    return c.keyword_topk(v.searches(spark, sf).select(the("query").alias("query")), v.songs(spark, sf).withColumn("name", the("name")))


# white space as Unicode has it
_SPACE = r"[\s\v\x{85}\p{Z}]+"


@query("keyword_topk_documents", rf"""SELECT query, CAST(rank AS INTEGER) AS rank, song_id, platform, media_id, score FROM (
  SELECT query, song_id, '' AS platform, '' AS media_id, CAST(count(*) AS INTEGER) AS score,
    row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, song_id) AS rank
  FROM (SELECT DISTINCT query, w FROM (SELECT text AS query, unnest(string_split_regex(lower(text), '{_SPACE}')) AS w FROM benchmark) WHERE w <> '')
  JOIN (SELECT DISTINCT song_id, w FROM (SELECT CAST(doc_id AS VARCHAR) AS song_id, unnest(string_split_regex(lower(text), '{_SPACE}')) AS w FROM documents) WHERE w <> '')
    USING (w) GROUP BY query, song_id) WHERE rank <= 5""")
def keyword_topk_documents(spark, sf):
    """Titles of any length with words of any frequency: every benchmark item against every document."""
    titles = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("song_id"), F.col("text").alias("name"))
    return c.keyword_topk(table(spark, sf, "benchmark").select(F.col("text").alias("query")), titles)


@query("keyword_topk_repeated", """SELECT query, CAST(rank AS INTEGER) AS rank, song_id, platform, media_id, score FROM (
  SELECT query, song_id, platform, media_id, CAST(count(*) AS INTEGER) AS score,
    row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, song_id, platform) AS rank
  FROM query_words JOIN (SELECT DISTINCT ltrim(song_id, 'q') AS song_id, platform, media_id,
    unnest(string_split_regex(lower(name), '\\s+')) AS w FROM songs) USING (w)
  GROUP BY query, song_id, platform, media_id) WHERE rank <= 5""", ("songs", "query_words"))
def keyword_topk_repeated(spark, sf):
    """Answers repeat songs, with names spelled differently, and both providers use the same ids."""
    songs = v.songs(spark, sf).withColumn("song_id", F.ltrim("song_id", F.lit("q")))
    again = songs.withColumn("name", F.explode(F.array("name", F.upper("name"), F.concat(F.lit(" "), "name"))))
    return c.keyword_topk(v.searches(spark, sf), songs.unionByName(again))


@query("first_hit", """SELECT s.query, r.song_id, r.platform, r.media_id, r.song_id IS NOT NULL AS found
FROM searches s LEFT JOIN ranked r ON r.query = s.query AND r.rank = 1""", ("searches", "ranked"))
def first_hit(spark, sf):
    return c.first_hit(v.searches(spark, sf), v.songs(spark, sf))


_QUALITY = "(VALUES (1, 'F000', '.flac'), (2, 'M800', '.mp3'), (3, 'M500', '.mp3'), (4, 'C400', '.m4a')) q(rank, prefix, ext)"


@query("candidate_expand", f"""SELECT song_id, rank, prefix || CASE WHEN media_id = '' THEN song_id ELSE media_id END || ext AS candidate
FROM songs CROSS JOIN {_QUALITY}""", ("songs",))
def candidate_expand(spark, sf):
    return c.candidate_expand(v.songs(spark, sf))


# how the path of a candidate is written, by a number from part and quality
_PURLS = ("", "  ", "a/b.mp3?k=1", "/root.mp3", "../up.flac", "//other.example/x.mp3", "https://cdn.example/y.m4a", "ftp://bad.example/z")
_JOINED = (None, None, "{base}a/b.mp3?k=1", "{root}/root.mp3", "{up}up.flac", "{scheme}://other.example/x.mp3", "https://cdn.example/y.m4a", None)
_SERVERS = (("http://a.example/", "https://b.example/base/v/"), ("http://c.example/only/x",), ("", "http://d.example"), ())


def url_answers(spark, sf):
    resource = F.coalesce(F.nullif("media_id", F.lit("")), F.col("song_id"))
    purls, servers = F.array(*map(F.lit, _PURLS)), F.array(*[F.array(*map(F.lit, s)).cast("array<string>") for s in _SERVERS])
    named = [F.struct(
        F.concat(F.lit(p), resource, F.lit(e)).alias("filename"),
        F.get(purls, F.pmod(F.col("k") * i + F.expr("k div 7"), F.lit(8)).cast("int")).alias("purl"),
    ) for i, (p, e) in enumerate(c.QUALITIES, 1)]
    # the best quality appears twice; the later entry counts
    again = F.struct(F.concat(F.lit("F000"), resource, F.lit(".flac")).alias("filename"),
                     F.when(F.pmod("k", F.lit(3)) == 0, "").otherwise(F.get(purls, F.pmod("k", F.lit(8)).cast("int"))).alias("purl"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("song_id"),
        F.when(F.pmod("p_partkey", F.lit(3)) == 0, "").otherwise(F.concat(F.lit("M"), "p_partkey")).alias("media_id"),
    ).select("song_id", "media_id", F.array(*named, again).alias("files"), F.get(servers, F.pmod(F.expr("k div 3"), F.lit(4)).cast("int")).alias("servers"))


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if x is None else "'" + x + "'" for x in values) + "]"


sql_view("picked", f"""SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS song_id, r.rank,
  CASE WHEN r.rank = 1 THEN CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 8 END ELSE (p_partkey * r.rank + p_partkey // 7) % 8 END AS purl_no,
  (p_partkey // 3) % 4 AS server_no FROM part CROSS JOIN (VALUES (1), (2), (3), (4)) r(rank)""")
sql_view("resolved", f"""SELECT song_id, rank, CASE
    WHEN purl_no = 6 THEN {_sql_list(_JOINED)}[7]
    WHEN server_no = 3 THEN NULL
    ELSE replace(replace(replace(replace({_sql_list(_JOINED)}[purl_no + 1],
      '{{base}}', ['https://b.example/base/v/', 'http://c.example/only/', 'http://d.example/'][server_no + 1]),
      '{{root}}', ['https://b.example', 'http://c.example', 'http://d.example'][server_no + 1]),
      '{{up}}', ['https://b.example/base/', 'http://c.example/', 'http://d.example/'][server_no + 1]),
      '{{scheme}}', ['https', 'http', 'http'][server_no + 1]) END AS url FROM picked""", ("picked",))


@query("best_url_by_quality", """SELECT song_id, arg_min(url, rank) FILTER (WHERE url IS NOT NULL) AS url,
  CAST(min(rank) FILTER (WHERE url IS NOT NULL) AS INTEGER) AS rank FROM resolved GROUP BY song_id""", ("resolved",))
def best_url_by_quality(spark, sf):
    return c.best_url_by_quality(url_answers(spark, sf))


def url_tiers(spark, sf):
    k = lambda n: F.pmod("page_id", F.lit(n)) == 0
    return table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("song_id"),
        F.when(k(3), "  ").when(k(2), F.lit(None)).otherwise(F.concat(F.lit(" "), "url")).alias("url_1"),
        F.when(k(5), F.concat("url", F.lit("?t=2"))).otherwise("").alias("url_2"),
        F.when(k(7), F.lit(None)).otherwise(F.concat("url", F.when(k(4), ".html").otherwise(".mp3"))).alias("url_3"),
    )


sql_view("url_tiers", """SELECT CAST(page_id AS VARCHAR) AS song_id,
  CASE WHEN page_id % 3 = 0 THEN '  ' WHEN page_id % 2 = 0 THEN NULL ELSE ' ' || url END AS url_1,
  CASE WHEN page_id % 5 = 0 THEN url || '?t=2' ELSE '' END AS url_2,
  CASE WHEN page_id % 7 = 0 THEN NULL ELSE url || CASE WHEN page_id % 4 = 0 THEN '.html' ELSE '.mp3' END END AS url_3 FROM pages""")
_AUDIO = "regexp_matches({c}, '\\.(mp3|flac|m4a|wav|ogg|aac)')"


@query("url_fallback_chain", f"""SELECT song_id, coalesce(a, b, d) AS url,
  CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 WHEN d IS NOT NULL THEN 3 END AS rank
FROM (SELECT song_id, nullif(trim(url_1), '') AS a, nullif(trim(url_2), '') AS b, CASE WHEN {_AUDIO.format(c='url_3')} THEN url_3 END AS d FROM url_tiers)""", ("url_tiers",))
def url_fallback_chain(spark, sf):
    return c.url_fallback_chain(url_tiers(spark, sf))


@query("audio_url_filter", f"""SELECT regexp_extract(url_3, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, {_AUDIO.format(c='url_3')} AS is_audio, count(*) AS n
FROM url_tiers WHERE url_3 IS NOT NULL GROUP BY ALL""", ("url_tiers",))
def audio_url_filter(spark, sf):
    return c.audio_url_filter(url_tiers(spark, sf).where(F.col("url_3").isNotNull()).select(F.col("url_3").alias("url")))


_RAW = ("163", " QQ ", "网易", "NetEase", "网易云音乐", "QQ音乐", "qqmusic", "spotify", "")
_PLATFORM = ("163", "qq", "163", "163", "163", "qq", "qq", "163", "163")


@query("platform_normalize", f"""SELECT {_sql_list(_RAW)}[o_orderkey % 9 + 1] AS raw, {_sql_list(_PLATFORM)}[o_orderkey % 9 + 1] AS platform, count(*) AS n
FROM orders GROUP BY ALL""")
def platform_normalize(spark, sf):
    raw = F.get(F.array(*map(F.lit, _RAW)), F.pmod("o_orderkey", F.lit(9)).cast("int"))
    return c.platform_normalize(table(spark, sf, "orders").select(raw.alias("raw")))


@query("title_collisions", """SELECT CASE WHEN artists = '' THEN name ELSE name || ' - ' || artists END AS title, count(*) AS n_songs,
  array_to_string(list_sort(list(DISTINCT platform)), ',') AS platforms FROM songs GROUP BY 1 HAVING count(*) > 1""", ("songs",))
def title_collisions(spark, sf):
    return c.title_collisions(v.songs(spark, sf))
