"""Song catalog: search ranking, download URLs, titles and platforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from songloom.functions.columns import blank_to_null, text
from songloom.functions.urls import has_audio_extension, url_base, url_host, url_join
from songloom.operators.search import keyword_topk

# Quality order (prefix, extension), best first.
QUALITIES = (("F000", ".flac"), ("M800", ".mp3"), ("M500", ".mp3"), ("C400", ".m4a"))
# Platform names and aliases.
PLATFORMS = ("163", "qq")
PLATFORM_ALIASES = {
    "网易": "163", "netease": "163", "网易云音乐": "163",
    "qq音乐": "qq", "qqmusic": "qq",
}
DEFAULT_PLATFORM = "163"

SONG_COLUMNS = ("song_id", "name", "artists", "album", "platform", "media_id")


def catalog_union(*catalogs: DataFrame) -> DataFrame:
    """One song relation from several providers; a missing media id is ''."""
    merged = catalogs[0]
    for other in catalogs[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    if "media_id" not in merged.columns:
        merged = merged.withColumn("media_id", F.lit(""))
    return merged.withColumn("media_id", F.coalesce("media_id", F.lit(""))).select(*SONG_COLUMNS)


def first_hit(queries: DataFrame, songs: DataFrame) -> DataFrame:
    """Best song per query, with platform and media id; queries without one are kept and marked."""
    top = keyword_topk(queries, songs, limit=1).drop("rank", "score")
    return (
        queries.select("query").distinct().join(top, "query", "left")
        .select("query", "song_id", "platform", "media_id", F.col("song_id").isNotNull().alias("found"))
    )


def _quality_names(song_id: Column, media_id: Column) -> Column:
    resource = F.coalesce(F.nullif(media_id, F.lit("")), song_id)
    return F.array(*[
        F.struct(F.lit(i).alias("rank"), F.concat(F.lit(p), resource, F.lit(e)).alias("candidate"))
        for i, (p, e) in enumerate(QUALITIES, start=1)
    ])


def candidate_expand(songs: DataFrame) -> DataFrame:
    """Candidate file names per song, one row per quality."""
    names = _quality_names(F.col("song_id"), F.col("media_id"))
    return songs.select("song_id", F.explode(names).alias("c")).select("song_id", "c.rank", "c.candidate")


def best_url_by_quality(answers: DataFrame) -> DataFrame:
    """First usable URL in quality order, row by row without a shuffle.

    ``answers(song_id, media_id, files ARRAY<STRUCT<filename, purl>>, servers
    ARRAY<STRING>)``. For a repeated file name the last entry counts. Absolute
    paths are kept; others join the first https server, else the first
    non-empty one. A candidate that gives no http(s) URL is passed over.
    """
    secure = F.get(F.filter("servers", lambda s: s.startswith("https://")), 0)
    named = F.get(F.filter("servers", lambda s: s.isNotNull() & (s != "")), 0)
    server = F.coalesce(secure, named)

    def answer(c: Column) -> Column:
        mine = F.filter("files", lambda f: f["filename"] == c["candidate"])
        purl = blank_to_null(F.try_element_at(mine, F.lit(-1))["purl"])
        return F.struct(c["rank"].alias("rank"), purl.alias("purl"), purl.rlike("^https?://").alias("absolute"))

    def resolve(c: Column) -> Column:
        url = F.when(c["absolute"], c["purl"]).otherwise(url_join(F.col("_server"), c["purl"]))
        return F.struct(c["rank"].alias("rank"), url.alias("url"), c["absolute"].alias("absolute"))

    # one step per array: a later step reads what an earlier one computed
    tried = F.transform(F.transform(_quality_names(F.col("song_id"), F.col("media_id")), answer), resolve)
    usable = F.filter(tried, lambda c: c["absolute"] | c["url"].rlike(r"^https?://[^/?#]"))
    return answers.withColumn("_server", url_base(server)).withColumn("_hit", F.get(usable, 0)).select(
        "song_id", F.col("_hit.url").alias("url"), F.col("_hit.rank").alias("rank")
    )


def url_fallback_chain(answers: DataFrame) -> DataFrame:
    """First non-blank of three URL sources; the third must look like audio.

    ``answers(song_id, url_1, url_2, url_3)``.
    """
    third = F.when(has_audio_extension(F.col("url_3")), F.col("url_3"))
    chain = [blank_to_null(F.col("url_1")), blank_to_null(F.col("url_2")), third]
    rank = F.when(chain[0].isNotNull(), 1).when(chain[1].isNotNull(), 2).when(third.isNotNull(), 3)
    return answers.select("song_id", F.coalesce(*chain).alias("url"), rank.alias("rank"))


def audio_url_filter(urls: DataFrame) -> DataFrame:
    """Audio and other URLs per host."""
    return (
        urls.select(url_host(F.col("url")).alias("host"), has_audio_extension(F.col("url")).alias("is_audio"))
        .groupBy("host", "is_audio").agg(F.count(F.lit(1)).alias("n"))
    )


def platform_of(raw: Column, default: str = DEFAULT_PLATFORM) -> Column:
    """Canonical platform name, with aliases; the valid default otherwise."""
    fallback = default.strip().lower()
    fallback = fallback if fallback in PLATFORMS else DEFAULT_PLATFORM
    known = {p: p for p in PLATFORMS} | PLATFORM_ALIASES
    lookup = F.create_map(*[F.lit(v) for kv in known.items() for v in kv])
    return F.coalesce(F.try_element_at(lookup, F.lower(text(raw))), F.lit(fallback))


def platform_normalize(rows: DataFrame, default: str = DEFAULT_PLATFORM) -> DataFrame:
    """Platform of each raw spelling, with its number of rows."""
    return (
        rows.groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
        .select("raw", platform_of(F.col("raw"), default).alias("platform"), "n")
    )


def display_title(name: Column, artists: Column) -> Column:
    return F.when(F.coalesce(artists, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(" - "), artists))


def title_collisions(songs: DataFrame) -> DataFrame:
    """Titles shared by several songs, with the platforms they are on."""
    return (
        songs.groupBy(display_title(F.col("name"), F.col("artists")).alias("title"))
        .agg(F.count(F.lit(1)).alias("n_songs"), F.collect_set("platform").alias("_p"))
        .where(F.col("n_songs") > 1)
        .select("title", "n_songs", F.array_join(F.array_sort("_p"), ",").alias("platforms"))
    )
