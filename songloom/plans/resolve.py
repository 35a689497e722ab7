"""From chat messages to download URLs in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from songloom.operators.catalog import (
    DEFAULT_PLATFORM, PLATFORMS, best_url_by_quality, display_title, first_hit, platform_of, url_fallback_chain,
)
from songloom.operators.dedup import DEDUP_WINDOW_S, dedup_requests
from songloom.operators.requests import command_route
from songloom.session import materialized

COVER = "翻唱"


def resolve_requests(
    messages: DataFrame, songs: DataFrame, answers: DataFrame, default_platform: str = DEFAULT_PLATFORM,
    window_s: float = DEDUP_WINDOW_S, partitions: int | None = None,
) -> DataFrame:
    """``(request_id, outcome, reason, leader_id, song_id, platform, title, url)``, a row per message.

    ``messages(request_id, stream, text, t, dur, ok, platform)`` is the request
    log, ``songs`` the catalog, ``answers(platform, song_id, media_id, files,
    servers, url_1, url_2, url_3)`` what providers said about songs. A message
    is routed; cover requests with a query are reduced to single runs; each
    started run searches its platform (the default if it names none) and takes
    the best hit; its URL is picked by quality or by the chain of sources.

    ``outcome`` is ``resolved``, ``reused`` (then the other columns are those of
    the run that was joined), ``failed``, ``rejected`` (no query) or ``ignored``;
    ``reason`` says why where it is not resolved. Every distinct search and song is looked up once.
    ``songs`` is read for the search of each platform and for the titles, so it should be a table and not a computation.
    """
    kept = F.struct("request_id", "stream", "t", "dur", "ok", platform_of(F.col("platform"), default_platform).alias("platform"))
    routed = command_route(messages.select(kept.alias("conv_id"), F.lit(0).alias("turn"), "text"))
    parsed = materialized(routed.select("conv_id.*", "command", "model", "query", "missing_arg"), "routed")
    covers = parsed.where((F.col("command") == COVER) & ~F.col("missing_arg"))
    runs = dedup_requests(covers.withColumn("flag", F.lit(False)), window_s, partitions).select(
        F.col("request_id").alias("_id"), "leader_id", "reused"
    )
    runs = materialized(runs, "runs")
    started = covers.join(runs.where("NOT reused"), F.col("request_id") == F.col("_id")).select("leader_id", "platform", "query")
    asked = materialized(started.select("platform", "query").distinct(), "searches")
    hits = materialized(reduce(DataFrame.unionByName, [
        first_hit(asked.where(F.col("platform") == p).select("query"), songs.where(F.col("platform") == p)).select(
            F.lit(p).alias("_platform"), F.col("query").alias("_query"), "song_id", "found"
        )
        for p in PLATFORMS
    ]), "hits")
    chosen = hits.where("found").select(F.col("_platform").alias("platform"), "song_id").distinct()
    known = songs.join(chosen, ["platform", "song_id"], "left_semi").groupBy("platform", "song_id").agg(
        F.min(F.struct("name", "artists")).alias("_s")
    ).select(F.col("platform").alias("_p"), F.col("song_id").alias("_i"), display_title(F.col("_s.name"), F.col("_s.artists")).alias("title"))
    said = materialized(answers.join(chosen, ["platform", "song_id"], "left_semi"), "said")
    by_provider = {"qq": best_url_by_quality, "163": url_fallback_chain}
    urls = reduce(DataFrame.unionByName, [
        pick(said.where(F.col("platform") == p)).select(F.lit(p).alias("_up"), F.col("song_id").alias("_us"), "url") for p, pick in by_provider.items()
    ]).groupBy("_up", "_us").agg(F.min("url").alias("url"))
    found = (
        hits.where("found").join(known, (F.col("_platform") == F.col("_p")) & (F.col("song_id") == F.col("_i")))
        .join(urls, (F.col("_platform") == F.col("_up")) & (F.col("song_id") == F.col("_us")), "left")
        .select("_platform", "_query", "song_id", "title", "url")
    )
    answered = materialized(
        started.join(found, (F.col("platform") == F.col("_platform")) & (F.col("query") == F.col("_query")), "left")
        .select(F.col("leader_id").alias("_leader"), F.col("platform").alias("_on"), "song_id", "title", "url"), "answered"
    )
    joined = parsed.join(runs, F.col("request_id") == F.col("_id"), "left").join(answered, F.col("leader_id") == F.col("_leader"), "left")
    why = (
        F.when(F.col("command").isNull(), "no command").when(F.col("command") != COVER, "other command").when(F.col("missing_arg"), "no query")
        .when(F.col("song_id").isNull(), "no song found").when(F.col("url").isNull(), "no playable audio")
    )
    outcome = (
        F.when(F.col("command").isNull() | (F.col("command") != COVER), "ignored").when(F.col("missing_arg"), "rejected")
        .when(F.col("reused"), "reused").when(why.isNotNull(), "failed").otherwise("resolved")
    )
    return joined.select(
        "request_id", outcome.alias("outcome"), why.alias("reason"), "leader_id", "song_id",
        F.when(F.col("song_id").isNotNull(), F.col("_on")).alias("platform"), "title", "url",
    )
