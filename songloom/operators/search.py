"""The best songs of word searches, from an index of words in threshold rounds.

A song scores the number of distinct words that it shares with a query. The
words of a query are taken by rising frequency. A song that shares ``s`` of its
``m`` words either holds one of the ``m - s`` rarest or it holds all of the others. So
a round at level ``s`` follows the postings of the rarest words only, and of the
songs that hold all others it needs no more than the ``limit`` least, a list that
queries with the same frequent words share. A query leaves once ``limit`` songs of the level are
known. Levels fall by doubling steps down to two; for what then is left, the
``limit`` least songs of every single word decide. No posting of a query's two
most frequent words is ever joined with the query, however frequent they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from songloom.functions.columns import text
from songloom.session import materialized

SEARCH_LIMIT = 5
SONG = ("song_id", "platform", "media_id")


def tokens(c: Column) -> Column:
    """Distinct lower-case words of a text, and an empty one."""
    return F.array_union(F.split(F.lower(text(c)), r"(?U)\s+"), F.array(F.lit("")))


class WordIndex:
    """Songs by their sets of words, reduced to those of ``vocabulary(_text, _word)``, which numbers the words of queries.

    ``sets(_sid, _set, _songs)``: songs of one reduced set score alike for every
    query, so a set keeps its ``limit`` least songs. ``postings(_word, _sid)``
    says which sets hold a word, ``frequency(_word, _n)`` how many. Only numbers
    of words move, and none that no query holds.
    """

    def __init__(self, songs: DataFrame, vocabulary: DataFrame, limit: int):
        known = lambda c: F.coalesce(F.col(c), F.lit("")) if c in songs.columns else F.lit("")
        # a title is told from others of its song by 128 bits of its name
        titled = songs.select(
            "song_id", known("platform").alias("platform"), known("media_id").alias("media_id"),
            F.xxhash64("name").alias("_t1"), F.xxhash64(F.lit("second"), "name").alias("_t2"), F.explode(tokens(F.col("name"))).alias("_text"),
        )
        # the empty word has no number, but keeps titles whose song's media id counts
        blank = songs.sparkSession.range(1).select(F.lit("").alias("_text"), F.lit(None).cast("long").alias("_word"))
        reduced = titled.join(vocabulary.unionByName(blank), "_text").groupBy("song_id", "platform", "_t1", "_t2").agg(
            F.min("media_id").alias("media_id"), F.array_sort(F.collect_set("_word")).alias("_set")
        )
        if "media_id" in songs.columns:
            reduced = reduced.withColumn("media_id", F.min("media_id").over(W.partitionBy("song_id", "platform")))
        # equal sets have equal 128 bits
        keyed = reduced.where(F.size("_set") > 0).select(
            F.struct(*SONG).alias("song"), "_set", F.xxhash64("_set").alias("_s1"), F.xxhash64(F.lit("second"), "_set").alias("_s2")
        )
        # titles of one song with one set are one place
        smallest = F.dense_rank().over(W.partitionBy("_s1", "_s2").orderBy("song"))
        sets = keyed.withColumn("_n", smallest).where(F.col("_n") <= limit).groupBy("_s1", "_s2").agg(
            F.first("_set").alias("_set"), F.collect_set("song").alias("_songs")
        ).select("_set", "_songs")
        self.sets = materialized(sets.withColumn("_sid", F.monotonically_increasing_id()), "word-sets")
        self.postings = self.sets.select("_sid", F.explode("_set").alias("_word"))
        self.frequency = materialized(self.postings.groupBy("_word").agg(F.count(F.lit(1)).alias("_n")), "word-frequency")

    def least(self, holding: DataFrame, key: str, limit: int, all_of: bool) -> DataFrame:
        """``(key, _sid)``: the sets with the ``limit`` least songs for each key of ``holding(key, _word)``.

        With ``all_of`` the key is a list of words that a set must hold as a whole.
        """
        met = holding.join(self.postings, "_word").select(key, F.col("_sid").alias("_id")).join(self.sets, F.col("_id") == F.col("_sid"))
        if all_of:
            met = met.where(F.size(F.array_except(key, "_set")) == 0)
        # songs with several titles are one song in the list
        place = F.dense_rank().over(W.partitionBy(key).orderBy("song"))
        listed = met.select(key, "_sid", F.explode("_songs").alias("song")).withColumn("_place", place)
        return listed.where(F.col("_place") <= limit).select(key, "_sid").distinct()


def _scored(pairs: DataFrame, queries: DataFrame, index: WordIndex) -> DataFrame:
    """``(_qid, song, score)`` of pairs ``(_qid, _sid)``."""
    met = pairs.select("_qid", F.col("_sid").alias("_id")).join(index.sets, F.col("_id") == F.col("_sid"))
    met = met.join(queries.select(F.col("_qid").alias("_q"), "_w"), F.col("_qid") == F.col("_q"))
    return met.select("_qid", F.size(F.array_intersect("_set", "_w")).alias("score"), F.explode("_songs").alias("song"))


def _best(scored: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best songs of each query; a song with several titles counts by its best one."""
    songs = scored.groupBy("_qid", "song").agg(F.max("score").alias("score"))
    order = W.partitionBy("_qid").orderBy(F.desc("score"), F.asc("song.song_id"), F.asc("song.platform"))
    return songs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _counted(pairs: DataFrame, seen: list[int] | None) -> DataFrame:
    if seen is not None:
        seen.append(pairs.count())
    return pairs


def _last_of_rarest(t: int) -> Column:
    """Up to which of its words a query has followed the postings after a round."""
    return F.least(F.lit(t), F.greatest(F.size("_w") - 2, F.lit(0)))


def keyword_topk(queries: DataFrame, songs: DataFrame, limit: int = SEARCH_LIMIT, seen: list[int] | None = None) -> DataFrame:
    """Best ``limit`` songs per query by number of distinct query words matched, ties by id, then platform.

    ``queries(query)``, ``songs(song_id, name)`` and, if known, ``platform`` and
    ``media_id``; a song is a platform and an id, listed once however often it
    occurs (of several media ids the least). A null query or name has no words;
    queries that match nothing have no row. The result is exact for any
    frequency of words. ``seen`` is told how many
    pairs each join makes, which counts them in jobs of their own.
    """
    asked = queries.select("query").distinct().select("query", F.explode(tokens(F.col("query"))).alias("_text")).where("_text <> ''")
    vocabulary = materialized(asked.select("_text").distinct().withColumn("_word", F.monotonically_increasing_id()), "query-words")
    words = asked.join(vocabulary, "_text").select("query", "_word")
    index = WordIndex(songs, vocabulary, limit)
    # words that no song holds cannot match
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_word"))), lambda x: x["_word"])
    known = materialized(words.join(index.frequency, "_word").groupBy("query").agg(ordered.alias("_w")), "queries")
    # queries of the same words are one, and only its number travels with the songs
    every = materialized(known.select("_w").distinct().withColumn("_qid", F.monotonically_increasing_id()), "word-lists")
    active, best, before, t = every.where(F.size("_w") > 1), None, 0, 1
    while not active.isEmpty():
        low, high = _last_of_rarest(before), _last_of_rarest(t)
        due = active.where(high > low) if before else active  # others wait for the single words
        asking = due.select("_qid", F.explode(F.slice("_w", low + 1, high - low)).alias("_word"))
        posted = _counted(asking.join(index.postings, "_word"), seen).select("_qid", "_sid")
        others = due.select("_qid", F.slice("_w", high + 1, F.size("_w") - high).alias("_rest"))
        anchors = others.select("_rest", F.col("_rest")[0].alias("_word")).distinct()
        listed = _counted(others.join(index.least(anchors, "_rest", limit, True), "_rest"), seen).select("_qid", "_sid")
        found = _scored(posted.unionByName(listed).distinct(), every, index)
        best = materialized(_best(found if best is None else found.unionByName(best.select("_qid", "score", "song")), limit), "best-songs")
        # sure of the limit at this level, or down to the last one
        level = F.size("_w") - high
        sure = best.where(F.col("rank") == limit).select(F.col("_qid").alias("_done"), F.col("score").alias("_score"))
        left = active.join(sure, (F.col("_qid") == F.col("_done")) & (F.col("_score") >= level), "left_anti")
        active = materialized(left, "open-queries")
        before, t = t, 2 * t
        if active.where(_last_of_rarest(before) < F.size("_w") - 2).isEmpty():
            break
    # single words: of what no round has made sure, and of queries of one word
    single = active.unionByName(every.where(F.size("_w") == 1))
    asking = single.select("_qid", F.explode("_w").alias("_word"))
    lists = index.least(asking.select(F.col("_word").alias("_one"), "_word").distinct(), "_one", limit, False)
    listed = _counted(asking.join(lists, F.col("_word") == F.col("_one")), seen).select("_qid", "_sid")
    found = _scored(listed.distinct(), every, index)
    final = _best(found if best is None else found.unionByName(best.select("_qid", "score", "song")), limit)
    return known.join(every, "_w").join(final, "_qid").select("query", "rank", *[F.col(f"song.{c}").alias(c) for c in SONG], "score")
