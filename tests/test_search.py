"""Word searches: threshold rounds against counting every pair."""

import random

import pytest

from songloom.operators import search
from songloom.operators.search import keyword_topk


def plain(queries, songs, limit):
    """``{(query, rank, id, platform, media, score)}``."""
    titles, media = {}, {}
    for song_id, platform, media_id, name in songs:
        key = (song_id, platform or "")
        titles.setdefault(key, []).append(set((name or "").lower().split()))
        media[key] = min(media.get(key, media_id or ""), media_id or "")
    out = set()
    for q in set(queries):
        words = set((q or "").lower().split())
        scored = [(-max(len(words & t) for t in own), *key) for key, own in titles.items()]
        for rank, (score, song_id, platform) in enumerate(sorted(x for x in scored if x[0])[:limit], 1):
            out.add((q, rank, song_id, platform, media[song_id, platform], -score))
    return out


def frames(spark, queries, songs):
    return (
        spark.createDataFrame([(q,) for q in queries], "query string"),
        spark.createDataFrame(songs, "song_id string, platform string, media_id string, name string"),
    )


@pytest.mark.parametrize("seed", range(4))
def test_equals_counting(spark, seed):
    """Few words that are everywhere and many that are rare; queries of 0 to 12 words; repeated songs and several titles."""
    rng = random.Random(seed)
    words = [f"w{int(60 * rng.random() ** 3)}" for _ in range(400)]
    title = lambda most: " ".join(rng.choices(words, k=rng.randrange(most)))
    songs = [(f"s{rng.randrange(70)}", rng.choice(["163", "qq", None]), rng.choice(["m1", "m2", None]), title(9)) for _ in range(150)]
    songs += [("null", None, None, None), ("same", "qq", "m", songs[0][3]), songs[1], songs[1]]
    queries = [title(rng.choice([1, 2, 3, 5, 13])) for _ in range(40)] + [None, "", "unknown words", "W1 w1  W2"]
    asked, catalog = frames(spark, queries, songs)
    limit = (1, 2, 5, 8)[seed]
    assert set(map(tuple, keyword_topk(asked, catalog, limit).collect())) == plain(queries, songs, limit)


def test_common_words_join_few_pairs(spark):
    """One word in every title and query: pairs are bounded by queries, limit and words, not by queries times titles."""
    n, limit = 1500, 5
    asked, catalog = frames(spark, [f"common q{i % n}" for i in range(n)], [(f"s{i}", "qq", "", f"common q{i}") for i in range(n)])
    seen = []
    rows = keyword_topk(asked, catalog, limit, seen).collect()
    assert len(rows) == n * limit
    assert {(r.query, r.song_id) for r in rows if r.rank == 1} == {(f"common q{i}", f"s{i}") for i in range(n)}
    assert sum(seen) <= n * limit * 2 + 2 * n


def test_two_common_words_that_never_meet(spark):
    n = 600
    asked, catalog = frames(
        spark, [f"left right q{i}" for i in range(n)], [(f"s{i:04}", "qq", "", f"{'left' if i % 2 else 'right'} t{i}") for i in range(n)]
    )
    seen = []
    rows = keyword_topk(asked, catalog, 5, seen).collect()
    assert {r.song_id for r in rows} == {f"s{i:04}" for i in range(5)} and len(rows) == 5 * n
    assert sum(seen) <= 60 * n


def test_empty_tables(spark):
    asked, catalog = frames(spark, ["a b c"], [("s", "qq", "", "a")])
    assert keyword_topk(asked.limit(0), catalog).count() == 0
    assert keyword_topk(asked, catalog.limit(0)).count() == 0
    assert keyword_topk(asked, catalog.select("song_id", "name")).collect()[0][:3] == ("a b c", 1, "s")


def test_titles_are_reduced_before_anything_moves(spark, monkeypatch):
    """Titles meet the words of queries where they are read: what is shuffled are numbers of words that some query holds."""
    plans, write = {}, search.materialized

    def written(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(search, "materialized", written)
    songs = [(f"s{i}", f"common w{i} other words\x1c" + " long" * 50) for i in range(40)]
    asked, catalog = frames(spark, ["common w3", "Common\tW3 absent"], [(a, None, None, b) for a, b in songs])
    rows = keyword_topk(asked, catalog.select("song_id", "name"), 2).collect()
    assert {(r.query, r.rank, r.song_id, r.score) for r in rows} == {(q, k, s, n) for q in ("common w3", "Common\tW3 absent") for k, s, n in ((1, "s3", 2), (2, "s0", 1))}
    above, below = plans["word-sets"].split("BroadcastHashJoin", 1)
    assert "hashpartitioning" in above and "hashpartitioning" not in below


def test_media_of_titles_without_asked_words(spark):
    """The least media id of a song counts, whichever of its titles has it."""
    asked, catalog = frames(spark, ["a"], [("s", "qq", "m2", "a b"), ("s", "qq", "m1", "c"), ("s", "qq", "m0", None), ("s", "163", "m9", "A a")])
    assert {tuple(r) for r in keyword_topk(asked, catalog, 5).collect()} == {("a", 1, "s", "163", "m9", 1), ("a", 2, "s", "qq", "m0", 1)}
