import json
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from songloom.functions import url_base, url_join
from songloom.operators import catalog as c
from songloom.sources import payloads as p

SONGS = "song_id string, name string, artists string, album string, platform string, media_id string"


def test_url_join_follows_url_rules(spark):
    bases = ["http://a.example/", "https://b.example/x/y/z?q=1", "http://c.example", "http://d.example/m/n/#f"]
    refs = ["f.mp3", "a/b.mp3?k=1", "/root.mp3", "../up.mp3", "../../../top", "./here", "//other.example/p", "?only=1",
            "ftp://x.example/y", "a/./b/../c.mp3", "", "dir/..", "sub/.", "#frag"]
    rows = [(b, r) for b in bases for r in refs]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", url_join(url_base(F.col("b")), F.col("r")).alias("u")).collect()
    for row in got:
        assert row.u == urljoin(row.b, row.r), (row.b, row.r)


def _payload_163(songs):
    return json.dumps({"code": 200, "result": {"songs": songs}}, ensure_ascii=False)


def test_163_payloads_are_read_defensively(spark):
    songs = [
        {"id": 1, "name": "a", "artists": [{"name": "x"}, "no", {"name": ""}, {"name": "y"}], "album": {"name": "al"}},
        "skip", 7, None, {"id": None, "name": "gone"}, {"id": 2, "name": ""}, {"id": 3},
        {"id": "4", "name": "b", "artists": {"name": "odd"}, "album": "text"},
        {"id": 5, "name": "晴天 \"q\"", "artists": [], "album": None},
    ]
    rows = [(1, _payload_163(songs)), (2, "{not json"), (3, json.dumps({"code": 200})), (4, _payload_163({"id": 9}))]
    got = p.songs_from_json_163(spark.createDataFrame(rows, "payload_id int, payload string")).collect()
    assert sorted((r.song_id, r.name, r.artists, r.album, r.platform) for r in got) == [
        ("1", "a", "x, y", "al", "163"), ("4", "b", "", "", "163"), ("5", "晴天 \"q\"", "", "", "163")]


def test_qq_fallback_keys(spark):
    songs = [
        {"mid": "m1", "name": "a", "singer": [{"name": "s"}], "album": {"name": "al"}, "file": {"media_mid": "f1"}, "strMediaMid": "no"},
        {"mid": "", "songmid": "m2", "name": "", "songname": "b", "file": {"media_mid": ""}, "strMediaMid": "f2"},
        {"songmid": "m3", "songname": "c"}, {"mid": "m4"}, {"name": "d"},
    ]
    body = json.dumps({"req_1": {"data": {"body": {"song": {"list": songs}}}}})
    got = p.songs_from_json_qq(spark.createDataFrame([(1, body)], "payload_id int, payload string")).collect()
    assert sorted(tuple(r) for r in got) == [
        ("m1", "a", "s", "al", "qq", "f1"), ("m2", "b", "", "", "qq", "f2"), ("m3", "c", "", "", "qq", "")]


def test_payload_status(spark):
    cases = [("163", {"code": 200}, "ok"), ("163", {"code": 400}, "error"), ("163", {}, "error"), ("qq", {}, "ok"),
             ("qq", {"code": 0, "req_1": {"code": 0}}, "ok"), ("qq", {"code": 1}, "error"), ("qq", {"req_1": {"code": 5}}, "error"),
             ("qq", {"code": None, "req_1": {"code": None}}, "ok")]
    df = spark.createDataFrame([(i, k, json.dumps(b)) for i, (k, b, _) in enumerate(cases)], "payload_id int, provider string, payload string")
    got = {r.payload_id: r.status for r in p.payload_status_split(df).collect()}
    assert [got[i] for i in range(len(cases))] == [w for *_, w in cases]


def test_ranking_matches_scan_of_all_pairs(spark):
    rnd = random.Random(2)
    vocab = ["love", "love", "love", "the", "the", "sun", "rain", "blue", "moon", "river", "night"]
    songs = [(f"{rnd.randrange(10**6):06d}", " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 5)))) for _ in range(300)]
    queries = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 4))) for _ in range(25)] + ["LOVE  The", "nothing here", ""]
    words = lambda t: set(t.lower().split())
    want = set()
    for q in set(queries):
        scored = sorted((-len(words(q) & words(n)), i) for i, n in songs if words(q) & words(n))
        want |= {(q, k, i, -sc) for k, (sc, i) in enumerate(scored[:4], 1)}
    qdf = spark.createDataFrame([(q,) for q in queries], "query string")
    sdf = spark.createDataFrame(songs, "song_id string, name string")
    got = c.keyword_topk(qdf, sdf, limit=4).collect()
    assert {(r.query, r.rank, r.song_id, r.score) for r in got} == want
    first = {r.query: (r.song_id, r.found) for r in c.first_hit(qdf, sdf).collect()}
    assert first["nothing here"] == (None, False) and set(first) == set(queries)
    assert {(q, s) for q, (s, f) in first.items() if f} == {(q, i) for q, k, i, _ in want if k == 1}


def test_best_url(spark):
    f = lambda q, purl: (q, purl)
    cases = {
        "abs": ([f("F000abs.flac", ""), f("M800abs.mp3", " http://x.example/a ")], ["https://s.example"], ("http://x.example/a", 2)),
        "last": ([f("F000last.flac", "old"), f("F000last.flac", "new")], ["http://s.example/b/", "https://t.example/c/"], ("https://t.example/c/new", 1)),
        "blank": ([f("F000blank.flac", "x"), f("F000blank.flac", " ")], ["http://s.example"], (None, None)),
        "plain": ([f("C400plain.m4a", "p")], ["", "http://s.example/"], ("http://s.example/p", 4)),
        "none": ([f("C400none.m4a", "p")], [], (None, None)),
        "scheme": ([f("F000scheme.flac", "ftp://bad/x"), f("M500scheme.mp3", "ok.mp3")], ["https://s.example/"], ("https://s.example/ok.mp3", 3)),
    }
    df = spark.createDataFrame([(k, "", a, s) for k, (a, s, _) in cases.items()],
                               "song_id string, media_id string, files array<struct<filename:string,purl:string>>, servers array<string>")
    assert {r.song_id: (r.url, r.rank) for r in c.best_url_by_quality(df).collect()} == {k: w for k, (_, _, w) in cases.items()}


def test_platforms_titles_candidates(spark):
    raw = [" QQ", "163", "NetEase", "网易云音乐", "QQ音乐", None, "", "x"]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    assert {r.raw: r.platform for r in c.platform_normalize(df, "QQ ").collect()} == {
        " QQ": "qq", "163": "163", "NetEase": "163", "网易云音乐": "163", "QQ音乐": "qq", None: "qq", "": "qq", "x": "qq"}
    assert {r.platform for r in c.platform_normalize(df.where("raw = 'x'"), "other").collect()} == {"163"}
    songs = spark.createDataFrame([("1", "a", "x", "", "163", ""), ("2", "a", "x", "", "qq", "M"), ("3", "a", "", "", "qq", "")], SONGS)
    assert [tuple(r) for r in c.title_collisions(songs).collect()] == [("a - x", 2, "163,qq")]
    names = {(r.song_id, r.rank): r.candidate for r in c.candidate_expand(songs).collect()}
    assert names["2", 1] == "F000M.flac" and names["1", 4] == "C4001.m4a" and len(names) == 12


def test_url_chain(spark):
    rows = [("1", " u1 ", "u2", "u3.mp3"), ("2", " ", "u2", "u3.mp3"), ("3", None, "", "h/x.ogg?y"), ("4", None, None, "h/x.OGG"), ("5", "", "", None)]
    df = spark.createDataFrame(rows, "song_id string, url_1 string, url_2 string, url_3 string")
    got = {r.song_id: (r.url, r.rank) for r in c.url_fallback_chain(df).collect()}
    assert got == {"1": ("u1", 1), "2": ("u2", 2), "3": ("h/x.ogg?y", 3), "4": (None, None), "5": (None, None)}


def test_repeated_songs_take_one_place(spark):
    songs = [("a", "love", "163")] * 5 + [("b", "love", "163"), ("c", "love me", "qq"), ("a", "Love", "qq")]
    sdf = spark.createDataFrame(songs, "song_id string, name string, platform string")
    got = c.keyword_topk(spark.createDataFrame([("love",)], "query string"), sdf).orderBy("rank").collect()
    assert [(r.song_id, r.platform) for r in got] == [("a", "163"), ("a", "qq"), ("b", "163"), ("c", "qq")]


def test_broken_answers_are_errors(spark):
    bad = ["{not json", "<html></html>", None, "[1]", "", "7"]
    df = spark.createDataFrame([(i, k, b) for i, b in enumerate(bad) for k in ("163", "qq")], "payload_id int, provider string, payload string")
    assert {r.status for r in p.payload_status_split(df).collect()} == {"error"}
