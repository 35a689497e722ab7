import re
import uuid

from pyspark.sql import functions as F

from songloom.operators import requests as r
from tests.conftest import SMALL


def routed(spark, texts, **options):
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string")
    rows = {x.conv_id: (x.command, x.model, x.query, x.missing_arg) for x in r.command_route(df, **options).collect()}
    return [rows[i] for i in range(len(texts))]


def test_documented_usage(spark):
    got = routed(spark, ["/翻唱 -v L.pth 晴天", "/翻唱 晴天 -v L.pth", "/翻唱 晴天", "/翻唱 a b c", "/翻唱", "翻唱 晴天", None, "/翻唱 -v L.pth"])
    assert got == [
        ("翻唱", "L.pth", "晴天", False), ("翻唱", "L.pth", "晴天", False), ("翻唱", "", "晴天", False), ("翻唱", "", "a b c", False),
        (None, "", "", False), (None, "", "", False), (None, "", "", False), ("翻唱", "L.pth", "", True)]


def test_literal_patterns_agree_with_python(spark):
    parts = ["/", "!", "", " ", "翻唱", "说", "音色列表", "163cookie", "qq音乐登录", "-v", " -v X.pth", " 晴天", "　晴 天", "\n", "  ", "x"]
    texts = [a + b + c + d for a in parts[:4] for b in parts[4:9] for c in parts[9:] for d in parts[9:]]
    got = routed(spark, texts, compat=True)
    for text, (command, model, query, _) in zip(texts, got):
        want = next((n for n, p in r.COMMAND_PATTERNS.items() if re.match(p, text)), None)
        assert command == want, text
        if want == "翻唱":
            m = re.match(r.COVER_PATTERN, text)
            assert model == re.sub(r"^-v\s*", "", (m["model"] or "").strip()).strip(), text
            assert query == m["query"].strip(), text


def test_any_one_character_may_stand_before_a_command(spark):
    texts = ["\U0001f600翻唱 晴天", "é说 x", "翻翻唱 晴天", "ab翻唱 晴天", "\u3000翻唱 晴天", "/163cookie a", "/163cookiea", "//翻唱 x"]
    want = [next((n for n, p in r.COMMAND_PATTERNS.items() if re.match(p, t)), None) for t in texts]
    assert [x[0] for x in routed(spark, texts)] == want == ["翻唱", "说", "翻唱", None, None, "163cookie", None, None]


def test_the_catalog_is_made_once(spark, tmp_path, monkeypatch):
    """Searches of both platforms, titles and answers read what was written, instead of parsing all payloads again."""
    from registry import jobs

    songs = jobs.v.songs(spark, SMALL)

    def seen(batches):
        for batch in batches:
            with open(f"{tmp_path}/{uuid.uuid4().hex}", "w") as out:
                out.write(str(batch.num_rows))
            yield batch

    monkeypatch.setattr(jobs.v, "songs", lambda spark, sf: songs.mapInArrow(seen, songs.schema))
    assert jobs.request_pipeline(spark, SMALL).where("outcome = 'resolved'").count() > 0
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == songs.count()


def test_params(spark):
    urls = {
        1: "http://h/c?sid=&sid=a&agg=x&trim=no&auto_key_max=-4", 2: "http://h/c?sid=%zz&with_instrumental=True&protect=.1",
        3: "http://h/c", 4: "http://h/c?auto_key_offset=1x&f0_up_key=%2B7&trim=0&xsid=q", 5: "http://h/c?index_rate=bad&agg=bad",
    }
    df = spark.createDataFrame(list(urls.items()), "request_id long, url string")
    got = {x.request_id: x for x in r.request_params(df).collect()}
    assert (got[1].sid, got[1].agg, got[1].bad_param, got[1].trim, got[1].auto_key_max) == ("a", None, "agg", False, 1)
    assert (got[2].sid, got[2].with_instrumental, got[2].protect) == ("%zz", True, .1)
    assert (got[3].sid, got[3].agg, got[3].trim, got[3].auto_key, got[3].index_rate, got[3].bad_param) == ("", 10, True, False, .75, None)
    assert (got[4].auto_key_offset, got[4].f0_up_key, got[4].trim, got[4].sid, got[4].bad_param) == (0, 7, False, "", None)
    assert got[5].bad_param == "agg"


def test_key_values(spark):
    df = spark.createDataFrame([("MUSIC_U=ab ; __csrf=c",), ("plain",), ("x=1; MUSIC_U=",)], "s string")
    got = [x.v for x in df.select(r.kv_value(F.col("s"), "MUSIC_U").alias("v")).collect()]
    assert got == ["ab", "plain", "x=1; MUSIC_U="]
    assert spark.range(1).select(r.kv_value(F.lit("uid=5; id=7"), "id").alias("v")).first().v == "7"


def test_callback_states(spark):
    lines = {
        "ptuiCB('66','0','','0','wait', '')": "waiting", "ptuiCB('67','0')": "scanned", "ptuiCB('65')": "expired", "ptuiCB('12')": "waiting",
        "ptuiCB('0','0','https://x/?ptsigx=t&uin=12','0')": "success", "ptuiCB('0','0','https://x/?uin=ab&ptsigx=t')": "error",
        "ptuiCB('0')": "error", "ptuiCB()": "error", "": "error", "ptuiCB('it\\'s','0')": "waiting",
    }
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    got = {x.line: x.s for x in df.select("line", r.callback_state(r.callback_args(F.col("line"))).alias("s")).collect()}
    assert got == lines


def test_config_bounds(spark):
    df = spark.createDataFrame([(1, 0, None), (2, None, -1), (3, 1, 0)], "config_id long, auto_key_max long, voice_cache_retention_days long")
    got = {(x.config_id, x.field): (x.value, x.violation) for x in r.config_validate(df).collect()}
    assert got[1, "auto_key_max"] == ("0", "must be >= 1") and got[2, "auto_key_max"] == ("5", None)
    assert got[2, "voice_cache_retention_days"] == ("-1", "must be >= 0") and got[3, "voice_cache_retention_days"] == ("0", None)
    assert got[1, "index_rate"] == ("0.5", None) and len(got) == 3 * len(r.CONFIG_DEFAULTS)
