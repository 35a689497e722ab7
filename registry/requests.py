"""Message, URL, callback and configuration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import views as v
from registry.core import query, sql_view, table
from songloom.operators import requests as r

# message texts the conversations are rewritten to; the last place keeps the text as it is
_TEXTS = (
    "/翻唱 -v L.pth 晴天", "!翻唱 晴天 -v L.pth", "#说 你好 世界", "/音色列表", "/qq音乐登录  ", "/网易云音乐登录",
    "/163cookie MUSIC_U=abc; __csrf=d ", "/163logintest", "/qqlogintest ", "/翻唱 晴天", "/163cookie", "/翻唱   ",
    "/翻唱晴天", "/说  ", " /音色列表", "/翻唱 晴天 稻香", "x翻唱 -v  A.pth",
)
_N = len(_TEXTS) + 1
# command, model, query, missing, then model and query read by the literal pattern
_ROUTED = (
    ("翻唱", "L.pth", "晴天", False, "L.pth", "晴天"), ("翻唱", "L.pth", "晴天", False, "晴天", "-v L.pth"),
    ("说", "", "你好 世界", False, "", "你好 世界"), ("音色列表", "", "", False, "", ""), ("qq音乐登录", "", "", False, "", ""),
    ("网易云音乐登录", "", "", False, "", ""), ("163cookie", "", "MUSIC_U=abc; __csrf=d", False, "", "MUSIC_U=abc; __csrf=d"),
    ("163logintest", "", "", False, "", ""), ("qqlogintest", "", "", False, "", ""), ("翻唱", "", "晴天", False, "晴", "天"),
    ("163cookie", "", "", True, "", ""), ("翻唱", "", "", True, "", ""), ("翻唱", "", "晴天", False, "", "晴天"),
    ("说", "", "", True, "", ""), (None, "", "", False, "", ""), ("翻唱", "", "晴天 稻香", False, "晴天", "稻香"),
    ("翻唱", "A.pth", "", True, "A.pt", "h"), (None, "", "", False, "", ""),
)


def messages(spark, sf):
    place = F.pmod(F.col("conv_id") * 5 + F.col("turn"), F.lit(_N)).cast("int")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.coalesce(F.get(F.array(*map(F.lit, _TEXTS)), place), F.col("text")).alias("text"))


def _routed_sql(compat: bool) -> str:
    show = lambda x: "NULL" if x is None else ("true" if x is True else "false" if x is False else f"'{x}'")
    rows = ", ".join(
        f"({i}, {show(c)}, {show(m2 if compat else m)}, {show(q2 if compat else q)}, {show((q2 == '' and miss) if compat else miss)})"
        for i, (c, m, q, miss, m2, q2) in enumerate(_ROUTED))
    return f"""SELECT conv_id, turn, w.command, w.model, w.query, w.missing_arg FROM conversations
JOIN (VALUES {rows}) w(place, command, model, query, missing_arg) ON w.place = (conv_id * 5 + turn) % {_N}"""


@query("command_route", _routed_sql(False))
def command_route(spark, sf):
    return r.command_route(messages(spark, sf))


@query("command_route_compat", _routed_sql(True))
def command_route_compat(spark, sf):
    return r.command_route(messages(spark, sf), compat=True)


_WRAPPED = (("/翻唱 -v L.pth ", ""), ("!翻唱 ", " -v L.pth"), ("#说 ", ""), ("/翻唱 ", ""), ("", ""))


@query("command_route_texts", """SELECT conv_id, turn, ['翻唱', '翻唱', '说', '翻唱', NULL][k + 1] AS command,
  CASE WHEN k < 2 THEN 'L.pth' ELSE '' END AS model, CASE WHEN k < 4 THEN x ELSE '' END AS query, k < 4 AND x = '' AS missing_arg
FROM (SELECT *, (conv_id * 5 + turn) % 5 AS k, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM conversations)""")
def command_route_texts(spark, sf):
    """Every text of the conversations, with a command around it or none."""
    k = F.pmod(F.col("conv_id") * 5 + F.col("turn"), F.lit(5)).cast("int")
    side = lambda n: F.get(F.array(*[F.lit(w[n]) for w in _WRAPPED]), k)
    text = F.concat(side(0), F.trim(F.regexp_replace("text", r"\s+", " ")), side(1))
    return r.command_route(table(spark, sf, "conversations").select("conv_id", "turn", text.alias("text")))


# ends of request URLs: blank, repeated, badly typed and escaped values
_ENDS = (
    "&agg=&agg=12&trim=0", "&agg=x1&with_instrumental=true", "&auto_key=yes&auto_key_offset=two&auto_key_max=0",
    "&index_rate=0.5&protect=abc", "&sample_audio=a%20b+c.wav&trim=no&f0_up_key=-3", "&uvr_model=&filter_radius=5&trim=False",
    "&with_instrumental=TRUE&auto_key=1&auto_key_max=9", "&rms_mix_rate=.75&resample_sr=48000&spk_id=2#agg=3",
)


def param_urls(spark, sf):
    built = F.concat(F.lit("http://h.example/cover?sid=m"), "page_id", F.get(F.array(*map(F.lit, _ENDS)), F.pmod("page_id", F.lit(8)).cast("int")))
    both = F.array(F.struct((F.col("page_id") * 2).alias("request_id"), "url"), F.struct((F.col("page_id") * 2 + 1).alias("request_id"), built.alias("url")))
    return table(spark, sf, "pages").select(F.explode(both).alias("r")).select("r.*")


_ENDS_SQL = "[" + ", ".join(f"'{e}'" for e in _ENDS) + "]"
sql_view("param_urls", f"""SELECT page_id * 2 AS request_id, url FROM pages UNION ALL
SELECT page_id * 2 + 1, 'http://h.example/cover?sid=m' || page_id || {_ENDS_SQL}[page_id % 8 + 1] FROM pages""")
sql_view("param_q", "SELECT request_id, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM param_urls", ("param_urls",))


def _val(k: str) -> str:
    return f"nullif(url_decode(replace(regexp_extract(q, '(?:^|&){k}=([^&]+)', 1), '+', ' ')), '')"


def _params_sql() -> str:
    cols, bad = [], []
    for k, d in r.PARAM_TEXT.items():
        cols.append(f"coalesce({_val(k)}, '{d}') AS {k}")
    for k, d in r.PARAM_INT.items():
        cols.append(f"CASE WHEN {_val(k)} IS NULL THEN {d} ELSE TRY_CAST({_val(k)} AS BIGINT) END AS {k}")
        bad.append(f"WHEN {_val(k)} IS NOT NULL AND TRY_CAST({_val(k)} AS BIGINT) IS NULL THEN '{k}'")
    for k, d in r.PARAM_FLOAT.items():
        cols.append(f"CASE WHEN {_val(k)} IS NULL THEN CAST({d} AS DOUBLE) ELSE TRY_CAST({_val(k)} AS DOUBLE) END AS {k}")
        bad.append(f"WHEN {_val(k)} IS NOT NULL AND TRY_CAST({_val(k)} AS DOUBLE) IS NULL THEN '{k}'")
    cols.append(f"coalesce(TRY_CAST({_val('auto_key_offset')} AS BIGINT), 0) AS auto_key_offset")
    cols.append(f"greatest(1, coalesce(TRY_CAST({_val('auto_key_max')} AS BIGINT), 5)) AS auto_key_max")
    cols.append(f"coalesce({_val('trim')}, '1') NOT IN ('0', 'false', 'False', 'no') AS trim")
    for k in ("with_instrumental", "auto_key"):
        cols.append(f"coalesce({_val(k)}, '0') IN ('1', 'true', 'True', 'yes') AS {k}")
    return f"SELECT request_id, {', '.join(cols)}, CASE {' '.join(bad)} END AS bad_param FROM param_q"


@query("request_params", _params_sql(), ("param_q",))
def request_params(spark, sf):
    return r.request_params(param_urls(spark, sf))


@query("kv_extract", """SELECT split_part(p, '=', 1) AS key, count(*) AS n FROM (SELECT unnest(string_split(q, '&')) AS p FROM param_q)
WHERE regexp_matches(p, '^[^=]+=') GROUP BY 1""", ("param_q",))
def kv_extract(spark, sf):
    return r.kv_extract(param_urls(spark, sf))


def callback_lines(spark, sf):
    user = F.col("user_id").cast("string")
    link = F.concat(F.lit("https://c.example/check?uin="), user, F.when(F.pmod("event_id", F.lit(10)) == 0, "").otherwise("&ptsigx=tok"))
    call = lambda code, url="": F.concat(F.lit(f"ptuiCB('{code}','0','"), url if not isinstance(url, str) else F.lit(url), F.lit("','0','it\\'s', '')"))
    kind = F.col("event_type")
    line = (
        F.when(kind == "purchase", call("0", link)).when(kind == "error", call("65")).when(kind == "click", call("67"))
        .when(kind == "view", call("66")).when(F.pmod("event_id", F.lit(3)) == 0, F.lit("ptuiCB()"))
        .when(F.pmod("event_id", F.lit(3)) == 1, call("99")).otherwise(F.lit("busy"))
    )
    return table(spark, sf, "events").select(F.col("user_id").alias("session"), line.alias("line"))


@query("callback_state_counts", """SELECT user_id AS session,
  count(*) FILTER (WHERE event_type = 'view' OR event_type = 'signup' AND event_id % 3 = 1) AS waiting,
  count(*) FILTER (WHERE event_type = 'click') AS scanned, count(*) FILTER (WHERE event_type = 'error') AS expired,
  count(*) FILTER (WHERE event_type = 'purchase' AND event_id % 10 <> 0) AS success,
  count(*) FILTER (WHERE event_type = 'purchase' AND event_id % 10 = 0 OR event_type = 'signup' AND event_id % 3 <> 1) AS error
FROM events GROUP BY user_id""")
def callback_state_counts(spark, sf):
    return r.callback_state_counts(callback_lines(spark, sf))


@query("kv_cookie", """SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'uid=7; id= ; x' WHEN page_id % 4 = 2 THEN 'p' || page_id
  ELSE CAST(page_id AS VARCHAR) END AS value FROM pages""")
def kv_cookie(spark, sf):
    """The key is also the end of another key, in the value, blank, or missing."""
    key = F.col("page_id").cast("string")
    text = F.get(F.array(
        F.concat(F.lit("uid=5; id="), key), F.concat(F.lit("a=id=3;\tid = "), key, F.lit(" ;id=9")),
        F.concat(F.lit("p"), key), F.lit("uid=7; id= ; x"),
    ), F.pmod("page_id", F.lit(4)).cast("int"))
    return table(spark, sf, "pages").select("page_id", r.kv_value(text, "id").alias("value"))


# codes without a meaning, and no code, are still waiting
_POLLED = "CASE k WHEN 0 THEN 'expired' WHEN 2 THEN 'scanned' WHEN 3 THEN 'success' ELSE 'waiting' END"


@query("poll_states", f"SELECT {_POLLED} AS state, count(*) AS n FROM (SELECT CAST(value AS BIGINT) % 6 AS k FROM events) GROUP BY 1")
def poll_states(spark, sf):
    """Codes 800 to 803, others and none."""
    k = F.pmod(F.expr("cast(rint(value) as bigint)"), F.lit(6))
    code = F.when(k < 5, k + 800)
    return table(spark, sf, "events").select(r.poll_state(code).alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("poll_states_login", f"""SELECT event_id, CASE WHEN k = 3 AND event_id % 5 IN (2, 3, 4) THEN 'error' ELSE {_POLLED} END AS state
FROM (SELECT event_id, event_id % 4 AS k FROM events)""")
def poll_states_login(spark, sf):
    """A success needs a login value: in the cookie, in the body, blank, under another key, or not at all."""
    j = F.pmod("event_id", F.lit(5)).cast("int")
    cookie = F.when(j == 0, "x1").when(j == 2, "")
    body = F.get(F.array(F.lit(None), F.lit("a=1; MUSIC_U=x2; b"), F.lit("MUSIC_U=; a=1"), F.lit("xMUSIC_U=5"), F.lit("")), j)
    return table(spark, sf, "events").select("event_id", r.poll_state(F.pmod("event_id", F.lit(4)) + 800, cookie, body).alias("state"))


def configs(spark, sf):
    k = lambda n: F.pmod("c_custkey", F.lit(n))
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("config_id"),
        F.when(k(5) != 0, k(7) - 1).alias("auto_key_max"), (F.col("c_nationkey").cast("bigint") - 3).alias("voice_cache_retention_days"),
        F.when(k(2) == 0, k(3) * 0.25).alias("index_rate"), F.when(k(4) == 0, "qq").alias("default_platform"),
        F.when(k(6) == 0, True).alias("auto_key"), F.when(k(3) == 1, F.create_map(F.lit("m.pth"), k(7).cast("int"))).alias("model_keys"),
        F.when(k(8) == 0, "ref.wav").alias("reference_audio"),
    )


@query("config_validate", """SELECT c_custkey AS config_id, s.field, s.value, s.violation FROM customer, LATERAL (SELECT unnest([
  {'field': 'port', 'value': '7898', 'violation': NULL},
  {'field': 'auto_start', 'value': 'true', 'violation': NULL},
  {'field': 'default_model', 'value': '', 'violation': NULL},
  {'field': 'uvr_model', 'value': 'HP2_all_vocals', 'violation': NULL},
  {'field': 'uvr_weights_dir', 'value': '', 'violation': NULL},
  {'field': 'sample_audio', 'value': '', 'violation': NULL},
  {'field': 'voice_cache_dir', 'value': '', 'violation': NULL},
  {'field': 'voice_mode', 'value': 'preset', 'violation': NULL},
  {'field': 'preset_voice', 'value': 'mimo_default', 'violation': NULL},
  {'field': 'reference_audio', 'value': CASE WHEN c_custkey % 8 = 0 THEN 'ref.wav' ELSE '' END, 'violation': NULL},
  {'field': 'model_keys', 'value': CASE WHEN c_custkey % 3 = 1 THEN '{"m.pth":' || c_custkey % 7 || '}' ELSE '{}' END, 'violation': NULL},
  {'field': 'rvc_after_tts', 'value': 'true', 'violation': NULL},
  {'field': 'command_enabled', 'value': 'true', 'violation': NULL},
  {'field': 'tool_enabled', 'value': 'true', 'violation': NULL},
  {'field': 'f0_method', 'value': 'rmvpe', 'violation': NULL}, {'field': 'f0_up_key', 'value': '0', 'violation': NULL},
  {'field': 'index_rate', 'value': CASE WHEN c_custkey % 2 = 0 THEN CAST((c_custkey % 3) * 25e-2 AS VARCHAR) ELSE '0.5' END, 'violation': NULL},
  {'field': 'filter_radius', 'value': '3', 'violation': NULL}, {'field': 'resample_sr', 'value': '0', 'violation': NULL},
  {'field': 'rms_mix_rate', 'value': '0.25', 'violation': NULL}, {'field': 'protect', 'value': '0.4', 'violation': NULL},
  {'field': 'uvr_agg', 'value': '10', 'violation': NULL},
  {'field': 'auto_key', 'value': CASE WHEN c_custkey % 6 = 0 THEN 'true' ELSE 'false' END, 'violation': NULL},
  {'field': 'auto_key_offset', 'value': '0', 'violation': NULL},
  {'field': 'auto_key_max', 'value': CASE WHEN c_custkey % 5 = 0 THEN '5' ELSE CAST(c_custkey % 7 - 1 AS VARCHAR) END,
   'violation': CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 - 1 < 1 THEN 'must be >= 1' END},
  {'field': 'voice_cache_retention_days', 'value': CAST(c_nationkey - 3 AS VARCHAR), 'violation': CASE WHEN c_nationkey < 3 THEN 'must be >= 0' END},
  {'field': 'default_platform', 'value': CASE WHEN c_custkey % 4 = 0 THEN 'qq' ELSE '163' END, 'violation': NULL},
  {'field': 'search_limit', 'value': '5', 'violation': NULL}]) AS s)""")
def config_validate(spark, sf):
    return r.config_validate(configs(spark, sf))
