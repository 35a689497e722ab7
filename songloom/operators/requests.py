"""Parsing of chat messages, request URLs, callbacks and configurations."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from songloom.functions.columns import strip
from songloom.functions.urls import query_value, url_query

# Command patterns, in matching order.
COVER_PATTERN = r"^(?P<pfx>\S)翻唱(?:\s+(?P<model>-v\s+\S+|\S+))?\s*(?P<query>.+)$"
COMMAND_PATTERNS = {
    "翻唱": COVER_PATTERN,
    "说": r"^(?P<pfx>\S)说\s+(?P<text>.+)$",
    "音色列表": r"^(?P<pfx>\S)音色列表$",
    "qq音乐登录": r"^(?P<pfx>\S)qq音乐登录\s*$",
    "网易云音乐登录": r"^(?P<pfx>\S)网易云音乐登录\s*$",
    "163cookie": r"^(?P<pfx>\S)163cookie(?:\s+(?P<cookie>.+))?\s*$",
    "163logintest": r"^(?P<pfx>\S)163logintest\s*$",
    "qqlogintest": r"^(?P<pfx>\S)qqlogintest\s*$",
}
# Request parameter defaults and boolean spellings.
PARAM_TEXT = {
    "sid": "", "uvr_model": "HP2_all_vocals", "uvr_weights_dir": "", "sample_audio": "", "f0_method": "rmvpe",
}
PARAM_INT = {"agg": 10, "spk_id": 0, "f0_up_key": 0, "filter_radius": 3, "resample_sr": 0}
PARAM_LENIENT_INT = {"auto_key_offset": 0, "auto_key_max": 5}
PARAM_FLOAT = {"index_rate": 0.75, "rms_mix_rate": 0.25, "protect": 0.33}
TRUE_WORDS = ("1", "true", "True", "yes")
NOT_TRIM_WORDS = ("0", "false", "False", "no")
# Callback codes.
CALLBACK_NAME = "ptuiCB"
CALLBACK_CREDENTIALS = ("uin", "ptsigx")
CALLBACK_STATES = {"0": "success", "65": "expired", "67": "scanned"}
LOGIN_COOKIE = "MUSIC_U"
POLL_STATES = {800: "expired", 801: "waiting", 802: "scanned", 803: "success"}
# Configuration defaults and lower bounds.
CONFIG_DEFAULTS = {
    "port": 7898, "auto_start": True, "default_model": "", "uvr_model": "HP2_all_vocals", "uvr_weights_dir": "",
    "sample_audio": "", "voice_cache_dir": "", "voice_mode": "preset", "preset_voice": "mimo_default", "reference_audio": "",
    "model_keys": {}, "rvc_after_tts": True, "command_enabled": True,
    "tool_enabled": True,
    "f0_method": "rmvpe", "f0_up_key": 0, "index_rate": 0.5, "filter_radius": 3, "resample_sr": 0,
    "rms_mix_rate": 0.25, "protect": 0.4, "uvr_agg": 10, "auto_key": False, "auto_key_offset": 0,
    "auto_key_max": 5, "voice_cache_retention_days": 5, "default_platform": "163", "search_limit": 5,
}
CONFIG_MINIMUM = {"auto_key_max": 1, "voice_cache_retention_days": 0}

# '\n' is the only line end and \s, \S know all of Unicode
_FLAGS = "(?dU)"
# usage as documented: an optional "-v MODEL" before or after the query
_COVER_DOCUMENTED = r"^\S翻唱\s*(?:-v\s+(\S+)(?:\s+|$))?(.*?)(?:\s+-v\s+(\S+))?\s*$"


def _jvm(pattern: str) -> str:
    return _FLAGS + pattern.replace("(?P<", "(?<")


def command_route(messages: DataFrame, compat: bool = False) -> DataFrame:
    """Command, model and argument of each message; first matching pattern wins.

    ``messages(conv_id, turn, text)``. By default a cover request follows its
    documented usage (``-v MODEL`` before or after the query). ``compat=True``
    applies the literal pattern, where any first word counts as the model.
    """
    msg = F.coalesce("text", F.lit(""))
    command = F.lit(None).cast("string")
    for name, pattern in reversed(COMMAND_PATTERNS.items()):
        # every pattern is one character and the name first: most messages need no pattern
        command = F.when((F.substring(msg, 2, len(name)) == name) & msg.rlike(_jvm(pattern)), F.lit(name)).otherwise(command)

    if compat:
        model = F.regexp_extract(msg, _jvm(COVER_PATTERN), 2)
        model = F.regexp_replace(model, _FLAGS + r"^-v\s*", "")
        query = F.regexp_extract(msg, _jvm(COVER_PATTERN), 3)
    else:
        pattern = _FLAGS + _COVER_DOCUMENTED
        before, after = F.regexp_extract(msg, pattern, 1), F.regexp_extract(msg, pattern, 3)
        model = F.when(before != "", before).otherwise(after)
        query = F.regexp_extract(msg, pattern, 2)
    argument = (
        F.when(F.col("command") == "翻唱", query)
        .when(F.col("command") == "说", F.regexp_extract(msg, _jvm(COMMAND_PATTERNS["说"]), 2))
        .when(F.col("command") == "163cookie", F.regexp_extract(msg, _jvm(COMMAND_PATTERNS["163cookie"]), 2))
        .otherwise(F.lit(""))
    )
    return (
        messages.withColumn("command", command)
        .withColumn("model", F.when(F.col("command") == "翻唱", strip(model)).otherwise(F.lit("")))
        .withColumn("query", strip(argument))
        .withColumn(
            "missing_arg",
            F.coalesce(F.col("command").isin("翻唱", "说", "163cookie"), F.lit(False)) & (F.col("query") == ""),
        )
        .select("conv_id", "turn", "command", "model", "query", "missing_arg")
    )


def request_params(requests: DataFrame) -> DataFrame:
    """Typed parameters of each request URL, with defaults.

    ``requests(request_id, url)``. The first non-blank value of a key counts.
    ``bad_param`` names the first parameter that must be a number and is not;
    the two key settings fall back to their defaults instead.
    """
    names = (*PARAM_TEXT, *PARAM_INT, *PARAM_FLOAT, *PARAM_LENIENT_INT, "trim", "with_instrumental", "auto_key")
    # read each key once; the typed columns below use the result several times
    parsed = requests.withColumn("_q", url_query(F.col("url"))).select(
        "request_id", *[query_value(F.col("_q"), k).alias(f"_v_{k}") for k in names]
    )
    value = lambda k: F.col(f"_v_{k}")
    number = lambda k, t: value(k).try_cast(t)
    columns: dict[str, Column] = {}
    for k, d in PARAM_TEXT.items():
        columns[k] = F.coalesce(value(k), F.lit(d))
    bad = []
    for table, kind in ((PARAM_INT, "bigint"), (PARAM_FLOAT, "double")):
        for k, d in table.items():
            columns[k] = F.when(value(k).isNull(), F.lit(d).cast(kind)).otherwise(number(k, kind))
            bad.append(F.when(value(k).isNotNull() & number(k, kind).isNull(), F.lit(k)))
    for k, d in PARAM_LENIENT_INT.items():
        columns[k] = F.coalesce(number(k, "bigint"), F.lit(d).cast("bigint"))
    columns["auto_key_max"] = F.greatest(F.lit(1).cast("bigint"), columns["auto_key_max"])
    columns["trim"] = ~F.coalesce(value("trim"), F.lit("1")).isin(*NOT_TRIM_WORDS)
    for k in ("with_instrumental", "auto_key"):
        columns[k] = F.coalesce(value(k), F.lit("0")).isin(*TRUE_WORDS)
    return parsed.select(
        "request_id", *[c.alias(k) for k, c in columns.items()], F.coalesce(*bad).alias("bad_param")
    )


def kv_value(s: Column, key: str) -> Column:
    """Value of ``key`` in ``k=v; k=v`` text; the whole text where the key is absent or blank."""
    own = F.filter(F.split(s, ";"), lambda p: strip(F.substring_index(p, "=", 1)) == key)
    values = F.filter(
        F.transform(own, lambda p: strip(p.substr(F.instr(p, "=") + 1, F.length(p)))), lambda v: v != ""
    )
    return F.coalesce(F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0)), s)


def kv_pairs(s: Column, separator: str = "&") -> Column:
    """Array of ``{key, value}`` for each pair with a key."""
    parts = F.filter(F.split(F.coalesce(s, F.lit("")), separator), lambda p: p.rlike("^[^=]+="))
    return F.transform(
        parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_extract(p, "(?s)^[^=]+=(.*)$", 1).alias("value"))
    )


def kv_extract(urls: DataFrame) -> DataFrame:
    """How often each query-string key occurs."""
    return (
        urls.select(F.explode(kv_pairs(url_query(F.col("url")))).alias("p"))
        .groupBy(F.col("p.key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    )


def callback_args(line: Column) -> Column:
    """Quoted arguments of a login callback, in order.

    The call's text is split at its quotes, those behind an odd number of
    backslashes left out; every second part stood between two quotes.
    """
    called = F.regexp_extract(F.coalesce(line, F.lit("")), rf"{CALLBACK_NAME}\((.*)\)", 1)
    parts = F.split(called, r"(?<=(?<!\\)(?:\\\\){0,9})'")
    return F.filter(parts, lambda p, i: (i % 2 == 1) & (i + 1 < F.size(parts)))


def callback_state(args: Column) -> Column:
    """State named by the callback's first argument.

    A success must carry its two credentials in the third argument: a number and a text.
    """
    code, link = F.get(args, 0), F.coalesce(F.get(args, 2), F.lit(""))
    given = F.regexp_extract(link, "[?&](.*)$", 1)
    number, key = (query_value(given, name) for name in CALLBACK_CREDENTIALS)
    complete = F.coalesce(number.rlike("^[0-9]"), F.lit(False)) & key.isNotNull()
    named = F.create_map(*[F.lit(v) for kv in CALLBACK_STATES.items() for v in kv])
    return (
        F.when(code.isNull(), "error")
        .when((code == "0") & ~complete, "error")
        .otherwise(F.coalesce(F.try_element_at(named, code), F.lit("waiting")))
    )


def callback_state_counts(lines: DataFrame) -> DataFrame:
    """Callbacks per session and state. ``lines(session, line)``."""
    states = ("waiting", "scanned", "expired", "success", "error")
    return (
        lines.select("session", callback_args(F.col("line")).alias("_a"))
        .select("session", callback_state(F.col("_a")).alias("_s"))
        .groupBy("session").agg(*[F.count(F.when(F.col("_s") == s, 1)).alias(s) for s in states])
    )


def poll_state(code: Column, cookie: Column | None = None, body: Column | None = None) -> Column:
    """State named by the other provider's poll code; any other code, also none, is still ``waiting``.

    If ``cookie`` (the value of the login cookie) or ``body`` (a text of ``k=v; k=v``)
    is given, a success without a login value in either is an ``error``.
    """
    named = F.create_map(*[F.lit(v) for kv in POLL_STATES.items() for v in kv])
    state = F.coalesce(F.try_element_at(named, code.try_cast("int")), F.lit("waiting"))
    if cookie is None and body is None:
        return state
    login = F.lit(False)
    if cookie is not None:
        login = login | (F.coalesce(cookie, F.lit("")) != "")
    if body is not None:
        pairs = F.split(F.coalesce(body, F.lit("")), ";")
        login = login | F.exists(pairs, lambda p: (strip(F.substring_index(p, "=", 1)) == LOGIN_COOKIE) & (F.length(F.substring_index(p, "=", -1)) > 0) & p.contains("="))
    return F.when((state == "success") & ~login, "error").otherwise(state)


def config_validate(configs: DataFrame) -> DataFrame:
    """Effective value of every setting per config, and whether it breaks a bound.

    ``configs(config_id, ...)`` may leave any column out or null. A map is
    shown as JSON.
    """
    def setting(name: str, default) -> Column:
        given = name in configs.columns
        if isinstance(default, dict):
            c = F.coalesce(F.to_json(F.col(name)) if given else F.lit(None).cast("string"), F.lit(json.dumps(default)))
        else:
            c = F.coalesce(F.col(name), F.lit(default)) if given else F.lit(default)
        low = CONFIG_MINIMUM.get(name)
        broken = F.when(c < low, F.lit(f"must be >= {low}")) if low is not None else F.lit(None).cast("string")
        return F.struct(F.lit(name).alias("field"), c.cast("string").alias("value"), broken.alias("violation"))

    rows = F.array(*[setting(n, d) for n, d in CONFIG_DEFAULTS.items()])
    return configs.select("config_id", F.explode(rows).alias("r")).select("config_id", "r.*")
