"""Provider payloads (JSON text) as song rows.

Payloads are navigated defensively: a part that is missing or of another kind
counts as empty. Lists are read as arrays of raw JSON text first, so one entry
that is no object is skipped without losing its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Status code of a good payload.
OK_CODE_163 = 200


# Every part is typed as text: nested JSON then arrives as its raw text, and a
# part of an unexpected kind cannot spoil the rest of the entry.
_SONG_163 = "id string, name string, artists array<string>, album string"
_SONG_QQ = (
    "mid string, songmid string, name string, songname string, singer array<string>, album string, "
    "file string, strMediaMid string"
)


def _objects(c: Column) -> Column:
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda e: e.startswith("{"))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _either(first: Column, second: Column) -> Column:
    return F.coalesce(F.nullif(first, F.lit("")), second, F.lit(""))


def _names(people: Column) -> Column:
    named = F.transform(_objects(people), lambda a: _text(F.get_json_object(a, "$.name")))
    return F.array_join(F.filter(named, lambda n: n != ""), ", ")


def _entries(payloads: DataFrame, path: str, schema: str, song_id, name) -> DataFrame:
    """One parsed row ``s`` per song object with an id and a name at ``path``.

    Entries are parsed and filtered inside the array: a filter on the exploded
    rows would be pushed below the parse and parse every entry again.
    """
    listed = F.from_json(F.get_json_object("payload", path), "array<string>")
    parsed = F.transform(_objects(listed), lambda e: F.from_json(e, schema))
    known = F.filter(parsed, lambda s: (song_id(s) != "") & (name(s) != ""))
    return payloads.select(F.explode(known).alias("s"))


def songs_from_json_163(payloads: DataFrame) -> DataFrame:
    """Songs of the first provider. ``payloads(payload_id, payload)``."""
    song_id, name = lambda s: _text(s["id"]), lambda s: _text(s["name"])
    s = F.col("s")
    return _entries(payloads, "$.result.songs", _SONG_163, song_id, name).select(
        song_id(s).alias("song_id"), name(s).alias("name"), _names(s["artists"]).alias("artists"),
        _text(F.get_json_object(s["album"], "$.name")).alias("album"), F.lit("163").alias("platform"),
    )


def songs_from_json_qq(payloads: DataFrame) -> DataFrame:
    """Songs of the second provider, with its fallback keys and media id."""
    song_id = lambda s: _either(s["mid"], s["songmid"])
    name = lambda s: _either(s["name"], s["songname"])
    s = F.col("s")
    return _entries(payloads, "$.req_1.data.body.song.list", _SONG_QQ, song_id, name).select(
        song_id(s).alias("song_id"), name(s).alias("name"), _names(s["singer"]).alias("artists"),
        _text(F.get_json_object(s["album"], "$.name")).alias("album"), F.lit("qq").alias("platform"),
        _either(F.get_json_object(s["file"], "$.media_mid"), s["strMediaMid"]).alias("media_id"),
    )


def _is_good(provider: Column, payload: Column) -> Column:
    code = lambda path: F.get_json_object(payload, path)
    clean = lambda c: c.isNull() | (c == "0")
    # anything but a JSON object (a broken text, an error page, nothing) is no answer
    is_object = F.coalesce(F.get_json_object(payload, "$").startswith("{"), F.lit(False))
    return is_object & F.when(
        provider == "163", F.coalesce(code("$.code") == str(OK_CODE_163), F.lit(False))
    ).otherwise(clean(code("$.code")) & clean(code("$.req_1.code")))


def payload_status_split(payloads: DataFrame) -> DataFrame:
    """``ok`` or ``error`` per payload. ``payloads(payload_id, provider, payload)``."""
    good = _is_good(F.col("provider"), F.col("payload"))
    return payloads.select("payload_id", "provider", F.when(good, "ok").otherwise("error").alias("status"))


def good_payloads(payloads: DataFrame, provider: str) -> DataFrame:
    """Payloads of one provider whose status is ok."""
    return payloads.where((F.col("provider") == provider) & _is_good(F.col("provider"), F.col("payload")))
