"""URL expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Extensions that mark a URL as audio, matched anywhere in it.
AUDIO_EXTENSIONS = (".mp3", ".flac", ".m4a", ".wav", ".ogg", ".aac")


def has_audio_extension(url: Column) -> Column:
    """True if any audio extension occurs in the URL (case-sensitive)."""
    names = "|".join(e.lstrip(".") for e in AUDIO_EXTENSIONS)
    return url.rlike(rf"\.({names})")


def query_value(query: Column, key: str) -> Column:
    """First non-blank value of ``key`` in a query string, decoded; null if none.

    A value with a broken escape is kept as written.
    """
    raw = F.nullif(
        F.regexp_extract(F.coalesce(query, F.lit("")), rf"(?:^|&){re.escape(key)}=([^&]+)", 1), F.lit("")
    )
    return F.coalesce(F.try_url_decode(raw), raw)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def _collapse_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        empty,
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    closing = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(empty)
    return F.concat(F.lit("/"), F.array_join(F.concat(folded, closing), "/"))


def url_base(base: Column) -> Column:
    """The parts of a base URL that joining needs, as a struct."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    return F.struct(
        base.alias("url"), origin.alias("origin"), F.concat(F.substring_index(origin, ":", 1), F.lit(":")).alias("scheme"),
        path.alias("path"), F.when(folder == "", F.lit("/")).otherwise(folder).alias("folder"),
    )


def url_join(base: Column, ref: Column) -> Column:
    """Join a reference to a base, given as :func:`url_base`, by the usual URL rules.

    Absolute references stay as they are; ``//host``, ``/rooted``, ``?query``
    and relative forms resolve against the base.
    """
    origin = base["origin"]
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    tail = F.substring(ref, F.length(ref_path) + 1, F.length(ref))
    rooted = F.when(ref.startswith("/"), ref_path).otherwise(F.concat(base["folder"], ref_path))
    dotted = ref_path.rlike(r"(^|/)\.\.?(/|$)") | base["folder"].rlike(r"/\.\.?/")
    return (
        F.when(ref == "", base["url"])
        .when(ref.startswith("#"), F.concat(F.substring_index(base["url"], "#", 1), ref))
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(ref.startswith("//"), F.concat(base["scheme"], ref))
        .when(ref_path == "", F.concat(origin, base["path"], tail))
        .when(dotted, F.concat(origin, _collapse_dots(rooted), tail))
        .otherwise(F.concat(origin, rooted, tail))
    )
