"""Column expressions: all run inside the JVM."""

from songloom.functions.columns import (
    blank_to_null,
    clamp,
    half_even,
    micros,
    r6,
    strip,
    text,
)
from songloom.functions.hashing import hash33
from songloom.functions.urls import has_audio_extension, query_value, url_base, url_join

__all__ = [
    "blank_to_null", "clamp", "half_even", "micros", "r6", "strip", "text",
    "hash33", "has_audio_extension", "query_value", "url_base", "url_join",
]
