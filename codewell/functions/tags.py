"""Small conventions of the stored media tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shown for a missing text (fixed value).
UNKNOWN = "Desconocido"
AUDIO_SUFFIXES, IMAGE_SUFFIXES = (".mp3", ".wav", ".ogg"), (".png", ".jpg", ".jpeg", ".webp")


def or_unknown(text: Column) -> Column:
    """A missing or empty text as UNKNOWN."""
    return F.when(text.isNull() | (text == ""), F.lit(UNKNOWN)).otherwise(text)


def or_zero(seconds: Column) -> Column:
    """A missing duration as 0.0."""
    return F.coalesce(seconds.cast("double"), F.lit(0.0))


def media_type(stored: Column) -> Column:
    """The stored media type, or that of MP3."""
    return F.when(stored.isNull() | (stored == ""), F.lit("audio/mpeg")).otherwise(stored)


def track_number(text: Column) -> Column:
    """``3/12`` → 3; NULL where the part before the slash is no number."""
    return F.split(text, "/")[0].try_cast("int")


def is_audio(name: Column) -> Column:
    """Accepted audio suffix, case-sensitive."""
    out = F.lit(False)
    for s in AUDIO_SUFFIXES:
        out = out | name.endswith(s)
    return out


def is_image(name: Column) -> Column:
    """Accepted image suffix in any letter case."""
    out = F.lit(False)
    for s in IMAGE_SUFFIXES:
        out = out | F.lower(name).endswith(s)
    return out


def basename(path: Column) -> Column:
    """Last part of a path of either style."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def audio_url(base: str, ident: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/audio/stream/"), ident.cast("string"))
