"""Titles, artists, albums and track numbers out of the tags at the head or end of sound files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewell.functions.tags import track_number

# Text frames of the tag standard (versions 2.3/2.4 and 2.2).
FRAMES = {"TIT2": "title", "TPE1": "collaborators", "TALB": "album", "TRCK": "track", "TLEN": "length", "TT2": "title", "TP1": "collaborators", "TAL": "album", "TRK": "track", "TLE": "length"}
_ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def _size(raw: bytes, synchsafe: bool) -> int:
    out = 0
    for byte in raw:
        out = out << (7 if synchsafe else 8) | byte
    return out


def read_tags(content: bytes | None) -> dict[str, str]:
    """Text frames by column name; an empty dictionary where there are none or they cannot be read."""
    out: dict[str, str] = {}
    if content and content[:3] == b"ID3" and len(content) > 10:
        version = content[3]
        width = 3 if version == 2 else 4
        head = 6 if version == 2 else 10
        at, end = 10, min(len(content), 10 + _size(content[6:10], True))
        while at + head < end and content[at : at + 1].isalnum():
            name = content[at : at + width].decode("latin-1")
            n = _size(content[at + width : at + 2 * width], version == 4)
            body = content[at + head : at + head + n]
            if n <= 0 or at + head + n > end:
                break
            if name in FRAMES and body and body[0] < len(_ENCODINGS):
                text = body[1:].decode(_ENCODINGS[body[0]], "replace").strip("\x00﻿ ")
                if text:
                    out.setdefault(FRAMES[name], text.replace("\x00", "; "))
            at += head + n
    if content and not out and len(content) >= 128 and content[-128:-125] == b"TAG":
        tail = content[-128:]
        for name, a, b in (("title", 3, 33), ("collaborators", 33, 63), ("album", 63, 93)):
            text = tail[a:b].split(b"\x00")[0].decode("latin-1").strip()
            if text:
                out[name] = text
        if tail[125] == 0 and tail[126]:
            out["track"] = str(tail[126])
    return out


# Fixed values of MPEG audio: kbit/s by (version 1 or not, layer), sampling rates of version 1, samples of a frame.
_KBITS = {
    (True, 1): "32 64 96 128 160 192 224 256 288 320 352 384 416 448", (True, 2): "32 48 56 64 80 96 112 128 160 192 224 256 320 384",
    (True, 3): "32 40 48 56 64 80 96 112 128 160 192 224 256 320", (False, 1): "32 48 56 64 80 96 112 128 144 160 176 192 224 256",
    (False, 2): "8 16 24 32 40 48 56 64 80 96 112 128 144 160", (False, 3): "8 16 24 32 40 48 56 64 80 96 112 128 144 160",
}
_RATES = (44_100, 48_000, 32_000)


def _frame(head: bytes) -> tuple[int, float] | None:
    """Length in bytes and seconds of the frame with this head; None where it is no head."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3)
    bits, rate = head[2] >> 4, head[2] >> 2 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or rate == 3:
        return None
    first = version == 3
    hz = _RATES[rate] >> (0 if first else 1 if version == 2 else 2)
    kbits = int(_KBITS[first, layer].split()[bits - 1])
    samples = 384 if layer == 1 else 1152 if first or layer == 2 else 576
    pad = head[2] >> 1 & 1
    size = (12_000 * kbits // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hz + pad
    return size, samples / hz


def mpeg_seconds(content: bytes | None) -> float | None:
    """Duration of an MPEG audio stream, from the heads of all its frames, whatever their bit rates; None without two frames in
    a row."""
    if not content:
        return None
    at, total, frames = 0, 0.0, 0
    if content[:3] == b"ID3" and len(content) > 10:
        at = 10 + _size(content[6:10], True)
    while 0 <= at < len(content) - 3:
        frame = _frame(content[at : at + 4])
        after = None if frame is None else _frame(content[at + frame[0] : at + frame[0] + 4])
        if frame and (frames or after or at + frame[0] == len(content)):
            at, total, frames = at + frame[0], total + frame[1], frames + 1
        elif frames and content[at : at + 3] == b"TAG":
            break
        else:
            at = content.find(b"\xff", at + 1)
    return total if frames else None


def with_tags(files: DataFrame, content: str = "content") -> DataFrame:
    """Add title, collaborators, album, track_number and duration_seconds (of the stream, else as the tags state it) to
    ``(filename, content)``."""
    kept = [c for c in files.columns]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [read_tags(c) for c in b[content]]
            texts = {k: [f.get(k) for f in found] for k in ("title", "collaborators", "album", "track", "length")}
            yield b.assign(**texts, heard=pd.Series([mpeg_seconds(c) for c in b[content]], index=b.index, dtype=object))

    tagged = files.mapInPandas(run, f"{fields}, title string, collaborators string, album string, track string, length string, heard double")
    seconds = F.coalesce("heard", F.col("length").try_cast("double") / 1000)
    return tagged.select(*kept, "title", "collaborators", "album", track_number(F.col("track")).alias("track_number"), seconds.alias("duration_seconds"))
