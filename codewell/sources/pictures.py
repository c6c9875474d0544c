"""Pictures: decoding to gray, resizing, and keypoint descriptors of 128 numbers.

Decoded are PNG (not interlaced) and binary PGM/PPM; other formats are registered with their decoder. Keypoints are extrema of
differences of Gaussian blurs over octaves of the picture; a descriptor holds gradient histograms of 4 x 4 cells by 8
directions, turned by the keypoint's main direction, of length 1 with its values bounded. Everything is array arithmetic, one
picture at a time, in the Arrow stage of ``features.extract``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np

from codewell.sources.features import register

#: Blurs of an octave, first blur, least contrast, largest ratio of curvatures, descriptors of a picture.
STEPS, SIGMA, CONTRAST, EDGE, MOST = 3, 1.6, 0.03, 10.0, 500
DECODERS: list[tuple[bytes, Callable[[bytes], np.ndarray]]] = []
_GRAY = np.array([0.299, 0.587, 0.114])  # fixed values: share of red, green and blue in gray


def register_decoder(magic: bytes, decode: Callable[[bytes], np.ndarray]) -> None:
    """Decode contents that begin with ``magic``; the decoder gives (rows, columns) of 0 .. 1."""
    DECODERS.append((magic, decode))


def decode(content: bytes | None) -> np.ndarray | None:
    """Gray picture (rows, columns) of 0 .. 1; None where it cannot be read."""
    for magic, read in DECODERS if content else ():
        if content.startswith(magic):
            try:
                return read(content)
            except (ValueError, IndexError, KeyError, zlib.error):
                return None
    return None


def _gray(x: np.ndarray, most: int) -> np.ndarray:
    """Channels to gray; a channel of opacity is left out."""
    x = x.astype(np.float64) / most
    return x[..., 0] if x.shape[-1] < 3 else x[..., :3] @ _GRAY


def read_png(content: bytes) -> np.ndarray:
    """PNG of any colour type and depth that is not interlaced."""
    at, data, palette, head = 8, b"", None, None
    while at + 8 <= len(content):
        n, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = (int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), body[8], body[9], body[12])
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    if head is None or head[4]:
        raise ValueError("no header, or interlaced")
    width, height, depth, colour, _ = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    line, step = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, line + 1)
    rows, above = np.zeros((height, line), np.uint8), np.zeros(line, np.int64)
    for y in range(height):
        above = _unfilter(int(raw[y, 0]), raw[y, 1:].astype(np.int64), above, step)
        rows[y] = above
    if depth == 16:
        values = rows.reshape(height, -1, 2).astype(np.int64) @ np.array([256, 1])
    elif depth == 8:
        values = rows
    else:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        values = (bits @ (1 << np.arange(depth)[::-1]))[:, : width * channels]
    values = values.reshape(height, width, channels)
    return _gray(palette[values[..., 0]], 255) if colour == 3 else _gray(values, (1 << depth) - 1)


def _unfilter(kind: int, x: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One line of a PNG from its differences."""
    if kind == 0:
        return x
    if kind == 2:
        return (x + above) & 255
    if kind == 1:
        pad = -len(x) % step
        return np.cumsum(np.pad(x, (0, pad)).reshape(-1, step), axis=0).ravel()[: len(x)] & 255
    out, up = [0] * step, [0] * step + above.tolist()
    for i, v in enumerate(x.tolist()):
        left, top, corner = out[i], up[i + step], up[i]
        if kind == 3:
            guess = (left + top) // 2
        else:
            p = left + top - corner
            guess = min((abs(p - left), 0, left), (abs(p - top), 1, top), (abs(p - corner), 2, corner))[2]
        out.append((v + guess) & 255)
    return np.array(out[step:], np.int64)


def read_pnm(content: bytes) -> np.ndarray:
    """Binary PGM or PPM."""
    head = re.match(rb"P([56])(?:\s+#[^\n]*)*\s+(\d+)(?:\s+#[^\n]*)*\s+(\d+)(?:\s+#[^\n]*)*\s+(\d+)\s", content)
    if head is None:
        raise ValueError("no header")
    kind, width, height, most = map(int, head.groups())
    values = np.frombuffer(content, ">u2" if most > 255 else np.uint8, width * height * (3 if kind == 6 else 1), head.end())
    return _gray(values.reshape(height, width, -1), most)


register_decoder(b"\x89PNG\r\n\x1a\n", read_png)
register_decoder(b"P5", read_pnm)
register_decoder(b"P6", read_pnm)


def resize(x: np.ndarray, height: int = 256, width: int = 256) -> np.ndarray:
    """Bilinear, pixels taken at their centres."""
    for axis, n in ((0, height), (1, width)):
        at = np.clip((np.arange(n) + 0.5) * x.shape[axis] / n - 0.5, 0, x.shape[axis] - 1)
        low = np.floor(at).astype(int)
        share = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        x = np.take(x, low, axis) * (1 - share) + np.take(x, np.minimum(low + 1, x.shape[axis] - 1), axis) * share
    return x


def blur(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, edges continued."""
    reach = max(1, round(4 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded = np.pad(x, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        x = np.lib.stride_tricks.sliding_window_view(padded, len(kernel), axis=axis) @ kernel
    return x


def keypoints(octave: list[np.ndarray]) -> list[tuple[float, int, int, int]]:
    """``(contrast, blur, row, column)`` of the extrema of an octave's differences that are no edges."""
    d = np.stack([b - a for a, b in zip(octave, octave[1:], strict=False)])
    if min(d.shape[1:]) < 3:
        return []
    around = np.lib.stride_tricks.sliding_window_view(d, (3, 3, 3)).reshape(*(n - 2 for n in d.shape), 27)
    mid = d[1:-1, 1:-1, 1:-1]
    extreme = (np.abs(mid) >= CONTRAST / STEPS) & ((mid >= around.max(-1)) | (mid <= around.min(-1)))
    out = []
    for s, y, x in np.argwhere(extreme) + 1:
        p = d[s]
        xx, yy = p[y, x + 1] + p[y, x - 1] - 2 * p[y, x], p[y + 1, x] + p[y - 1, x] - 2 * p[y, x]
        xy = (p[y + 1, x + 1] - p[y + 1, x - 1] - p[y - 1, x + 1] + p[y - 1, x - 1]) / 4
        det = xx * yy - xy * xy
        if det > 0 and (xx + yy) ** 2 * EDGE < (EDGE + 1) ** 2 * det:
            out.append((float(abs(p[y, x])), int(s), int(y), int(x)))
    return out


def describe(x: np.ndarray, row: int, column: int, sigma: float) -> np.ndarray:
    """Descriptor of one keypoint of a blurred picture."""
    dy, dx = np.gradient(x)
    reach = int(np.ceil(3 * sigma * 2.5 * np.sqrt(2)))
    y, c = np.mgrid[max(0, row - reach) : min(x.shape[0], row + reach + 1), max(0, column - reach) : min(x.shape[1], column + reach + 1)]
    gy, gx = dy[y, c], dx[y, c]
    size, angle, far = np.hypot(gy, gx), np.arctan2(gy, gx), (y - row) ** 2 + (c - column) ** 2
    turns = np.bincount(((angle / (2 * np.pi) * 36).round().astype(int) % 36).ravel(), (size * np.exp(-far / (4.5 * sigma * sigma))).ravel(), 36)
    main = turns.argmax() / 36 * 2 * np.pi
    across = ((c - column) * np.cos(main) + (y - row) * np.sin(main)) / (3 * sigma) + 1.5
    down = (-(c - column) * np.sin(main) + (y - row) * np.cos(main)) / (3 * sigma) + 1.5
    part = ((angle - main) / (2 * np.pi) * 8) % 8
    weight = size * np.exp(-((across - 1.5) ** 2 + (down - 1.5) ** 2) / 8)
    out = np.zeros((4, 4, 8))
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):  # each gradient is shared among the nearest cells and directions
                v, h, o = np.floor(down).astype(int) + i, np.floor(across).astype(int) + j, np.floor(part).astype(int) + k
                share = weight * np.maximum(0, 1 - abs(down - v)) * np.maximum(0, 1 - abs(across - h)) * np.maximum(0, 1 - abs(part - o))
                inside = (v >= 0) & (v < 4) & (h >= 0) & (h < 4)
                np.add.at(out, (v[inside], h[inside], o[inside] % 8), share[inside])
    flat = out.ravel()
    flat = np.minimum(flat / max(np.linalg.norm(flat), 1e-12), 0.2)
    return flat / max(np.linalg.norm(flat), 1e-12)


def descriptors(gray: np.ndarray, most: int = MOST) -> np.ndarray | None:
    """(keypoints, 128) of the ``most`` keypoints of highest contrast; None where there is none."""
    found, base = [], blur(gray, SIGMA)
    for o in range(8):
        if min(base.shape) < 16:
            break
        octave = [base]
        for s in range(1, STEPS + 3):
            before, now = SIGMA * 2 ** ((s - 1) / STEPS), SIGMA * 2 ** (s / STEPS)
            octave.append(blur(octave[-1], (now * now - before * before) ** 0.5))
        found += [(contrast, octave[s], SIGMA * 2 ** (s / STEPS), y, x) for contrast, s, y, x in keypoints(octave)]
        base = octave[STEPS][::2, ::2]
    found = sorted(found, key=lambda f: -f[0])[:most]
    return np.stack([describe(layer, y, x, sigma) for _, layer, sigma, y, x in found]) if found else None


def picture_descriptors(content: bytes) -> np.ndarray | None:
    """Descriptors of a picture file brought to 256 x 256."""
    gray = decode(content)
    return None if gray is None or not gray.size else descriptors(resize(gray))


register("picture", picture_descriptors)
