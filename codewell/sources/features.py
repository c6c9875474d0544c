"""Feature extraction behind one interface: bytes to a matrix of frames or descriptors.

Built in are cepstral coefficients of PCM WAV. Decoders that need other libraries (MP3, picture descriptors) are registered
under a name and run in the same Arrow stage.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Sampling rate, window of 100 ms with half overlap, coefficients (fixed values).
RATE, WINDOW, HOP, COEFFICIENTS, MELS = 22_050, 2205, 1102, 20, 128

Extractor = Callable[[bytes], "np.ndarray | None"]
REGISTRY: dict[str, Extractor] = {}


def register(name: str, extractor: Extractor) -> None:
    """Make an extractor available to extract()."""
    REGISTRY[name] = extractor


def read_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1 .. 1 and the sampling rate; channels are averaged."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(1), rate


def resample(x: np.ndarray, rate: int, to: int = RATE, zeros: int = 32) -> np.ndarray:
    """Resampling by a Kaiser-windowed sinc of ``zeros`` zero crossings a side; going down it also removes what the new rate
    cannot hold."""
    if rate == to or not len(x):
        return x
    cut = min(1.0, to / rate)
    reach = int(np.ceil(zeros / cut))
    n = max(1, round(len(x) * to / rate))
    padded, out = np.pad(x, (reach, reach + 1)), np.empty(n)
    offsets = np.arange(-reach + 1, reach + 1)
    for a in range(0, n, 20_000):
        at = np.arange(a, min(n, a + 20_000)) * (rate / to)
        whole = np.floor(at).astype(np.int64)
        t = offsets - (at - whole)[:, None]
        kernel = cut * np.sinc(cut * t) * np.i0(12.0 * np.sqrt(np.maximum(0, 1 - (t / reach) ** 2))) / np.i0(12.0)
        out[a : a + len(at)] = (padded[whole[:, None] + offsets + reach] * kernel).sum(1)
    return out


#: The mel scale (fixed values): linear up to 1000 Hz with 200/3 Hz a mel, above it 27 mels for every factor of 6.4.
MEL_HZ, MEL_BREAK, MEL_STEP = 200 / 3, 1000.0, np.log(6.4) / 27


def hz_to_mel(f: np.ndarray) -> np.ndarray:
    """Mel of frequencies."""
    f = np.asarray(f, np.float64)
    return np.where(f < MEL_BREAK, f / MEL_HZ, MEL_BREAK / MEL_HZ + np.log(np.maximum(f, MEL_BREAK) / MEL_BREAK) / MEL_STEP)


def mel_to_hz(m: np.ndarray) -> np.ndarray:
    """Frequencies of mels."""
    m = np.asarray(m, np.float64)
    return np.where(m < MEL_BREAK / MEL_HZ, m * MEL_HZ, MEL_BREAK * np.exp(MEL_STEP * (m - MEL_BREAK / MEL_HZ)))


@lru_cache(8)
def mel_filters(rate: int, size: int, bands: int) -> np.ndarray:
    """Triangular filters, equally spaced on the mel scale, of unit area."""
    edges = mel_to_hz(np.linspace(0, hz_to_mel(rate / 2), bands + 2))
    f = np.fft.rfftfreq(size, 1 / rate)
    up = (f - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


@lru_cache(8)
def cosine_basis(count: int, bands: int) -> np.ndarray:
    """Orthonormal cosine transform of type II, first ``count`` rows."""
    basis = np.cos(np.pi * np.arange(count)[:, None] * (np.arange(bands) + 0.5) / bands) * np.sqrt(2 / bands)
    basis[0] /= np.sqrt(2)
    return basis


def cepstrum(x: np.ndarray, rate: int = RATE) -> np.ndarray | None:
    """(frames, COEFFICIENTS) of mono samples; None for an empty signal."""
    if not len(x):
        return None
    padded = np.pad(x, WINDOW // 2)
    if len(padded) < WINDOW:
        padded = np.pad(padded, (0, WINDOW - len(padded)))
    frames = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(WINDOW + 1)[:-1], axis=1)) ** 2
    mel = 10 * np.log10(np.maximum(power @ mel_filters(rate, WINDOW, MELS).T, 1e-10))
    mel = np.maximum(mel, mel.max() - 80)
    return mel @ cosine_basis(COEFFICIENTS, MELS).T


def wav_frames(content: bytes) -> np.ndarray | None:
    """Cepstral frames of a PCM WAV file."""
    x, rate = read_wav(content)
    return cepstrum(resample(x, rate))


register("wav", wav_frames)


def extract(files: DataFrame, ident: str, content: str = "content", extractor: str | Extractor = "wav") -> DataFrame:
    """``(ident, frame_no, vector)``; items whose extraction fails, is None or empty give no row."""
    run_one = REGISTRY[extractor] if isinstance(extractor, str) else extractor
    kind = files.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, raw in zip(b[ident], b[content], strict=True):
                try:
                    m = None if raw is None else run_one(bytes(raw))
                except Exception:  # noqa: BLE001  one bad file must not end the load
                    m = None
                if m is not None and len(m):
                    yield pd.DataFrame({ident: key, "frame_no": np.arange(len(m), dtype=np.int32), "vector": list(np.asarray(m, np.float64))})

    return files.select(ident, content).mapInPandas(run, f"`{ident}` {kind}, frame_no int, vector array<double>")
