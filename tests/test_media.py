import io
import json
import os
import struct
import zlib

import numpy as np
import pytest

from codewell.api import Engines, ImageSearch, NotFound, TextSearch
from codewell.operators import quantize
from codewell.plans.interchange import tone
from codewell.server import application
from codewell.sources import features, pictures
from codewell.sources.tags import mpeg_seconds


def png(x, colour, depth=8, kinds=(0, 1, 2, 3, 4)):
    """A PNG of (rows, columns, channels), lines filtered in turn by all kinds."""
    h, w, c = x.shape
    rows = x.astype(">u2").view(np.uint8).reshape(h, -1) if depth == 16 else x.astype(np.uint8).reshape(h, -1)
    step, above, out = c * depth // 8, np.zeros(rows.shape[1], int), b""
    for y in range(h):
        line, kind = rows[y].astype(int), kinds[y % len(kinds)]
        left, corner = (np.concatenate([np.zeros(step, int), v[:-step]]) for v in (line, above))
        p = left + above - corner
        d = np.abs(np.stack([p - left, p - above, p - corner]))
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above, corner))
        out += bytes([kind]) + ((line - (0 * line, left, above, (left + above) // 2, paeth)[kind]) % 256).astype(np.uint8).tobytes()
        above = line
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + part(b"IDAT", zlib.compress(out)) + part(b"IEND", b"")


def scene(size=96, turn=0):
    """Blobs of some sizes on a gray ground."""
    y, x = np.mgrid[:size, :size]
    out = np.full((size, size), 0.4)
    for cy, cx, r, v in ((25, 30, 4, 0.5), (60, 62, 7, -0.3), (30, 70, 5, 0.4), (70, 22, 3, 0.5)):
        out += v * np.exp(-((y - cy) ** 2 + (x - cx) ** 2 * 1.7) / (2 * r * r))
    return np.rot90(np.clip(out, 0, 1), turn)


def test_png_and_pnm_round_trip():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (11, 7, 3))
    gray = x @ np.array([0.299, 0.587, 0.114]) / 255
    assert np.allclose(pictures.decode(png(x, 2)), gray)
    assert np.allclose(pictures.decode(png(np.concatenate([x, x[..., :1]], 2), 6)), gray)
    assert np.allclose(pictures.decode(png(x[..., :1], 0)), x[..., 0] / 255)
    deep = rng.integers(0, 65536, (6, 5, 1))
    assert np.allclose(pictures.decode(png(deep, 0, 16)), deep[..., 0] / 65535)
    assert np.allclose(pictures.decode(b"P6 # c\n7 11\n255\n" + x.astype(np.uint8).tobytes()), gray)
    assert pictures.decode(b"P5 9 9 255\nxx") is None and pictures.decode(b"\xff\xd8jpeg") is None and pictures.decode(None) is None
    assert pictures.decode(png(x, 2)[:60]) is None


def test_resize():
    x = np.arange(12.0).reshape(3, 4)
    assert np.allclose(pictures.resize(x, 3, 4), x) and np.allclose(pictures.resize(x, 6, 8).mean(), x.mean())
    assert pictures.resize(x, 1, 1).shape == (1, 1)


def test_descriptors_follow_a_turn_of_the_picture():
    a, b = pictures.descriptors(scene()), pictures.descriptors(scene(turn=1))
    assert a.shape[1] == 128 and len(a) >= 4 and np.allclose((a * a).sum(1), 1)
    assert (a @ b.T).max(1).mean() > 0.9
    assert pictures.descriptors(np.full((64, 64), 0.5)) is None
    assert len(pictures.descriptors(scene(), most=2)) == 2


def test_resampling_keeps_tones_and_removes_what_does_not_fit():
    t = np.arange(44_100) / 44_100
    low, high = np.sin(2 * np.pi * 3000 * t), np.sin(2 * np.pi * 15_000 * t)
    back = features.resample(low + high, 44_100)
    want = np.sin(2 * np.pi * 3000 * np.arange(len(back)) / 22_050)
    assert len(back) == 22_050 and np.abs(back - want)[200:-200].max() < 1e-4
    up = features.resample(np.sin(2 * np.pi * 500 * np.arange(8000) / 8000), 8000)
    assert np.abs(up - np.sin(2 * np.pi * 500 * np.arange(len(up)) / 22_050))[400:-400].max() < 1e-4


def test_cepstrum_of_a_tone():
    # independent computation by formula at 22.05 kHz
    want = [-484.6643, 25.2139, 18.8940, 9.5178, -1.3810, -12.0224]
    assert np.abs(features.wav_frames(tone())[4:15, :6] - want).max() < 1e-3
    assert np.allclose(features.hz_to_mel([500, 1000, 6400]), [7.5, 15, 42]) and np.allclose(features.mel_to_hz([7.5, 15, 42]), [500, 1000, 6400])


def test_mpeg_duration():
    frame = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)  # version 1, layer 3, 128 kbit/s, 44.1 kHz: 417 bytes, 1152 samples
    other = bytes([0xFF, 0xFB, 0xA0, 0x00]) + bytes(518)  # 160 kbit/s
    tag = b"ID3\x03\x00\x00\x00\x00\x00\x0a" + bytes(10)
    assert mpeg_seconds(tag + frame * 10 + other * 5 + b"TAG" + bytes(125)) == pytest.approx(15 * 1152 / 44_100)
    assert mpeg_seconds(b"no sound") is None and mpeg_seconds(None) is None and mpeg_seconds(b"\xff\xfb") is None


def test_minibatch_codebook_from_a_table(spark):
    rng = np.random.default_rng(3)
    rows = [([float(v) for v in rng.normal(c, 0.05, 3)],) for c in (0, 5, 9) for _ in range(60)] + [(None,), ([float("nan")] * 3,)]
    df = spark.createDataFrame(rows, "vector array<double>")
    found = sorted(np.round(r.centroid[0]) for r in quantize.fit_minibatch(df, 6, batches=4).collect())
    assert set(found) <= {0.0, 5.0, 9.0} and len(found) == 6
    assert quantize.fit_minibatch(df.limit(2), 6).count() == 0


def ask(app, method, path, body=b"", kind="", query=""):
    said = []
    env = {"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query, "CONTENT_TYPE": kind, "CONTENT_LENGTH": str(len(body)), "wsgi.input": io.BytesIO(body)}
    out = b"".join(app(env, lambda status, headers: said.extend([int(status[:3]), dict(headers)["Content-Type"]])))
    return said[0], out, said[1]


def upload(name, filename, content):
    body = b'--B\r\nContent-Disposition: form-data; name="' + name.encode() + b'"; filename="' + filename.encode() + b'"\r\nContent-Type: application/octet-stream\r\n\r\n' + content + b"\r\n--B--\r\n"
    return {"body": body, "kind": "multipart/form-data; boundary=B"}


def test_server(spark, tmp_path):
    meta = spark.createDataFrame([(0, 0, "A", "x", "dog cat dog"), (1, 1, "B", None, "moon star"), (1, 1, "B", None, "moon star")], "chunk_id long, document_id long, title string, artist string, text string")
    file = tmp_path / "a.png"
    content = png((scene() * 255)[..., None], 0)
    file.write_bytes(content)
    book = spark.createDataFrame([(k, [float(v) for v in np.eye(128)[k * 40]]) for k in range(3)], "word_id int, centroid array<double>")
    probe = ImageSearch(spark.createDataFrame([], "id int, nombre_archivo string, ruta_original string, histograma_visual array<float>"), book, pictures.picture_descriptors, 3).histogram(content)
    assert sum(probe) >= 4
    images = spark.createDataFrame([(1, "a.png", str(tmp_path / "x" / ".." / "a.png"), probe), (2, "b.png", "/no/such.png", [1.0, 0.0, 0.0])], "id int, nombre_archivo string, ruta_original string, histograma_visual array<float>")
    app = application(Engines(text=lambda: TextSearch(meta), image=lambda: ImageSearch(images, book, pictures.picture_descriptors, 3), audio=lambda: 1 / 0))
    status, body, kind = ask(app, "POST", "/search/text", b"query_text=moon+zebra", "application/x-www-form-urlencoded", "top_k=3")
    assert status == 200 and kind == "application/json" and [(r["id"], r["dataset_type"], r["metadata"]["title"]) for r in json.loads(body)] == [("1", "letra", "B")]
    assert ask(app, "POST", "/search/text", b"a=1", "application/x-www-form-urlencoded")[0] == 422
    assert ask(app, "POST", "/search/text", b"query_text=moon", "application/x-www-form-urlencoded", "top_k=x")[0] == 422
    assert ask(app, "POST", "/search/audio", **upload("query_audio", "q.wav", b"x"))[0] == 503
    status, body, _ = ask(app, "POST", "/search/image", **upload("query_image", "Q.PNG", content))
    assert status == 200 and json.loads(body)[0]["id"] == "1" and json.loads(body)[0]["score"] == 1.0
    assert ask(app, "POST", "/search/image", **upload("query_image", "q.gif", content))[0] == 400
    assert ask(app, "GET", "/imagen/render/1") == (200, content, "image/jpeg")
    assert ask(app, "GET", "/imagen/render/2")[0] == ask(app, "GET", "/imagen/render/9")[0] == ask(app, "GET", "/nothing")[0] == 404
    with pytest.raises(NotFound):
        ImageSearch(images).render(2)
    assert os.path.exists(file)
