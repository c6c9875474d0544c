import io
import json
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from codewell.api import AudioSearch, BadFormat, NotFound
from codewell.operators import postings
from codewell.sources import features, formats, readers, tags, writers
from codewell.streaming.ingest import ingest, song_stream, to_chunks


def tone(frequency, seconds=0.6, rate=22050, channels=1):
    t = np.arange(int(seconds * rate)) / rate
    x = (0.4 * np.sin(2 * np.pi * frequency * t) * 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.repeat(x, channels).tobytes())
    return out.getvalue()


def id3(**frames):
    body = b"".join(k.encode() + (len(v) + 1).to_bytes(4, "big") + b"\0\0" + b"\3" + v for k, v in frames.items())
    n = len(body)
    return b"ID3\x03\0\0" + bytes([(n >> s) & 127 for s in (21, 14, 7, 0)]) + body + b"\xff\xfb" * 50


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('link,song,artist,text\nl,A,x,"one\n\n""two"", three"\nl,B,y,\nl,"C, d",z,last\n')
    rows = readers.songs_csv(spark, str(tmp_path)).orderBy("document_id").collect()
    assert [tuple(r) for r in rows] == [(0, "A", "x", 'one\n\n"two", three'), (1, "B", "y", ""), (2, "C, d", "z", "last")]


def test_image_lines(spark, tmp_path):
    good = {"nombre_archivo": "a.jpg", "ruta_original": "p", "histograma": [1, 2.5]}
    (tmp_path / "v.jsonl").write_text("\n".join([json.dumps(good), "", "  ", "{broken", json.dumps(good | {"histograma": [1]})]) + "\n")
    ok, counts = readers.image_lines(spark, str(tmp_path / "v.jsonl"), 2)
    assert [r.histograma for r in ok.collect()] == [[1.0, 2.5]] and tuple(counts.first()) == (1, 2)
    writers.write_image_lines(ok, str(tmp_path / "out"))
    back = readers.image_lines(spark, str(tmp_path / "out"), 2)[0].collect()
    assert [(r.nombre_archivo, r.ruta_original, r.histograma) for r in back] == [("a.jpg", os.path.abspath("p"), [1.0, 2.5])]
    paths = spark.createDataFrame([("a", p, [1.0]) for p in ("/r/a.jpg", "C:\\a.jpg", "\\\\h\\a.jpg", "s3://b/a.jpg", None)], "nombre_archivo string, ruta_original string, histograma array<double>")
    writers.write_image_lines(paths, str(tmp_path / "kept"))
    kept = {r.ruta_original for r in readers.image_lines(spark, str(tmp_path / "kept"), 1)[0].collect()}
    assert kept == {"/r/a.jpg", "C:\\a.jpg", "\\\\h\\a.jpg", "s3://b/a.jpg", None}


def test_audio_files_and_tags(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.mp3").write_bytes(id3(TIT2="Canción".encode(), TPE1=b"X", TALB=b"Y", TRCK=b"3/12", TLEN=b"61500"))
    (tmp_path / "b.mp3").write_bytes(b"noise")
    (tmp_path / "c.txt").write_bytes(b"no")
    rows = {r.filename: (r.title, r.collaborators, r.album, r.track_number, r.duration_seconds, r.file_size) for r in readers.audio_files(spark, str(tmp_path)).collect()}
    assert rows["a.mp3"][:5] == ("Canción", "X", "Y", 3, 61.5) and rows["b.mp3"] == (None, None, None, None, None, 5) and len(rows) == 2
    old = b"\xff" * 40 + b"TAG" + b"T".ljust(30, b"\0") + b"A".ljust(30) + b"B".ljust(30, b"\0") + b"1999" + b"c".ljust(28, b"\0") + b"\0\x07\x01"
    assert tags.read_tags(old) == {"title": "T", "collaborators": "A", "album": "B", "track": "7"}
    assert tags.read_tags(b"ID3") == tags.read_tags(None) == {}


def test_matrices(spark, tmp_path):
    np.save(tmp_path / "p1.npy", np.ones((2, 3), np.float32))
    np.save(tmp_path / "p2.npy", np.zeros((1, 3)))
    book = readers.npy_rows(spark, str(tmp_path))
    assert [(r.word_id, r.centroid) for r in book.orderBy("word_id").collect()] == [(0, [1.0] * 3), (1, [1.0] * 3), (2, [0.0] * 3)]
    writers.export_matrix(book, str(tmp_path / "whole.npy"))
    assert np.load(tmp_path / "whole.npy").shape == (3, 3)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    assert writers.insert_if_absent(df, path, "k", "v") == {"inserted": 2, "ignored": 1, "errors": 1}
    assert writers.insert_if_absent(df.union(spark.createDataFrame([("c", 9)], df.schema)), path, "k", "v") == {"inserted": 1, "ignored": 3, "errors": 1}
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 3), ("c", 9)]
    writers.refresh(df, path)
    writers.append(df, path)
    assert spark.read.parquet(path).count() == 8


def test_index_interchange(spark, tmp_path):
    post = spark.createDataFrame([("b", 1, 2), ("a", 3, 1), ("a", 2, 5)], "term string, chunk_id int, tf int")
    packed = postings.pack(post)
    writers.write_index(packed, str(tmp_path / "i"))
    text = formats.postings_to_json(packed)
    assert {r.term: r.postings for r in text.collect()} == {"a": "[[2,5],[3,1]]", "b": "[[1,2]]"}
    assert sorted(map(tuple, postings.unpack(formats.postings_from_json(text)).collect())) == sorted(map(tuple, post.collect()))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 2
    (tmp_path / "d.json").write_text('{"x": 1.5, "y": 2}')
    assert sorted(map(tuple, formats.read_json_dict(spark, str(tmp_path / "d.json"), "term", "idf", "double").collect())) == [("x", 1.5), ("y", 2.0)]
    formats.write_json_dict(post.select("term", "tf").where("tf > 1"), "term", "tf", str(tmp_path / "e"))
    assert sorted(map(tuple, formats.read_json_lines_dict(spark, str(tmp_path / "e"), "term", "tf", "int").collect())) == [("a", 5), ("b", 2)]


def test_cepstrum():
    m = features.wav_frames(tone(440))
    assert m.shape == (1 + 13230 // features.HOP, 20) and np.isfinite(m).all()
    assert np.allclose(m, features.wav_frames(tone(440, channels=2)), atol=1e-6)
    assert features.cepstrum(np.zeros(0)) is None and features.cepstrum(np.zeros(10)).shape[1] == 20
    assert features.wav_frames(tone(440, rate=11025)).shape[1] == 20


def test_audio_search(spark):
    sounds = [(1, "a.mp3", None, tone(300)), (2, "b.mp3", "B", tone(2500)), (3, "c.mp3", "", tone(310)), (4, "d.mp3", "D", b"broken"), (5, "e.mp3", "E", None)]
    audio = spark.createDataFrame([(i, f, t, t, None, 0.0, None, bytearray(x) if x is not None else None) for i, f, t, x in sounds],
        "audio_id long, filename string, title string, collaborators string, album string, duration_seconds double, content_type string, audio_data binary")
    frames = features.extract(audio, "audio_id", "audio_data")
    assert {r.audio_id for r in frames.select("audio_id").distinct().collect()} == {1, 2, 3}
    mean = frames.where("audio_id < 3 and frame_no = 3").select((F.col("audio_id") - 1).cast("int").alias("word_id"), F.col("vector").alias("centroid"))
    engine = AudioSearch(audio, mean)
    hits = engine.search(tone(305), top_k=2)
    assert hits[0].id in ("1", "3") and hits[0].metadata["title"] == "Desconocido" and hits[0].metadata["audio_url"].endswith("/" + hits[0].id)
    assert engine.search(b"nothing") == []
    assert engine.stream(2) == (tone(2500), "audio/mpeg")
    with pytest.raises(BadFormat):
        engine.search(b"", "x.MP3")
    for missing in (5, 77):
        with pytest.raises(NotFound):
            engine.stream(missing)


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = lambda i, t: json.dumps({"document_id": i, "title": "t", "artist": "a", "text": t}) + "\n"
    (source / "1.json").write_text(line(1, "dog cat\n\nthe of\n\nsun") + line(2, None))
    run = lambda: ingest(song_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    run()
    (source / "2.json").write_text(line(3, "moon") + line(1, "dog cat\n\nthe of\n\nsun"))
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = to_chunks(spark.read.schema("document_id long, title string, artist string, text string").json(str(source))).distinct()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3
