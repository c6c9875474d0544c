"""Sources and sinks as queries: each writes its form into a scratch folder and answers from what is read back."""

from __future__ import annotations

import io
import math
import struct
import wave

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewell.api import ImageSearch, TextSearch
from codewell.functions.text import LINE_ENDS, tokens
from codewell.functions.vectors import is_usable
from codewell.operators import numbering, postings, quantize
from codewell.plans.loading import _CENTROIDS, _ITEMS, _NEAR, DIM, label_centroids
from codewell.plans.retrieval import _BOOK, _CHUNKS, _LINES, _STORED, _TOKENS, QUERY, _ask
from codewell.runtime import scratch, spread, table
from codewell.sources import features, formats, readers, writers

#: Terms of the look-up in the sorted index.
TERMS = ("love", "night", "river", "zzyzzx")


def songs_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs written as CSV with line ends and quotes inside fields, read by column name; ids follow file order."""
    docs = table(spark, sf_dir, "documents").select(F.col("title").alias("song"), "text", F.col("source").alias("artist"), F.lit("x").alias("other"))
    path = scratch(spark)
    docs.where("text is not null and text <> ''").write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n")
    songs = readers.songs_csv(spark, path)
    whole = songs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("n_ids"), F.min("document_id").alias("least"), F.max("document_id").alias("largest"))
    stats = songs.agg(F.sum(F.length("text")).alias("n_chars"), F.count(F.when(F.col("text").contains("\n"), 1)).alias("n_with_lines"), F.countDistinct("artist").alias("n_artists"))
    return whole.crossJoin(stats)  # one row each


def picture_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picture lines written as JSON, with blank and broken lines among them: good lines and errors."""
    path = scratch(spark)
    writers.write_image_lines(table(spark, sf_dir, "vectores_fashion"), path)
    broken = spark.createDataFrame([("",), ("   ",), ("{",), ('{"nombre_archivo": "x.jpg", "histograma": [1, 2]}',)], "value string")
    broken.coalesce(1).write.mode("append").text(path)
    good, counted = readers.image_lines(spark, path, DIM)
    return counted.crossJoin(good.agg(F.countDistinct("nombre_archivo").alias("n_files")))  # one row each


def metadata_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs written as JSON lines and read with their schema."""
    path = scratch(spark)
    writers.write_json_lines(table(spark, sf_dir, "metadata").distinct(), path)
    return readers.metadata_jsonl(spark, path).select("chunk_id", "document_id", "title", "artist", F.length("text").alias("n_chars"))


def processed_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every paragraph written as JSON lines and read back."""
    path = scratch(spark)
    meta = table(spark, sf_dir, "metadata").where("chunk_id is not null").dropDuplicates(["chunk_id"])
    tokened = meta.select("chunk_id", "document_id", tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    writers.write_json_lines(tokened, path)
    return readers.processed_jsonl(spark, path).select("chunk_id", "document_id", F.array_join("tokens", " ").alias("tokens"))


def json_dict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest idf of every term as a dictionary in JSON and back."""
    path = scratch(spark)
    idf = table(spark, sf_dir, "term_index").where("term is not null and idf_value is not null").groupBy("term").agg(F.max_by("idf_value", "segment_no").alias("idf"))
    formats.write_json_dict(idf, "term", "idf", path)
    return formats.read_json_lines_dict(spark, path, "term", "idf", "double").select("term", F.round("idf", 6).alias("idf"))


def sorted_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of some terms out of an index file in term order; the terms are pushed to the scan."""
    path = scratch(spark)
    index = table(spark, sf_dir, "term_index").where("term is not null and postings is not null")
    writers.write_index(index.select("term", "segment_no", "postings"), path)
    found = postings.unpack(spark.read.parquet(path).where(F.col("term").isin(*TERMS))).where("chunk_id is not null and tf is not null")
    return found.groupBy("term", "chunk_id").agg(F.max("tf").alias("tf"))


def offset_dictionary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the offset dictionary of an index written as JSON lines, per term."""
    path = scratch(spark)
    index = table(spark, sf_dir, "term_index").where("term is not null and postings is not null")
    writers.write_json_lines(formats.postings_to_json(index.select("term", "postings")), path)
    return formats.offset_dictionary(spark, path).groupBy("term").agg(F.count(F.lit(1)).alias("n_rows"))


def insert_if_absent_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An insert-if-absent load run twice: counters of both runs and rows in the end."""
    path = scratch(spark)
    writers.refresh(table(spark, sf_dir, "fashion_images").where("nombre_archivo is not null").select("nombre_archivo", "ruta_original").dropDuplicates(["nombre_archivo"]), path)
    lines = table(spark, sf_dir, "vectores_fashion").select("nombre_archivo", "ruta_original")
    runs = [writers.insert_if_absent(lines, path, "nombre_archivo", "ruta_original") for _ in range(2)]
    end = spark.read.parquet(path)
    rows = [(i, r["inserted"], r["ignored"], r["errors"]) for i, r in enumerate(runs)]
    counters = spark.createDataFrame(rows, "run int, inserted long, ignored long, errors long")
    return counters.crossJoin(end.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("nombre_archivo").alias("n_files")))  # one row


def append_refresh_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms written with few rows a file, replaced, and appended to."""
    path = scratch(spark)
    norms = table(spark, sf_dir, "doc_norms")
    writers.refresh(norms, path, 500)
    writers.refresh(norms.where("norm_value is not null"), path, 500)
    writers.append(norms.where("norm_value is null"), path)
    return spark.read.parquet(path).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("norm_value"), 6).alias("norm_value"))


def matrix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codebook written as rows of a matrix file and read back by row number."""
    path = scratch(spark)
    book = label_centroids(spark, sf_dir)
    raw = io.BytesIO()
    np.save(raw, quantize.codebook_matrix(book)[1])
    writers.write_files(spark, {"codebook.npy": raw.getvalue()}, path)
    flat = readers.npy_rows(spark, path).select("word_id", F.posexplode("centroid").alias("i", "x"))
    return flat.select("word_id", "i", F.round("x", 6).alias("x"))


def tagged(seconds_frames: int, **texts: str) -> bytes:
    """A sound file: text frames of a tag, then so many silent frames of MPEG audio."""
    body = b"".join(name.encode() + (len(t.encode()) + 1).to_bytes(4, "big") + b"\0\0\3" + t.encode() for name, t in texts.items())
    head = b"ID3\x03\0\0" + bytes(len(body) >> 7 * k & 127 for k in (3, 2, 1, 0)) + body if texts else b""
    return head + (b"\xff\xfb\x90\x00" + bytes(413)) * seconds_frames


def tagged_audio_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound files in folders with their tags and durations; other files are left alone."""
    path = scratch(spark)
    files = {"a.mp3": tagged(10, TIT2="Canción", TPE1="Ana; Luis", TALB="Uno", TRCK="3/12"), "deep/b.mp3": tagged(5), "c.mp3": b"noise", "d.txt": b"no sound"}
    writers.write_files(spark, files, path)
    return readers.audio_files(spark, path).select("filename", "file_size", "title", "collaborators", "album", "track_number", F.round("duration_seconds", 6).alias("duration_seconds"))


def text_facade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query through the search facade."""
    hits = TextSearch(table(spark, sf_dir, "metadata")).search(QUERY, 5)
    rows = [(i, h.id, h.dataset_type, round(h.score, 6), h.metadata["title"], h.metadata["artist"]) for i, h in enumerate(hits, 1)]
    return spark.createDataFrame(rows, "place int, id string, dataset_type string, score double, title string, artist string")


def picture_facade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures like the first usable one through the search facade, with the stored path of each."""
    images = table(spark, sf_dir, "fashion_images")
    first = images.where(is_usable(F.col("histograma_visual"), DIM)).orderBy("id").select("histograma_visual").first()
    engine = ImageSearch(images, dim=DIM)
    hits = engine.search_vector(list(first[0]), 5) if first else []
    rows = [(i, h.id, h.dataset_type, h.score, h.metadata["nombre_archivo"], h.metadata["ruta_original"]) for i, h in enumerate(hits, 1)]
    return spark.createDataFrame(rows, "place int, id string, dataset_type string, score double, nombre_archivo string, ruta_original string")


def tone(hz: float = 440.0, seconds: float = 1.0, rate: int = 44_100) -> bytes:
    """A tone as 16-bit mono WAV."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"".join(struct.pack("<h", round(16_000 * math.sin(2 * math.pi * hz * k / rate))) for k in range(int(seconds * rate))))
    return out.getvalue()


def audio_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First cepstral coefficients of the inner frames of a tone at 44.1 kHz, brought to 22.05 kHz; a broken file gives no row."""
    files = spark.createDataFrame([(1, bytearray(tone())), (2, bytearray(b"RIFF")), (3, None)], "audio_id int, content binary")
    frames = features.extract(files, "audio_id").where("frame_no between 4 and 14")
    return frames.select("audio_id", "frame_no", F.posexplode(F.slice("vector", 1, 6)).alias("coefficient", "x")).select("audio_id", "frame_no", "coefficient", F.round("x", 2).alias("x"))


def minibatch_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codebook trained batch by batch from a table, and how many vectors are nearest to each word."""
    frames = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    book = quantize.fit_minibatch(frames.select("vector"), 16, batches=8)
    return quantize.assign(frames, book, keep=("vec_id",)).groupBy("word_id").agg(F.count(F.lit(1)).alias("n"))


def text_chunks_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that holds a token as a chunk, densely numbered in document and line order."""
    lines = F.split("text", f"\r\n|[{LINE_ENDS}]", -1)
    docs = spread(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")).select("doc_id", F.posexplode(lines).alias("pos", "chunk"))
    return numbering.number_rows(docs.where(F.size(tokens(F.col("chunk"))) > 0), ["doc_id", "pos"], "chunk_id").select("chunk_id", "doc_id", "pos", "chunk")


QUERIES = {f.__name__: f for f in (
    songs_csv_scan, picture_lines_scan, metadata_lines_scan, processed_lines_scan, json_dict_scan, sorted_index_lookup, offset_dictionary_scan, insert_if_absent_run,
    append_refresh_run, matrix_scan, audio_frames, minibatch_codebook, text_chunks_by_line, tagged_audio_scan, text_facade, picture_facade,
)}

# The tone's coefficients by an independent computation: the tone at 22.05 kHz by formula, direct transforms.
_TONE = (-484.66, 25.21, 18.89, 9.52, -1.38, -12.02)
_NEW = "nombre_archivo NOT IN (SELECT nombre_archivo FROM fashion_images WHERE nombre_archivo IS NOT NULL)"
SQL = {
    "songs_csv_scan": """SELECT count(*) AS n, count(*) AS n_ids, CAST(0 AS BIGINT) AS least, count(*) - 1 AS largest, CAST(sum(length(text)) AS BIGINT) AS n_chars,
  count(*) FILTER (contains(text, chr(10))) AS n_with_lines, count(DISTINCT nullif(source, '')) AS n_artists FROM documents WHERE text <> ''""",
    "picture_lines_scan": f"""SELECT count(*) FILTER (len(histograma) = {DIM}) AS n_ok, count(*) - count(*) FILTER (len(histograma) = {DIM}) + 2 AS n_errors,
  count(DISTINCT nombre_archivo) FILTER (len(histograma) = {DIM}) AS n_files FROM vectores_fashion""",
    "metadata_lines_scan": "SELECT CAST(chunk_id AS BIGINT) AS chunk_id, CAST(document_id AS BIGINT) AS document_id, title, artist, CAST(length(text) AS INTEGER) AS n_chars FROM (SELECT DISTINCT * FROM metadata)",
    "processed_lines_scan": _CHUNKS + """SELECT CAST(chunk_id AS BIGINT) AS chunk_id, CAST(document_id AS BIGINT) AS document_id, array_to_string(tokens, ' ') AS tokens
FROM tokened JOIN chunks USING (chunk_id)""",
    "json_dict_scan": _STORED + "SELECT term, round(idf, 6) AS idf FROM idf",
    "sorted_index_lookup": _STORED + f"SELECT term, chunk_id, tf FROM postings WHERE term IN {TERMS}",
    "offset_dictionary_scan": "SELECT term, count(*) AS n_rows FROM term_index WHERE term IS NOT NULL AND postings IS NOT NULL GROUP BY term",
    "insert_if_absent_run": f"""
WITH c AS (
  SELECT count(DISTINCT nombre_archivo) FILTER ({_NEW}) AS fresh, count(nombre_archivo) AS named, count(*) AS n FROM vectores_fashion),
e AS (SELECT count(DISTINCT nombre_archivo) AS held FROM fashion_images)
SELECT run, CASE run WHEN 0 THEN fresh ELSE 0 END AS inserted, named - CASE run WHEN 0 THEN fresh ELSE 0 END AS ignored, n - named AS errors, held + fresh AS n_rows, held + fresh AS n_files
FROM c, e, (VALUES (0), (1)) AS t(run)""",
    "append_refresh_run": "SELECT chunk_id, count(*) AS n, round(max(norm_value), 6) AS norm_value FROM doc_norms GROUP BY chunk_id",
    "matrix_scan": _CENTROIDS + """SELECT CAST(w AS INTEGER) AS word_id, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM (
  SELECT w, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM (SELECT row_number() OVER (ORDER BY word_id) - 1 AS w, c FROM centroids))""",
    "audio_frames": f"""SELECT CAST(1 AS INTEGER) AS audio_id, CAST(f AS INTEGER) AS frame_no, CAST(c AS INTEGER) AS coefficient, CAST(x AS DOUBLE) AS x
FROM range(4, 15) AS t(f), (VALUES {", ".join(f"({i}, {x})" for i, x in enumerate(_TONE))}) AS v(c, x)""",
    "tagged_audio_scan": """SELECT * FROM (VALUES ('a.mp3', CAST(4248 AS BIGINT), 'Canción', 'Ana; Luis', 'Uno', CAST(3 AS INTEGER), CAST(0.261224 AS DOUBLE)),
  ('b.mp3', 2085, NULL, NULL, NULL, NULL, 0.130612), ('c.mp3', 5, NULL, NULL, NULL, NULL, NULL))
  AS t(filename, file_size, title, collaborators, album, track_number, duration_seconds)""",
    "text_facade": _BOOK + _ask(QUERY) + """SELECT place, CAST(t.chunk_id AS VARCHAR) AS id, 'letra' AS dataset_type, round(rank_key, 6) AS score, title, artist
FROM top t JOIN chunks c ON t.chunk_id = c.chunk_id WHERE place <= 5""",
    "picture_facade": _ITEMS + ", asked AS (SELECT CAST(0 AS BIGINT) AS query_id, arg_min(v, id) AS q FROM usable)" + _NEAR
    + """SELECT place, CAST(r.id AS VARCHAR) AS id, 'prenda' AS dataset_type, round(1 - distance, 4) AS score, nombre_archivo, ruta_original
FROM ranked r JOIN fashion_images f ON r.id = f.id WHERE place <= 5""",
    "text_chunks_by_line": f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS chunk, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, {_LINES} AS l FROM documents WHERE text IS NOT NULL))
SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS chunk_id, doc_id, CAST(pos AS INTEGER) AS pos, chunk FROM lines WHERE len({_TOKENS.format("chunk")}) > 0""",
}
