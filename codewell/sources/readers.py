"""Readers of song collections, JSON lines, media files and codebooks."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewell.functions.tags import basename
from codewell.operators.numbering import number_rows
from codewell.sources import schemas


def songs_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(document_id, title, artist, text)`` of CSV files with the columns song, artist and text, found by name.

    Fields may hold line ends and doubled quotes. document_id is the row's place in its file, files in path order. A missing
    text counts as empty.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    rows = raw.select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_place"), "song", "artist", F.coalesce("text", F.lit("")).alias("text"))
    numbered = number_rows(rows, ["_file", "_place"], "document_id")
    return numbered.select("document_id", F.col("song").alias("title"), "artist", "text")


def processed_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Tokenised chunks."""
    return spark.read.schema(schemas.PROCESSED).json(path)


def metadata_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chunk texts with title and artist."""
    return spark.read.schema(schemas.METADATA).json(path)


def image_lines(spark: SparkSession, path: str, dim: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Good picture lines, and one row ``(n_ok, n_errors)``. Blank lines are skipped; broken lines and vectors of a wrong
    length are errors."""
    schema = schemas.IMAGES + ", _corrupt string"
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    ok = F.col("_corrupt").isNull() & F.coalesce(F.size("histograma") == dim, F.lit(False))
    counted = parsed.agg(F.count(F.when(ok, 1)).alias("n_ok"), F.count(F.when(~ok, 1)).alias("n_errors"))
    return parsed.where(ok).drop("_corrupt"), counted


def media_files(spark: SparkSession, path: str, pattern: str, recursive: bool = True) -> DataFrame:
    """``(filename, path, content, file_size)`` of the files that match a glob pattern."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    return files.select(basename(F.col("path")).alias("filename"), "path", "content", F.col("length").alias("file_size"))


def audio_files(spark: SparkSession, path: str, pattern: str = "*.mp3") -> DataFrame:
    """Sound files with their tags; unreadable tags are NULL."""
    from codewell.sources.tags import with_tags

    return with_tags(media_files(spark, path, pattern))


def npy_rows(spark: SparkSession, path: str, ident: str = "word_id") -> DataFrame:
    """Rows of stored matrices ``(ident, centroid)``; files in name order are stacked, rows numbered from 0."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["filename"], b["content"], strict=True):
                m = np.load(io.BytesIO(raw), allow_pickle=False)
                yield pd.DataFrame({"file": name, "row": np.arange(len(m)), "centroid": list(m.astype(np.float64))})

    parts = media_files(spark, path, "*.npy").select("filename", "content").mapInPandas(rows, "file string, row long, centroid array<double>")
    return number_rows(parts, ["file", "row"], ident).select(F.col(ident).cast("int").alias(ident), "centroid")
