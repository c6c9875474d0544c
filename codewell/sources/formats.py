"""Interchange forms of the index: JSON pairs of postings, JSON dictionaries, JSON lines."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSTINGS = "array<struct<chunk_id:int,tf:int>>"


def postings_to_json(index: DataFrame, column: str = "postings") -> DataFrame:
    """The postings column as text ``[[chunk_id, tf], ...]``."""
    return index.withColumn(column, F.to_json(F.transform(column, lambda p: F.array(p["chunk_id"], p["tf"]))))


def postings_from_json(index: DataFrame, column: str = "postings") -> DataFrame:
    """Back to an array of structs; text that is no such list becomes NULL."""
    pairs = F.from_json(column, "array<array<int>>")
    return index.withColumn(column, F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("chunk_id"), F.get(p, F.lit(1)).alias("tf"))))


def read_json_dict(spark: SparkSession, path: str, key: str, value: str, kind: str) -> DataFrame:
    """A JSON object ``{key: value, ...}`` in one file as rows ``(key, value)``."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias(key, value))


def write_json_dict(df: DataFrame, key: str, value: str, path: str) -> None:
    """Rows as JSON lines ``{key: value}``, which read_json_lines_dict reads; no task gathers the whole dictionary."""
    df.select(F.to_json(F.create_map(F.col(key).cast("string"), F.col(value))).alias("value")).write.mode("overwrite").text(path)


def read_json_lines_dict(spark: SparkSession, path: str, key: str, value: str, kind: str) -> DataFrame:
    """Rows of one-entry objects, the form written by write_json_dict."""
    return spark.read.text(path).select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias(key, value))


def offset_dictionary(spark: SparkSession, path: str, key: str = "term") -> DataFrame:
    """``(term, file, offset)``: where each object of JSON-lines files begins, in bytes, for look-ups by seeking.

    One task reads one file, block by block, so a file's size does not matter.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                rows, at = [], 0
                with open(unquote(urlparse(name).path), "rb") as f:
                    for line in f:
                        if line.strip():
                            rows.append((json.loads(line)[key], name, at))
                        at += len(line)
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=[key, "file", "offset"])
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=[key, "file", "offset"])

    return files.mapInPandas(run, f"{key} string, file string, offset long")
