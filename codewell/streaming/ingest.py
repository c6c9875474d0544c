"""Incremental ingestion of paragraphs from files as they arrive.

Each micro-batch is split, filtered and appended once per key; the index is rebuilt from the relation when wanted, as idf and
norms depend on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codewell.functions.text import paragraphs, tokens
from codewell.sources.writers import insert_if_absent


def song_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``(document_id, title, artist, text)`` as a stream."""
    return spark.readStream.schema("document_id long, title string, artist string, text string").json(path)


def to_chunks(songs: DataFrame) -> DataFrame:
    """``(chunk_key, document_id, pos, title, artist, text)`` of paragraphs that hold a token; works on batches and streams.

    The key is made of document and place, as a stream cannot number its rows densely.
    """
    parts = songs.where("document_id is not null").select("document_id", "title", "artist", F.posexplode(paragraphs(F.col("text"))).alias("pos", "text"))
    key = F.concat_ws(":", F.col("document_id").cast("string"), F.col("pos").cast("string")).alias("chunk_key")
    return parts.where(F.size(tokens(F.col("text"))) > 0).select(key, "document_id", "pos", "title", "artist", "text")


def ingest(stream: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append new paragraphs to ``target``; a batch that is run again after a failure adds nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        insert_if_absent(batch, target, "chunk_key", "pos")

    writer = to_chunks(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
