"""Search facades: one class per modality, each answering with rows of the same form."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewell.functions import tags, weights
from codewell.operators import knn, postings, quantize, rank
from codewell.runtime import keep
from codewell.sources import features

#: Kinds of results (fixed values).
TEXT, SONG, GARMENT = "letra", "cancion", "prenda"


class Unavailable(RuntimeError):
    """The engine has no index yet."""


class BadFormat(ValueError):
    """The upload is of a kind that is not accepted."""


class NotFound(KeyError):
    """No such item."""


@dataclass
class SearchResult:
    """One hit."""

    id: str
    dataset_type: str
    score: float
    metadata: dict[str, Any] = field(default_factory=dict)


class TextSearch:
    """Search over paragraphs, best paragraph per song. The index is computed once and persisted."""

    def __init__(self, metadata: DataFrame, top_terms: int = 5000):
        self.metadata = metadata.dropDuplicates(["chunk_id"])
        counts = keep(postings.chunk_terms(postings.chunk_tokens(self.metadata)))
        self.book = keep(postings.codebook(postings.term_stats(counts), top_terms))
        self.idf = keep(postings.idf_table(self.book, postings.chunk_count(counts)))
        self.postings = keep(postings.postings(counts, self.book))
        self.norms = keep(postings.norms(self.postings, self.idf))

    @classmethod
    def from_stored(cls, metadata: DataFrame, idf: DataFrame, post: DataFrame, norms: DataFrame) -> TextSearch:
        """Over stored relations ``(term, idf)``, ``(term, chunk_id, tf)``, ``(chunk_id, norm_value)``."""
        self = cls.__new__(cls)
        self.metadata, self.book, self.idf, self.postings, self.norms = metadata, None, idf, post, norms
        return self

    def search_frame(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """Best songs of every query ``(query_id, text)``."""
        vector = rank.query_vector(rank.query_terms(queries), self.idf)
        top = rank.top_k(rank.best_per_document(rank.scores(vector, self.postings, self.norms), self.metadata), top_k)
        return rank.with_metadata(top.drop("document_id"), self.metadata)

    def search(self, query: str, top_k: int = 5) -> list[SearchResult]:
        """Best songs of one query."""
        rows = self.search_frame(rank.one_query(self.metadata.sparkSession, query), top_k).orderBy("place").collect()
        return [SearchResult(str(r["chunk_id"]), TEXT, float(r["rank_key"]), {"title": r["title"], "artist": r["artist"], "text": r["text"]}) for r in rows]


class AudioSearch:
    """Search by sound: frames, nearest acoustic words, raw-frequency cosine."""

    def __init__(self, audio: DataFrame, centroids: DataFrame, extractor: str | features.Extractor = "wav", base_url: str = "http://localhost:8000"):
        self.audio, self.centroids, self.extractor, self.base = audio, centroids, extractor, base_url
        frames = features.extract(audio.where("audio_data is not null"), "audio_id", "audio_data", extractor)
        words = quantize.histogram(quantize.assign(frames, centroids, keep=("audio_id",)), "audio_id")
        self.postings = keep(words.select(F.col("word_id").alias("term"), F.col("audio_id").alias("chunk_id"), "tf"))
        n = self.postings.agg(F.countDistinct("chunk_id").alias("n"))
        df = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        self.idf = keep(df.crossJoin(F.broadcast(n)).select("term", weights.smooth_idf(F.col("n"), F.col("df")).alias("idf")))
        self.norms = keep(postings.norms(self.postings, self.idf, weights.RAW))

    def search(self, content: bytes, filename: str = "query.wav", top_k: int = 5) -> list[SearchResult]:
        """Songs most similar to the uploaded sound; a sound without frames finds nothing."""
        if not filename.endswith(tags.AUDIO_SUFFIXES):
            raise BadFormat(filename)
        spark = self.audio.sparkSession
        query = spark.createDataFrame([(0, bytearray(content))], "query_id long, content binary")
        words = quantize.histogram(quantize.assign(features.extract(query, "query_id", "content", self.extractor), self.centroids, keep=("query_id",)), "query_id")
        terms = words.select("query_id", F.col("word_id").alias("term"), "tf", F.col("word_id").alias("pos"))
        top = rank.top_k(rank.scores(rank.query_vector(terms, self.idf, weights.RAW), self.postings, self.norms, weights.RAW), top_k, "cosine")
        meta = self.audio.drop("audio_data").withColumnRenamed("audio_id", "chunk_id")
        rows = top.join(meta, "chunk_id", "left").select(
            "place", "chunk_id", "cosine", "filename", *[tags.or_unknown(F.col(c)).alias(c) for c in ("title", "collaborators", "album")], tags.or_zero(F.col("duration_seconds")).alias("duration")
        ).orderBy("place").collect()
        return [
            SearchResult(str(r["chunk_id"]), SONG, float(r["cosine"]), {
                "filename": r["filename"], "title": r["title"], "artist": r["collaborators"], "album": r["album"], "duration_seconds": r["duration"],
                "audio_url": f"{self.base.rstrip('/')}/audio/stream/{r['chunk_id']}"})
            for r in rows
        ]

    def stream(self, audio_id: int) -> tuple[bytes, str]:
        """Sound and media type of a song."""
        row = self.audio.where(F.col("audio_id") == audio_id).select("audio_data", tags.media_type(F.col("content_type")).alias("t")).first()
        if row is None or row["audio_data"] is None:
            raise NotFound(audio_id)
        return bytes(row["audio_data"]), row["t"]


class ImageSearch:
    """Search by picture: descriptor histogram, exact cosine distance."""

    def __init__(self, images: DataFrame, centroids: DataFrame | None = None, extractor: features.Extractor | None = None, dim: int = 1000):
        self.images, self.centroids, self.extractor, self.dim = images, centroids, extractor, dim

    def histogram(self, content: bytes) -> list[float]:
        """Dense histogram of a picture; zeros where it has no descriptor or cannot be read."""
        if self.centroids is None or self.extractor is None:
            raise Unavailable("no codebook or extractor")
        spark = self.images.sparkSession
        query = spark.createDataFrame([(0, bytearray(content))], "item_id long, content binary")
        words = quantize.histogram(quantize.assign(features.extract(query, "item_id", "content", self.extractor), self.centroids, keep=("item_id",)))
        row = quantize.dense_histogram(words, self.dim).first()
        return [0.0] * self.dim if row is None else list(row["histogram"])

    def search(self, content: bytes, filename: str = "query.jpg", top_k: int = 5) -> list[SearchResult]:
        """Pictures most similar to the uploaded one."""
        if not filename.lower().endswith(tags.IMAGE_SUFFIXES):
            raise BadFormat(filename)
        return self.search_vector(self.histogram(content), top_k)

    def search_vector(self, histogram: list[float], top_k: int = 5) -> list[SearchResult]:
        """Pictures most similar to a histogram."""
        query = self.images.sparkSession.createDataFrame([(0, [float(x) for x in histogram])], "query_id long, vector array<double>")
        found = knn.knn(self.images.select("id", F.col("histograma_visual").alias("vector")), query, top_k, self.dim)
        rows = found.join(self.images.select("id", "nombre_archivo", "ruta_original"), "id").orderBy("place").collect()
        return [SearchResult(str(r["id"]), GARMENT, float(r["score"]), {"nombre_archivo": r["nombre_archivo"], "ruta_original": r["ruta_original"]}) for r in rows]

    def path(self, image_id: int) -> str:
        """Stored path of a picture."""
        row = self.images.where(F.col("id") == image_id).select("ruta_original").first()
        if row is None or row["ruta_original"] is None:
            raise NotFound(image_id)
        return row["ruta_original"]

    def render(self, image_id: int) -> tuple[bytes, str]:
        """Bytes and media type of a stored picture; not found without a row or a file."""
        path = os.path.normpath(self.path(image_id))
        if not os.path.isfile(path):
            raise NotFound(image_id)
        with open(path, "rb") as f:
            return f.read(), "image/jpeg"


class Engines:
    """The three engines, started independently: a failure of one leaves the others up."""

    def __init__(self, **starters: Any):
        self.errors: dict[str, Exception] = {}
        self.up: dict[str, Any] = {}
        for name, start in starters.items():
            try:
                self.up[name] = start()
            except Exception as e:  # noqa: BLE001  kept for the caller
                self.errors[name] = e

    def __getitem__(self, name: str) -> Any:
        if name not in self.up:
            raise Unavailable(name)
        return self.up[name]
