"""The posting relation (item, term, tf) and what is derived from it: codebook, idf, packed index, norms.

Text, acoustic and visual words share it; only the weighting differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codewell.functions import weights
from codewell.functions.text import STOPWORDS, tokens
from codewell.runtime import broadcast_within

#: Codebooks up to this size are broadcast; larger ones are joined by shuffle.
CODEBOOK_BROADCAST = 200_000


def chunk_tokens(chunks: DataFrame, text: str = "text", stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """``(chunk_id, tokens)`` of the chunks that have a token at all."""
    return chunks.select("chunk_id", tokens(F.col(text), stopwords).alias("tokens")).where(F.size("tokens") > 0)


def chunk_terms(tokened: DataFrame) -> DataFrame:
    """``(term, chunk_id, tf, pos)``: frequency and first place of every term in every chunk, the base of the whole index."""
    flat = tokened.select("chunk_id", F.posexplode("tokens").alias("pos", "term"))
    return flat.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("pos"))


def term_stats(counts: DataFrame) -> DataFrame:
    """``(term, cf, df, first_chunk, first_pos)``: occurrences, chunks, and where the term stands first."""
    return counts.groupBy("term").agg(
        F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"), F.min(F.struct("chunk_id", "pos")).alias("first")
    ).select("term", "cf", "df", F.col("first.chunk_id").alias("first_chunk"), F.col("first.pos").alias("first_pos"))


def chunk_count(counts: DataFrame) -> DataFrame:
    """One row ``(n_chunks)``: chunks that have a token; each has one term at place 0."""
    return counts.where("pos = 0").agg(F.count(F.lit(1)).alias("n_chunks"))


def codebook(stats: DataFrame, size: int = 5000) -> DataFrame:
    """The ``size`` most frequent terms with rank from 0, equal frequencies by first occurrence.

    The cut is a top-k over the vocabulary; the ranking window then sees at most ``size`` rows.
    """
    order = [F.desc("cf"), F.asc("first_chunk"), F.asc("first_pos")]
    top = stats.orderBy(*order).limit(size)
    return top.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int")).select("term", "rank", "cf", "df")


def idf_table(book: DataFrame, n_chunks: DataFrame) -> DataFrame:
    """``(term, idf)`` of a codebook; ``n_chunks`` is the row of chunk_count()."""
    return book.crossJoin(F.broadcast(n_chunks)).select("term", weights.smooth_idf(F.col("n_chunks"), F.col("df")).alias("idf"))


def postings(counts: DataFrame, book: DataFrame | None = None) -> DataFrame:
    """``(term, chunk_id, tf)``, restricted to the codebook if given."""
    if book is not None:
        counts = counts.join(broadcast_within(book.select("term"), CODEBOOK_BROADCAST), "term", "left_semi")
    return counts.select("term", "chunk_id", "tf")


def pack(post: DataFrame, segment: int = 10_000) -> DataFrame:
    """``(term, segment, postings)``: postings by chunk, at most ``segment`` chunk ids wide, so a hot term spans many rows."""
    part = F.floor(F.col("chunk_id") / segment).cast("long").alias("segment")
    return post.groupBy("term", part).agg(F.array_sort(F.collect_list(F.struct("chunk_id", "tf"))).alias("postings"))


def unpack(packed: DataFrame) -> DataFrame:
    """Packed rows back to ``(term, chunk_id, tf)``."""
    return packed.select("term", F.explode("postings").alias("p")).select("term", "p.chunk_id", "p.tf")


def norms(post: DataFrame, idf: DataFrame, scheme: str = weights.LOG10) -> DataFrame:
    """``(chunk_id, norm_value)``: length of each chunk's weight vector; a term without idf weighs 0."""
    w = weights.weight(F.col("tf"), F.coalesce("idf", F.lit(0.0)), scheme)
    joined = post.join(broadcast_within(idf, CODEBOOK_BROADCAST), "term", "left")
    return joined.groupBy("chunk_id").agg(F.sqrt(F.sum(w * w)).alias("norm_value"))
