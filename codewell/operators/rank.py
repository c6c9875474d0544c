"""Ranking items for queries: dot products over postings, cosine, coverage, best chunk per document, top k.

Queries are a relation ``(query_id, pos, term)``, so one plan answers one query or thousands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codewell.functions import weights
from codewell.functions.text import STOPWORDS, tokens

#: Query vectors up to so many rows are broadcast to the postings, larger batches are joined by shuffle.
QUERY_BROADCAST = 100_000
#: Digits to which scores are rounded before they are ordered: sums have no fixed order, equal chunks must tie.
DIGITS = 9


def one_query(spark: SparkSession, text: str) -> DataFrame:
    """A query as ``(query_id, text)``."""
    return spark.createDataFrame([(0, text)], "query_id long, text string")


def query_terms(queries: DataFrame, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """``(query_id, term, tf, pos)`` with the first position of each term; queries without a token have no row."""
    flat = queries.select("query_id", F.posexplode(tokens(F.col("text"), stopwords)).alias("pos", "term"))
    return flat.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("pos"))


def query_vector(terms: DataFrame, idf: DataFrame, scheme: str = weights.LOG10) -> DataFrame:
    """``(query_id, term, pos, weight, idf, n_terms, query_norm)``: terms without idf are dropped before coverage counts them."""
    w = terms.join(idf, "term").withColumn("weight", weights.weight(F.col("tf"), F.col("idf"), scheme))
    whole = Window.partitionBy("query_id")
    return w.select(
        "query_id", "term", "pos", "weight", "idf",
        F.count(F.lit(1)).over(whole).alias("n_terms"), F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(whole)).alias("query_norm"),
    )


def _hint(vector: DataFrame):
    """A broadcast hint for query vectors of a counted size; both uses of them follow one count."""
    return F.broadcast if vector.limit(QUERY_BROADCAST + 1).count() <= QUERY_BROADCAST else (lambda df: df)


def _products(vector: DataFrame, held: DataFrame, keys: list[str], hint) -> DataFrame:
    """``(query_id, *keys, dot, matched, first_pos)``: per joined row one product; what belongs to the query as a whole is joined
    after the sum."""
    asked = hint(vector.select("query_id", "term", "pos", (F.col("weight") * F.col("idf")).alias("_q")))
    hit = held.join(asked, "term").select("query_id", *keys, "pos", (F.col("_q") * F.col("_w")).alias("part"))
    return hit.groupBy("query_id", *keys).agg(F.sum("part").alias("dot"), F.count(F.lit(1)).alias("matched"), F.min("pos").alias("first_pos"))


def _rated(summed: DataFrame, vector: DataFrame, hint) -> DataFrame:
    """Cosine, coverage and rank key of sums with their ``norm_value``."""
    whole = summed.join(hint(vector.select("query_id", "n_terms", "query_norm").distinct()), "query_id").where("query_norm > 0")
    cosine = weights.cosine(F.col("dot"), F.col("query_norm"), F.col("norm_value"))
    coverage = F.col("matched") / F.col("n_terms")
    return whole.select(
        *[c for c in summed.columns if c not in ("dot", "matched", "norm_value")],
        F.round(cosine, DIGITS).alias("cosine"), coverage.alias("coverage"), F.round(cosine * coverage, DIGITS).alias("rank_key"),
    )


def scores(vector: DataFrame, post: DataFrame, item_norms: DataFrame, scheme: str = weights.LOG10) -> DataFrame:
    """``(query_id, chunk_id, cosine, coverage, rank_key, first_pos)`` of every chunk that holds a query term."""
    hint = _hint(vector)
    held = post.select("term", "chunk_id", weights.weight(F.col("tf"), F.lit(1.0), scheme).alias("_w"))
    summed = _products(vector, held, ["chunk_id"], hint)
    return _rated(summed.join(item_norms.where("norm_value > 0"), "chunk_id"), vector, hint)


def best_per_document(scored: DataFrame, documents: DataFrame) -> DataFrame:
    """The best chunk of every document: score, then first matching query term, then chunk id.

    ``documents`` may name a chunk twice, as only one row of each document stays.
    """
    joined = scored.join(documents.select("chunk_id", "document_id").where("document_id is not null"), "chunk_id")
    return _first_of_document(joined)


def _first_of_document(scored: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id", "document_id").orderBy(F.desc("rank_key"), "first_pos", "chunk_id")
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def batch_best(vector: DataFrame, post: DataFrame, item_norms: DataFrame, documents: DataFrame, scheme: str = weights.LOG10) -> DataFrame:
    """The same as best_per_document(scores()) for very many queries.

    Norm and document are joined to the postings before the queries multiply them, and the postings are partitioned by document:
    products, sums and the best chunk of a document then stay in their partition. A ranked window over queries, limited before its
    shuffle, sends k rows a query and partition.
    """
    hint = _hint(vector)
    held = post.select("term", "chunk_id", "tf").join(item_norms.where("norm_value > 0"), "chunk_id")
    held = held.join(documents.select("chunk_id", "document_id").where("document_id is not null").distinct(), "chunk_id")
    # divided by the norm at once, so that the sum is grouped by whole numbers only
    held = held.select("term", "document_id", "chunk_id", (weights.weight(F.col("tf"), F.lit(1.0), scheme) / F.col("norm_value")).alias("_w")).repartition("document_id")
    summed = _products(vector, held, ["document_id", "chunk_id"], hint).withColumn("norm_value", F.lit(1.0))
    return _first_of_document(_rated(summed, vector, hint))


def top_k(scored: DataFrame, k: int, score: str = "rank_key", ident: str = "chunk_id") -> DataFrame:
    """The k best per query with their place; ranked windows are limited before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "first_pos", ident)
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def with_metadata(top: DataFrame, metadata: DataFrame, rows: int | None = None) -> DataFrame:
    """Late materialisation: titles and texts of the winners only, each once.

    ``rows`` is what ``top`` can have at most, if that is known; up to QUERY_BROADCAST winners are broadcast to the scan, so that
    no other text is shuffled.
    """
    few = F.broadcast(top) if rows is not None and rows <= QUERY_BROADCAST else top
    return metadata.join(few, "chunk_id").dropDuplicates(["query_id", "place"])
