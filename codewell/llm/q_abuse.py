"""Problem 9: abusive, hateful or sexually explicit documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewell.llm.abuse import fit_on, score_documents
from codewell.runtime import table


def _scored(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit_on(docs, table(spark, sf_dir, "labels")), keep=keep)


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; 0.5 is the threshold."""
    return _scored(spark, sf_dir).select("doc_id", "score")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one such passage."""
    return _scored(spark, sf_dir).where("flagged").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, flagged documents and their rate per source."""
    scored = _scored(spark, sf_dir, ("source",))
    flagged = F.sum(F.col("flagged").cast("long"))
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), flagged.alias("n_flagged"), F.round(F.avg(F.col("flagged").cast("double")), 6).alias("rate"))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
SQL: dict = {}
