"""Problem 8: benchmark passages inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewell.llm.leaks import find_leaks
from codewell.runtime import table


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked item of every document with the edits of its best window."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items they hold."""
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item the documents that hold it."""
    return p8_leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("edits").alias("least_edits"))


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks, "p8_items": p8_items}
SQL: dict = {}
