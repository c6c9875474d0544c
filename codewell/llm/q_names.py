"""Problem 1: spellings of the same person or group in artists and collaborators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewell.llm.names import link_names
from codewell.runtime import table


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    artists = table(spark, sf_dir, "metadata").groupBy(F.col("artist").alias("name")).agg(F.count(F.lit(1)).alias("w"))
    entries = table(spark, sf_dir, "audio_dataset").select(F.explode(F.split("collaborators", ";")).alias("name"))
    return link_names(artists.unionByName(entries.groupBy("name").agg(F.count(F.lit(1)).alias("w"))), "name", "w")


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with its canonical form and the log posterior of the attachment."""
    return _links(spark, sf_dir)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different names that mean the same person or group."""
    links = _links(spark, sf_dir)
    several = links.groupBy("canonical").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
    group = links.join(several, "canonical").select("canonical", "name")
    a, b = group.withColumnRenamed("name", "name_a"), group.withColumnRenamed("name", "name_b")
    return a.join(b, "canonical").where("name_a < name_b").select("name_a", "name_b")


QUERIES = {"p1_found": p1_found, "p1_links": p1_links}
SQL: dict = {}
