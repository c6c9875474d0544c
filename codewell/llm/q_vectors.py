"""Problem 5: the most similar pictures of every picture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewell.llm.neighbours import nearest_neighbours
from codewell.llm.vectors import one_per_item, pack_usable
from codewell.runtime import table

#: Bins of a picture's histogram, and the similarity from which pictures are alike.
DIM, ALIKE = 1000, 0.7


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, packed)`` of each file with a usable histogram in either table."""
    return one_per_item(
        pack_usable(table(spark, sf_dir, "fashion_images"), "nombre_archivo", "histograma_visual", DIM),
        pack_usable(table(spark, sf_dir, "vectores_fashion"), "nombre_archivo", "histograma", DIM),
    )


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar other pictures of every picture."""
    return nearest_neighbours(pictures(spark, sf_dir), DIM)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in which one is among the five most similar of the other, from a cosine of 0.7."""
    near = nearest_neighbours(pictures(spark, sf_dir), DIM, least=ALIKE)
    return near.select(F.least("id", "other").alias("file_a"), F.greatest("id", "other").alias("file_b")).distinct()


def p5_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alike ones among the five most similar of every picture, with their similarity and rank."""
    return nearest_neighbours(pictures(spark, sf_dir), DIM, least=ALIKE)


_TOP = f"""
WITH usable AS (
  SELECT nombre_archivo AS f, CAST(histograma_visual AS DOUBLE[]) AS h FROM fashion_images
  UNION ALL SELECT nombre_archivo, histograma FROM vectores_fashion),
pic AS MATERIALIZED (
  SELECT f, any_value(h) AS h FROM usable
  WHERE f IS NOT NULL AND len(h) = {DIM} AND len(list_filter(h, lambda x: x IS NULL OR isnan(x))) = 0
    AND len(list_filter(h, lambda x: x <> 0)) > 0 GROUP BY f),
pairs AS (SELECT a.f AS f, b.f AS o, round(list_cosine_similarity(a.h, b.h), 6) AS s FROM pic a JOIN pic b ON a.f <> b.f),
top AS (SELECT f, o, s, row_number() OVER (PARTITION BY f ORDER BY s DESC, o) AS r FROM pairs)
"""
QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours, "p5_ranked": p5_ranked}
SQL = {
    "p5_found": _TOP + f"SELECT DISTINCT least(f, o) AS file_a, greatest(f, o) AS file_b FROM top WHERE r <= 5 AND s >= {ALIKE}",
    "p5_ranked": _TOP + f"SELECT f AS id, o AS other, s AS similarity, CAST(r AS INTEGER) AS rank FROM top WHERE r <= 5 AND s >= {ALIKE}",
}
