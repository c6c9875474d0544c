"""Problem 4: per-term results over an index in which a few terms own most postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codewell.operators import skew
from codewell.runtime import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three chunks of each term in which it is most frequent."""
    postings = skew.distinct_postings(table(spark, sf_dir, "term_index"))
    return skew.top_ids(postings, "term", "tf", "chunk_id", 3).select("term", "chunk_id")


def p4_term_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, distinct frequencies, modal, median and 90th-percentile frequency per term from weighted values."""
    postings = skew.distinct_postings(table(spark, sf_dir, "term_index"))
    freq = skew.value_frequencies(postings, "term", "tf")
    return skew.weighted_profile(freq, "term", "tf", {"p50": 0.5, "p90": 0.9}).selectExpr(
        "term", "n_rows as n_chunks", "n_values", "cast(mode_value as int) mode_tf", "max_value as max_tf",
        "p50 as p50_tf", "p90 as p90_tf",
    )


_POSTINGS = """
WITH flat AS (SELECT term, unnest(postings) AS p FROM term_index WHERE term IS NOT NULL),
postings AS (
  SELECT term, p.chunk_id AS chunk_id, max(p.tf) AS tf FROM flat
  WHERE p.chunk_id IS NOT NULL AND p.tf IS NOT NULL GROUP BY term, p.chunk_id)
"""

QUERIES = {"p4_found": p4_found, "p4_term_profile": p4_term_profile}
SQL = {
    "p4_found": _POSTINGS
    + """SELECT term, chunk_id FROM (
  SELECT term, chunk_id, row_number() OVER (PARTITION BY term ORDER BY tf DESC, chunk_id) AS r FROM postings)
WHERE r <= 3""",
    "p4_term_profile": _POSTINGS
    + """, ranked AS (
  SELECT term, tf, row_number() OVER (PARTITION BY term ORDER BY tf) AS r, count(*) OVER (PARTITION BY term) AS n FROM postings),
modes AS (
  SELECT term, tf AS mode_tf FROM (
    SELECT term, tf, row_number() OVER (PARTITION BY term ORDER BY count(*) DESC, tf) AS r FROM postings GROUP BY term, tf)
  WHERE r = 1)
SELECT term, count(*) AS n_chunks, count(DISTINCT tf) AS n_values, any_value(mode_tf) AS mode_tf, max(tf) AS max_tf,
  min(CASE WHEN r >= 0.5 * n THEN tf END) AS p50_tf, min(CASE WHEN r >= 0.9 * n THEN tf END) AS p90_tf
FROM ranked JOIN modes USING (term) GROUP BY term""",
}
