"""Problem 6: how often every codebook term occurs in the paragraphs, and which are too rare or too common."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewell.llm.terms import count_terms
from codewell.runtime import table

#: Terms in fewer records than this are rare; terms in a larger share of the records with content are common.
RARE_BELOW, COMMON_ABOVE = 3, 0.15


def p6_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, records and mark of every codebook term (lower-cased, blanks removed, each once)."""
    terms, n_records = count_terms(table(spark, sf_dir, "metadata"))
    term = F.regexp_replace(F.lower("term"), "^[ \t]+|[ \t]+$", "").alias("term")
    wanted = table(spark, sf_dir, "codebook").where("term is not null").select(term).distinct()
    counted = wanted.join(terms, "term", "left").crossJoin(F.broadcast(n_records))  # one row
    records = F.coalesce("records", F.lit(0))
    mark = F.when(records < RARE_BELOW, "rare").when(records > COMMON_ABOVE * F.col("n_records"), "common")
    return counted.select(
        "term", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), records.alias("records"), mark.alias("mark")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codebook terms too rare or too common to be useful."""
    return p6_terms(spark, sf_dir).where("mark is not null").select("term", "mark")


def p6_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every term of the collection, whether or not the codebook has it."""
    return count_terms(table(spark, sf_dir, "metadata"))[0]


_COUNTS = r"""
WITH once AS (SELECT chunk_id, any_value(text) AS text FROM metadata WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
tokens AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM once),
counts AS (SELECT term, count(*) AS occurrences, count(DISTINCT chunk_id) AS records FROM tokens GROUP BY term),
total AS (SELECT count(*) AS n FROM once WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''),
wanted AS (SELECT DISTINCT trim(lower(term), chr(32) || chr(9)) AS term FROM codebook WHERE term IS NOT NULL),
marked AS (
  SELECT term, coalesce(occurrences, 0) AS occurrences, coalesce(records, 0) AS records,
    CASE WHEN coalesce(records, 0) < 3 THEN 'rare' WHEN records > 0.15 * n THEN 'common' END AS mark
  FROM wanted LEFT JOIN counts USING (term), total)
"""
QUERIES = {"p6_found": p6_found, "p6_terms": p6_terms, "p6_all_terms": p6_all_terms}
SQL = {
    "p6_found": _COUNTS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p6_terms": _COUNTS + "SELECT * FROM marked",
    "p6_all_terms": _COUNTS + "SELECT * FROM counts",
}
