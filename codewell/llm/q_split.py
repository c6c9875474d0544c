"""Problem 3: oversized paragraphs cut into overlapping pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codewell.llm.split import split_oversized
from codewell.runtime import table


def _pieces(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "metadata"), ("document_id", "chunk_id"), "text", with_text=with_text)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of all pieces of every distinct chunk longer than 800 characters."""
    return _pieces(spark, sf_dir, False).select("document_id", "chunk_id", "piece_start", "piece_end")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces themselves, numbered."""
    return _pieces(spark, sf_dir, True).select("document_id", "chunk_id", "piece_no", "piece")


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
_PIECES = r"""
WITH RECURSIVE long AS (SELECT DISTINCT document_id, chunk_id, text FROM metadata WHERE length(text) > 800),
pieces AS (
  SELECT document_id, chunk_id, text, 0 AS no, 0 AS a, {end0} AS b FROM (
    SELECT *, 0 AS s, substr(text, 1, 800) AS w FROM long)
  UNION ALL
  SELECT document_id, chunk_id, text, no, s, CASE WHEN length(text) - s <= 800 THEN length(text) ELSE {end} END FROM (
    SELECT *, substr(text, s + 1, 800) AS w FROM (
      SELECT document_id, chunk_id, text, no + 1 AS no,
        CASE WHEN regexp_matches(t, '[ \t\r\n][^ \t\r\n]') THEN b - 100 - 1 + length(regexp_extract(t, '^(.*?[ \t\r\n])[^ \t\r\n]', 1, 's'))
        ELSE b - 100 END AS s
      FROM (SELECT *, substr(text, b - 100, 101) AS t FROM pieces WHERE b < length(text)))))
SELECT {out} FROM pieces"""
_END = (
    "CASE WHEN strpos(substr(w, 401), chr(10)) > 0 THEN s + length(regexp_extract(w, '^(.*\\n)', 1, 's')) "
    "WHEN regexp_matches(substr(w, 400), '[.!?…][ \\t\\r\\n]') OR contains(substr(w, 401), '。') "
    "THEN s + length(regexp_extract(w, '^(.*([.!?…][ \\t\\r\\n]|。))', 1, 's')) "
    "WHEN regexp_matches(substr(w, 401), '[ \\t\\r\\n]') THEN s + length(regexp_extract(w, '^(.*[ \\t\\r\\n])', 1, 's')) ELSE s + 800 END"
)
SQL = {
    "p3_found": _PIECES.format(end0=_END, end=_END, out="document_id, chunk_id, a AS piece_start, CAST(b AS INTEGER) AS piece_end"),
    "p3_pieces": _PIECES.format(end0=_END, end=_END, out="document_id, chunk_id, no AS piece_no, substr(text, a + 1, b - a) AS piece"),
}
