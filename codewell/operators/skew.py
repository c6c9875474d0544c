"""Per-key results over heavily skewed keys by value-frequency compression.

A key that owns a third of all rows must not become one task. Rows are first grouped by *(key, id)* to drop repeated
writings, then by *(key, value)*: a key with billions of rows has only as many groups as it has distinct values. Exact
distinct counts, modes and percentiles follow from the weighted values, and a ranking keeps, of each *(key, value)* group,
only the few ids that can still win. Every shuffle is keyed by more than the hot key or carries pre-aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codewell.runtime import broadcast_within, cut, keep

#: Keys whose bounds are broadcast to the rows.
KEYS_BROADCAST = 200_000


def distinct_postings(index: DataFrame) -> DataFrame:
    """Explode packed postings to one row ``(term, chunk_id, tf)`` per term and chunk.

    A posting written twice counts once; should the writings disagree, the largest ``tf`` holds. Rows with a NULL term,
    NULL or empty postings, and postings without chunk or tf give nothing. Other columns of ``index`` are not read.
    """
    flat = (
        index.where(F.col("term").isNotNull())
        .select("term", F.explode("postings").alias("p"))
        .select("term", F.col("p.chunk_id").alias("chunk_id"), F.col("p.tf").alias("tf"))
        .where("chunk_id is not null and tf is not null")
    )
    return flat.groupBy("term", "chunk_id").agg(F.max("tf").alias("tf"))


def value_frequencies(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value, n)``: how often each value occurs under each key. Partial aggregation precedes the shuffle."""
    return rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))


def top_ids(rows: DataFrame, key: str, value: str, ident: str, k: int) -> DataFrame:
    """``(key, ident, value, rank)``: the ``k`` ids with the highest value per key, equal values by smaller id.

    The weighted values *(key, value, n)* say from which value on a key has k rows; only rows from there on are ranked, by two
    windows: the first is partitioned by *(key, value)*, and as Spark limits a ranked window before its shuffle, each task
    sends at most ``k`` rows of a group, however many share the value; the second ranks the few survivors per key.
    """
    rows = keep(rows.select(key, ident, value))
    try:
        above = Window.partitionBy(key).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
        counted = value_frequencies(rows, key, value).withColumn("_above", F.coalesce(F.sum("n").over(above), F.lit(0)))
        bounds = cut(counted.where(F.col("_above") < k).groupBy(key).agg(F.min(value).alias("_least")))
        few = _join_bounds(rows, bounds, key, ident).where(F.col(value) >= F.col("_least")).drop("_least")
        inner = Window.partitionBy(key, value).orderBy(ident)
        outer = Window.partitionBy(key).orderBy(F.desc(value), ident)
        few = few.withColumn("_r", F.row_number().over(inner)).where(F.col("_r") <= k).drop("_r")
        return cut(few.withColumn("rank", F.row_number().over(outer)).where(F.col("rank") <= k))
    finally:
        rows.unpersist()


def _join_bounds(rows: DataFrame, bounds: DataFrame, key: str, ident: str, salts: int = 32) -> DataFrame:
    """Rows with the one row of their key: by broadcast up to KEYS_BROADCAST keys, beyond that with the keys' rows dealt by salt."""
    hinted = broadcast_within(bounds, KEYS_BROADCAST)
    if hinted is not bounds:
        return rows.join(hinted, key)
    salted = bounds.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_s", F.pmod(F.xxhash64(ident), F.lit(salts)).cast("int")).join(salted, [key, "_s"]).drop("_s")


def weighted_profile(freq: DataFrame, key: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact count, distinct values, mode (ties: smaller value) and discrete percentiles per key from weighted values.

    ``freq`` holds ``(key, value, n)``. A percentile ``q`` is the smallest value whose cumulated weight reaches ``q`` times
    the key's total. The window sees one row per distinct value, not per record.
    """
    by_value = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(key)
    ranked = freq.withColumn("_cum", F.sum("n").over(by_value)).withColumn("_all", F.sum("n").over(whole))
    return ranked.groupBy(key).agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_values"),
        F.max(F.struct(F.col("n"), (-F.col(value)).alias("v")))["v"].alias("_mode"),
        F.max(value).alias("max_value"),
        *[F.min(F.when(F.col("_cum") >= F.col("_all") * q, F.col(value))).alias(name) for name, q in quantiles.items()],
    ).withColumn("mode_value", -F.col("_mode")).drop("_mode")
