"""Checks of keys, references and vectors, and load counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewell.functions.vectors import is_usable


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    """Distinct non-NULL keys of the child that the parent lacks."""
    have = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).select(key).distinct().join(have, key, "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def vector_audit(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """One row: vectors, NULLs, wrong lengths, vectors with NaN or infinity, all-zero (dead) vectors, usable ones."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    dead = (F.size(v) > 0) & F.forall(v, lambda x: x == 0)
    count = lambda c: F.count(F.when(c, 1))
    return df.agg(
        F.count(F.lit(1)).alias("n"), count(v.isNull()).alias("n_null"), count(F.size(v) != F.lit(dim)).alias("n_wrong_length") if dim else F.lit(0).alias("n_wrong_length"),
        count(bad).alias("n_nan"), count(dead).alias("n_dead"), count(is_usable(v, dim)).alias("n_usable"),
    )


def load_counters(rows: DataFrame, ok: Column, key: str, existing: DataFrame) -> DataFrame:
    """One row ``(inserted, ignored, errors)`` of an insert-if-absent load, without writing."""
    have = existing.select(key).distinct().withColumn("_have", F.lit(True))
    marked = rows.select(F.col(key), ok.alias("_ok")).join(have, key, "left")
    per_key = marked.groupBy(key).agg(
        F.count(F.when(F.col("_ok"), 1)).alias("good"), F.count(F.when(~F.col("_ok"), 1)).alias("bad"), F.max("_have").alias("_have")
    )
    inserted = F.when(F.col("_have").isNull() & (F.col("good") > 0), 1).otherwise(0)
    return per_key.agg(
        F.coalesce(F.sum(inserted), F.lit(0)).cast("long").alias("inserted"),
        F.coalesce(F.sum(F.col("good") - inserted), F.lit(0)).cast("long").alias("ignored"),
        F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("errors"),
    )
