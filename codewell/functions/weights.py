"""Term weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codewell.functions.vectors import ratio

LOG10, RAW = "log10", "raw"


def smooth_idf(n: Column, df: Column) -> Column:
    """ln((N + 1) / (df + 1)) + 1."""
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


def weight(tf: Column, idf: Column, scheme: str = LOG10) -> Column:
    """(1 + log10 tf) * idf for text, tf * idf for acoustic words."""
    return ((1.0 + F.log10(tf)) if scheme == LOG10 else tf.cast("double")) * idf


def cosine(dot: Column, a: Column, b: Column) -> Column:
    """dot / (a * b); NULL where a norm is 0."""
    return ratio(dot, a * b)
