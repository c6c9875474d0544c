"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 (a plain division would raise in ANSI mode)."""
    return F.try_divide(a, b)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NaN where a vector is 0, which sorts behind every distance."""
    return F.coalesce(1.0 - ratio(dot(a, b), norm(a) * norm(b)), F.lit(float("nan")))


def similarity(distance: Column) -> Column:
    """The reported score of a distance: 1 - distance to 4 digits."""
    return F.round(1.0 - distance, 4)


def is_usable(v: Column, dim: int) -> Column:
    """A vector of the right length without NULL or NaN and not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
