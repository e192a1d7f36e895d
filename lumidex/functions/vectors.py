"""Vector functions on array columns, in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(doubles(a), doubles(b)) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def normalised(v: Column, least: float = 1e-9) -> Column:
    n = F.greatest(norm(v), F.lit(least))
    return F.transform(doubles(v), lambda x: x / n)


def usable(v: Column, dimensions: int) -> Column:
    """Neither null nor of another length, not all zero, without nulls and NaN."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return v.isNotNull() & (F.size(v) == dimensions) & ~bad & F.exists(v, lambda x: x != 0)
