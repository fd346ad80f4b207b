"""Vector expressions on array columns, for plans that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the smallest norm that is divided by.
TINY = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalised(v: Column) -> Column:
    size = F.greatest(norm(v), F.lit(TINY))
    return F.transform(v, lambda x: x / size)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def subvectors(v: Column, subspaces: int, width: int) -> Column:
    """Contiguous parts, as array<struct<m, x>>."""
    return F.transform(F.sequence(F.lit(0), F.lit(subspaces - 1)), lambda m: F.struct(m.alias("m"), F.slice(v, m * width + 1, F.lit(width)).alias("x")))
