"""Vector expressions for use inside SQL plans."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; 0.0 when either side has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0.0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def has_vector(v: Column) -> Column:
    return F.coalesce(F.size(v) > 0, F.lit(False))
