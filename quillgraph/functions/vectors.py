"""Vector arithmetic on arrays of doubles, on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, *, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine; 0 for empty vectors, different lengths and zero norms. Norms known already can be handed in."""
    na, nb = (norm(a) if norm_a is None else norm_a), (norm(b) if norm_b is None else norm_b)
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable & (na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))
