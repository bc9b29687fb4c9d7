"""Similarity of vectors as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """The inner product; null for null vectors and for other lengths."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def similarity(query: Column | str, vector: Column | str, normalised: bool = False) -> Column:
    """The inner product of unit vectors, the cosine of others; 0 where a vector has no length."""
    if normalised:
        return dot(query, vector)
    n = norm(query) * norm(vector)
    return F.when(n == 0, 0.0).otherwise(dot(query, vector) / n)


def usable(vector: Column | str, dimension: int | None = None) -> Column:
    """Not null, not empty, without null and NaN elements, and of the dimension if one is given."""
    v = F.col(vector) if isinstance(vector, str) else vector
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.coalesce(ok & (F.size(v) == dimension) if dimension else ok, F.lit(False))
