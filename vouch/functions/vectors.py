"""Column functions over vectors: distances and normal forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d))


def l2_normalized(a: Column, epsilon: float = 0.0) -> Column:
    """a divided by its length, which is never taken smaller than epsilon; the zero vector stays as it is."""
    length = F.greatest(norm(a), F.lit(epsilon))
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def minmax_normalized(a: Column, low: float, high: float) -> Column:
    """Values moved into low to high and scaled to 0 to 1; unchanged where low equals high."""
    if low == high:
        return a
    return F.transform(a, lambda x: (F.least(F.greatest(x.cast("double"), F.lit(low)), F.lit(high)) - low) / (high - low))


def vec_distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Distance of two vectors, rounded to six decimals; null where either is null, or their lengths differ."""
    if metric == "cosine":
        d = cosine_distance(a, b)
    elif metric == "angular":
        d = F.acos(F.least(F.greatest(1 - cosine_distance(a, b), F.lit(-1.0)), F.lit(1.0))) / F.pi()
    elif metric == "euclidean":
        d = euclidean(a, b)
    elif metric == "euclidean_l2":
        d = euclidean(l2_normalized(a, 1e-10), l2_normalized(b, 1e-10))
    else:
        raise ValueError(f"no metric {metric!r}")
    return F.when(F.size(a) == F.size(b), F.round(d, 6))
