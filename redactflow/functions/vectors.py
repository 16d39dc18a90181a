"""Vector maths on ``array<float>`` columns, summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    length = norm(a) + F.lit(EPS)
    return F.transform(a, lambda x: x.cast("double") / length)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null when either side is null or the lengths differ."""
    value = dot(a, b) / ((norm(a) + F.lit(EPS)) * (norm(b) + F.lit(EPS)))
    return F.when(F.size(a) == F.size(b), value)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)
