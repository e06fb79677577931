"""Vector expressions over ``array<float>`` columns; arithmetic is done in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: str | Column, b: str | Column) -> Column:
    return _total(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def squared_norm(a: str | Column) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))


def norm(a: str | Column) -> Column:
    return F.sqrt(squared_norm(a))


def cosine(a: str | Column, b: str | Column, norm_a: str | Column | None = None, norm_b: str | Column | None = None) -> Column:
    """Cosine similarity; null if either vector has length zero."""
    scale = (norm(a) if norm_a is None else col(norm_a)) * (norm(b) if norm_b is None else col(norm_b))
    return F.try_divide(dot(a, b), scale)


def l2_normalize(a: str | Column) -> Column:
    # The length is bound once, as the element of an array; inside the inner lambda it would be taken per element.
    scaled = F.transform(
        F.array(norm(a)), lambda length: F.when(length > 0, F.transform(col(a), lambda v: v.cast("double") / length))
    )
    return scaled[0]
