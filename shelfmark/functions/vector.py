"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfmark.constants import NORM_EPSILON


def l2_norm(vector: Column) -> Column:
    wide = vector.cast("array<double>")
    return F.sqrt(F.aggregate(wide, F.lit(0.0), lambda total, x: total + x * x))


def l2_normalize(vector: Column, eps: float = NORM_EPSILON) -> Column:
    """Unit length; a vector shorter than ``eps`` stays as it is.

    The norm comes in as an array beside the vector: inside the element function it would be summed
    up again for every element.
    """
    wide, norm = vector.cast("array<double>"), l2_norm(vector)
    divisor = F.when(norm < eps, 1.0).otherwise(norm)
    return F.zip_with(wide, F.array_repeat(divisor, F.size(wide)), lambda x, n: x / n)


def zero_if_missing(vector: Column, dim: int) -> Column:
    """A zero vector where there is none."""
    return F.coalesce(vector.cast("array<double>"), F.array_repeat(F.lit(0.0), dim))


def to_float32(vector: Column) -> Column:
    """Single precision for output."""
    return vector.cast("array<float>")
