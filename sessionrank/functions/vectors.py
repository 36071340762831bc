"""Vector arithmetic on ``array<double>`` columns with higher-order functions.

All functions return NULL when a vector is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(v: str | Column) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return _total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def squared_l2(a: str | Column, b: str | Column) -> Column:
    return _total(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def l2(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of the angle; NULL if a vector is all zeros."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: str | Column) -> Column:
    """The vector at length 1; an all-zero vector stays as it is."""
    # repeated as an array, the length is computed once per row and not once per element
    length = F.array_repeat(norm(a), F.size(_col(a)))
    return F.zip_with(_col(a), length, lambda x, n: F.when(n > 0, x / n).otherwise(x))
