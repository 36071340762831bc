"""Divisions that neither raise nor hide a missing denominator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(num: Column, den: Column) -> Column:
    """``num / den``; NULL where the denominator is 0 or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def open_ratio(num: Column, den: Column) -> Column:
    """Float division of the dataframe kind: x/0 is infinite, 0/0 is NULL."""
    return F.when((den == 0) & (num > 0), F.lit(float("inf"))).otherwise(ratio(num, den))


def or_else(col: Column, default) -> Column:
    return F.coalesce(col, F.lit(default))
