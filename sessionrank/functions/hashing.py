"""Reproducible pseudo-random numbers from keys.

A draw depends on the key and the seed only, so re-run tasks repeat it, and any engine
with MD5 can check it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def draw(*keys: str | Column, seed: int = 0) -> Column:
    """Uniform integer in [0, 2**32) for the given keys."""
    text = F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def bucket(*keys: str | Column, n: int, seed: int = 0) -> Column:
    """Uniform integer in [0, n)."""
    return F.pmod(draw(*keys, seed=seed), F.lit(n)).cast("long")
