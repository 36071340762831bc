"""Selections, semi joins and unions on logs and candidate tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sessionrank.operators.order import EVENT_TIES, in_order, with_micros


def of_types(ev: DataFrame, types: Sequence[str]) -> DataFrame:
    return ev.where(F.col("type").isin(*types))


def target_sessions(ev: DataFrame) -> DataFrame:
    """Sessions to predict for."""
    return ev.where(F.col("split") != "train").select("session").distinct()


def shard(df: DataFrame, n: int, keep: Sequence[int], col: str = "session") -> DataFrame:
    """Sampling operator: keep the sessions whose number modulo ``n`` is in ``keep``."""
    return df.where(F.pmod(F.col(col), F.lit(n)).isin(*keep))


def shard_sessions(ev: DataFrame, split: str, n: int, keep: Sequence[int]) -> DataFrame:
    """Distinct sessions of a split that fall into the given shards."""
    return shard(ev.where(F.col("split") == split), n, keep).select("session").distinct()


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return df.join(keys.select(*on), list(on), "left_semi")


def with_labels(ev: DataFrame, labels: DataFrame, types: Sequence[str] = ("carts", "orders")) -> DataFrame:
    """Events of the sessions that have a label of one of the actions."""
    return semi(ev, of_types(labels, types), ["session"])


def dedup_consecutive(ev: DataFrame) -> DataFrame:
    """Drop an event on the same item as the event just before it in the session."""
    seen = in_order(
        with_micros(ev), ["session"], "us", EVENT_TIES, want={"_before": "prev"}, carry=["aid"]
    )
    return seen.where(F.col("_before").isNull() | (F.col("_before.aid") != F.col("aid"))).select(*ev.columns)


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def common_sessions(dfs: Sequence[DataFrame]) -> DataFrame:
    """Sessions present in every table."""
    return reduce(lambda a, b: a.intersect(b), [d.select("session") for d in dfs])


def lookup(df: DataFrame, other: DataFrame, on: Sequence[str], defaults: dict) -> DataFrame:
    """Left join of the columns named in ``defaults``, which also fill missing values."""
    joined = df.join(other.select(*on, *defaults), list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate as a scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()
    return df.withColumns({c: packed.getField(c) for c in one_row.columns})
