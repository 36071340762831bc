"""Candidate lists: unions of sources and neighbour expansion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sessionrank.operators.filters import target_sessions, union_all
from sessionrank.schema import ACTIONS, is_action


def union_candidates(ev: DataFrame, sources: Sequence[DataFrame]) -> DataFrame:
    """Distinct (session, aid, split) of all sources and the sessions' own items.

    Only sessions to predict for are kept.
    """
    targets = target_sessions(ev)
    splits = ev.select("session", "split").distinct().join(targets, "session", "left_semi")
    own = ev.select("session", "aid").join(targets, "session", "left_semi")
    keys = union_all([own, *[s.select("session", "aid") for s in sources]]).where(F.col("aid").isNotNull()).distinct()
    return keys.join(splits, "session").select("session", "aid", "split")


def grow_outer(pairs: DataFrame, feature_tables: Sequence[DataFrame]) -> DataFrame:
    """Own items and every table's (session, aid) rows, with the columns of all tables.

    Equal to repeated outer joins: the keys are united once, then each table joins left.
    """
    on = ["session", "aid"]
    keys = union_all([pairs.select(*on), *[t.select(*on) for t in feature_tables]]).distinct()
    return reduce(lambda a, t: a.join(t, on, "left"), feature_tables, keys)


def explode_neighbours(neighbours: DataFrame, key: str = "session") -> DataFrame:
    """One row per (key, neighbour) with its similarity and place (0 first)."""
    zipped = F.arrays_zip(F.col("neighbor_aids").alias("aid"), F.col("cosine_similarity").alias("similarity"))
    return neighbours.select(key, F.posexplode(zipped).alias("place", "z")).select(
        key, F.col("z.aid").alias("aid"), F.col("z.similarity").alias("similarity"), "place"
    )


def neighbour_candidates(ev: DataFrame, neighbours: DataFrame, min_sim: float = 0.85) -> DataFrame:
    """Neighbours of the last clicked, carted and ordered item of a session.

    A neighbour stays if its similarity to one of the three reaches ``min_sim``; the item
    itself is left out. The three last items are one aggregate over the log.
    """
    place = F.struct("ts", "aid")
    last = ev.groupBy("session").agg(
        *[F.max_by(F.when(is_action(a), F.col("aid")), F.when(is_action(a), place)).alias(a) for a in ACTIONS]
    )
    starts = last.select(
        "session",
        F.explode(F.array(*[F.struct(F.lit(a).alias("kind"), F.col(a).alias("start")) for a in ACTIONS])).alias("s"),
    ).select("session", "s.kind", "s.start")
    # lists travel to the starts and become rows there
    near = starts.where(F.col("start").isNotNull()).join(neighbours.withColumnRenamed("aid", "start"), "start")
    zipped = F.arrays_zip(F.col("neighbor_aids").alias("aid"), F.col("cosine_similarity").alias("similarity"))
    met = near.select("session", "kind", "start", F.explode(zipped).alias("z")).select("session", "kind", "start", "z.aid", "z.similarity").where(F.col("aid") != F.col("start"))
    cols = [f"last_{a[:-1]}_cosine_similarity" for a in ACTIONS]
    wide = met.groupBy("session", "aid").agg(
        *[F.max(F.when(F.col("kind") == a, F.col("similarity"))).alias(c) for a, c in zip(ACTIONS, cols)]
    )
    return wide.where(F.greatest(*cols) >= min_sim)
