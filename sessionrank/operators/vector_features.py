"""Distances between candidates, last items and sessions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from sessionrank.functions import vectors as V
from sessionrank.operators.ranks import last_item


def diff_to_session(df: DataFrame, cols: Sequence[str], label: str | None = None) -> DataFrame:
    """Distance of a value from the mean, least and greatest value of its session.

    ``df`` has one row per (session, candidate).
    """
    whole = Window.partitionBy("session")
    stats = {"avg": F.avg, "min": F.min, "max": F.max}
    return df.withColumns({f"diff_{s}_{c}": F.col(c) - fn(c).over(whole) for c in cols for s, fn in stats.items()})


def _with_last_vectors(pairs: DataFrame, ev: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs with the vectors ``v`` of the candidate and ``u`` of the session's last item.

    The last item's vector is attached per session before it meets the pairs.
    """
    last = last_item(ev, None).join(vectors.select(F.col("aid").alias("last_aid"), F.col("vector").alias("u")), "last_aid", "left")
    return (
        pairs.select("session", "aid")
        .join(last, "session", "left")
        .join(vectors.select("aid", F.col("vector").alias("v")), "aid", "left")
    )


def last_item_distances(
    pairs: DataFrame, ev: DataFrame, vectors: DataFrame, prefix: str, types: Sequence[str | None] = ("carts", "orders", None)
) -> DataFrame:
    """Dot product and L2 distance of a candidate to the session's last item, and last item of an action.

    Vectors of unit length are expected, so the dot product is the cosine. The last items'
    vectors are brought together per session; the candidate's vector is joined once, and all
    distances share one window.
    """
    u = vectors.select(F.col("aid").alias("last_aid"), "vector")
    lasts = [last_item(ev, t).join(u, "last_aid", "left").select("session", F.col("vector").alias(f"_u{i}")) for i, t in enumerate(types)]
    of_session = reduce(lambda x, y: x.join(y, "session", "full"), lasts)
    both = (
        pairs.select("session", "aid")
        .join(of_session, "session", "left")
        .join(vectors.select("aid", F.col("vector").alias("v")), "aid", "left")
    )
    cols = {}
    for i, t in enumerate(types):
        head = prefix if t is None else f"last_{t[:-1]}_{prefix}"
        cols[f"{head}_cosine_similarity"] = V.dot("v", f"_u{i}")
        cols[f"{head}_l2_distance"] = V.l2("v", f"_u{i}")
    return diff_to_session(both.select("session", "aid", *[c.alias(n) for n, c in cols.items()]), list(cols))


def last_item_distance(
    pairs: DataFrame, ev: DataFrame, vectors: DataFrame, prefix: str, type: str | None = None
) -> DataFrame:
    """The distances to one last item."""
    return last_item_distances(pairs, ev, vectors, prefix, [type])


def last_item_angle(pairs: DataFrame, ev: DataFrame, vectors: DataFrame, suffix: str) -> DataFrame:
    """Squared distance and cosine of a candidate to the session's last item."""
    both = _with_last_vectors(pairs, ev, vectors)
    return both.select(
        "session", "aid", V.squared_l2("v", "u").alias(f"emb_diff_{suffix}"), V.cosine("v", "u").alias(f"emb_angle_{suffix}")
    )


def user_item_dot(
    pairs: DataFrame, user_vecs: DataFrame, item_vecs: DataFrame, name: str = "bpr_distance", zero_missing: bool = False
) -> DataFrame:
    """Dot product of session and item vectors; a missing vector gives NULL or counts as zeros."""
    both = (
        pairs.select("session", "aid")
        .join(user_vecs.select("session", "session_vector"), "session", "left")
        .join(item_vecs.select("aid", "aid_vector"), "aid", "left")
    )
    value = V.dot("session_vector", "aid_vector")
    if zero_missing:
        value = F.coalesce(value, F.lit(0.0))
    return diff_to_session(both.select("session", "aid", value.alias(name)), [name])
