"""The six co-visitation feature tables and their candidate lists, end to end.

Each function takes the log and returns the feature table of the target sessions;
``candidates`` cuts it to the rows that some rank puts in front. Limits are the fixed
defaults of the method and can be lowered for small data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sessionrank.operators.covisit import (
    ALL_COUNTS,
    COUNTS,
    bigram_features,
    candidates_of,
    covisit_features,
    pair_cvr,
    top_neighbours,
    weighted_covisit_features,
)
from sessionrank.operators.pairs import (
    normalise_transitions,
    pair_flags,
    pair_type_counts,
    pair_weight,
    transitions,
    window_flags,
)

# List limits of the candidate tables.
FEATURE_LIMIT = 1000
NEIGHBOUR_LIMIT = 300
TRANSITION_LIMIT = 500
CANDIDATE_LIMITS = {
    "click2click_covisit_1hour": 30,
    "cart_order2cart_order_covisit_1hour": 30,
    "covisit_items_1hour": 30,
    "covisit_items_1days": 30,
    "covisit_items_window_size5_v3": 100,
    "covisit_items_window_size5_v4": 100,
    "covisit_bigram_v2": 50,
}


def same_hour(ev: DataFrame, prefix: str, types: list[str], max_gap: int = 3600, k: int = FEATURE_LIMIT) -> DataFrame:
    """Items of the given actions met within ``max_gap`` seconds, scored by pair weight."""
    flags = pair_flags(ev, max_gap, "SECOND", True, types)
    return weighted_covisit_features(ev, pair_weight(flags), prefix, k)


def click2click_covisit_1hour(ev: DataFrame, **kw) -> DataFrame:
    return same_hour(ev, "click2click_covisit_1hour", ["clicks"], **kw)


def cart_order2cart_order_covisit_1hour(ev: DataFrame, **kw) -> DataFrame:
    return same_hour(ev, "cart_order2cart_order_covisit_1hour", ["carts", "orders"], **kw)


def _by_type_counts(ev, flags, prefix, k_item, k, stddev=False, totals=False) -> DataFrame:
    counts = ALL_COUNTS if totals else COUNTS
    edges = top_neighbours(pair_cvr(pair_type_counts(flags, totals)), counts, k_item)
    return covisit_features(
        ev, edges, prefix, counts, stddev=stddev, k=k, short_names=not totals, count_rank_by_events=totals
    )


def covisit_items_1hour(ev: DataFrame, k_item: int = NEIGHBOUR_LIMIT, k: int = FEATURE_LIMIT) -> DataFrame:
    """Pairs less than two hours apart (at most one whole hour)."""
    return _by_type_counts(ev, pair_flags(ev, 1, "HOUR", False), "covisit_items_1hour", k_item, k)


def covisit_items_1days(ev: DataFrame, k_item: int = NEIGHBOUR_LIMIT, k: int = FEATURE_LIMIT) -> DataFrame:
    """Pairs less than 25 hours apart (at most 24 whole hours)."""
    return _by_type_counts(ev, pair_flags(ev, 24, "HOUR", False), "covisit_items_1days", k_item, k)


def covisit_items_window_size5_v3(ev: DataFrame, k_item: int = NEIGHBOUR_LIMIT, k: int = FEATURE_LIMIT) -> DataFrame:
    """Pairs at most two positions apart."""
    return _by_type_counts(ev, window_flags(ev, 2, "row_number"), "covisit_items_window_size5_v3", k_item, k, stddev=True)


def covisit_items_window_size5_v4(
    ev: DataFrame, k_item: int = NEIGHBOUR_LIMIT, k: int = FEATURE_LIMIT, last_n: int = 30
) -> DataFrame:
    """Pairs at most two distinct times apart, among the last ``last_n`` times of a session."""
    flags = window_flags(ev, 2, "dense_rank", last_n)
    return _by_type_counts(ev, flags, "covisit_items_window_size5_v4", k_item, k, stddev=True, totals=True)


def covisit_bigram_v2(ev: DataFrame, k_item: int = TRANSITION_LIMIT, k: int = FEATURE_LIMIT) -> DataFrame:
    """Items that follow a session's items, by normalised transition counts."""
    return bigram_features(ev, normalise_transitions(transitions(ev)), "covisit_bigram_v2", k_item, k)


TABLES = {
    f.__name__: f
    for f in (
        click2click_covisit_1hour,
        cart_order2cart_order_covisit_1hour,
        covisit_items_1hour,
        covisit_items_1days,
        covisit_items_window_size5_v3,
        covisit_items_window_size5_v4,
        covisit_bigram_v2,
    )
}


def candidates(features: DataFrame, name: str, k: int | None = None) -> DataFrame:
    """Candidate rows of a feature table."""
    return candidates_of(features, k or CANDIDATE_LIMITS[name])
