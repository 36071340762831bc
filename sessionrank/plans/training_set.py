"""Candidate union, feature assembly and sampling of the two dataset variants."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from sessionrank.operators.candidates import explode_neighbours, grow_outer, union_candidates
from sessionrank.operators.covisit import matrix_counts, matrix_features
from sessionrank.operators.dataset import (
    PAIR,
    add_item_age,
    add_label_flags,
    add_labels,
    assemble,
    sampled_dataset,
    session_clock_keys,
    session_has_label,
)
from sessionrank.operators.filters import semi, target_sessions, with_labels
from sessionrank.operators.items import item_features, item_frame, item_hourly, item_repeat_frame
from sessionrank.operators.session_items import (
    relative_features,
    session_item_actions,
    session_item_cvr,
    session_item_features,
    session_item_recency,
)
from sessionrank.operators.sessions import session_features, session_frame
from sessionrank.operators.vector_features import last_item_angle, last_item_distances, user_item_dot
from sessionrank.plans import candidate_tables as C
from sessionrank.schema import ACTIONS
from sessionrank.settings import apart, stage, stage_by

# Which tables the two variants use.
CANDIDATE_SOURCES = (
    "click2click_covisit_1hour",
    "covisit_items_window_size5_v3",
    "covisit_bigram_v2",
    "covisit_items_1days",
)
FEATURE_TABLES = {
    "067": (
        "click2click_covisit_1hour",
        "covisit_items_window_size5_v4",
        "covisit_bigram_v2",
        "covisit_items_1days",
        "covisit_items_1hour",
    ),
    "069": (
        "click2click_covisit_1hour",
        "covisit_items_window_size5_v4",
        "covisit_bigram_v2",
        "covisit_items_1days",
        "covisit_items_1hour",
        "cart_order2cart_order_covisit_1hour",
    ),
}


@dataclass
class Vectors:
    """Vector tables: item vectors by name, and session/item factors."""

    items: dict[str, DataFrame]
    sessions: DataFrame
    factors: DataFrame


def user_item(
    ev: DataFrame,
    features: dict[str, DataFrame],
    variant: str = "067",
    neighbours: DataFrame | None = None,
    similar: DataFrame | None = None,
    limits: dict[str, int] | None = None,
) -> DataFrame:
    """Candidate pairs. Variant 067 adds factor neighbours and similar items to 069."""
    sources = [C.candidates(features[n], n, (limits or {}).get(n)) for n in CANDIDATE_SOURCES]
    if variant == "067":
        if neighbours is not None:
            sources.append(explode_neighbours(neighbours))
        if similar is not None:
            sources.append(similar)
    return union_candidates(ev, sources)


def dataset(
    ev: DataFrame,
    pairs: DataFrame,
    features: dict[str, DataFrame],
    ground_truth: DataFrame,
    vectors: Vectors | None = None,
    variant: str = "067",
    hours: tuple[int | None, int | None] = (None, None),
) -> DataFrame:
    """Candidate pairs with all features, item ages and labels.

    Session features are computed for the sessions to predict for alone; items and averages
    use the whole log. ``pairs`` has each pair once, as ``user_item`` gives them. Tables on the
    pair are written in buckets of it, so that their joins move no rows.
    """
    mine = stage(semi(ev, target_sessions(ev), ["session"]))
    base = pairs.select("session", "aid", "split").join(session_clock_keys(mine), "session", "left")
    counts = by_pair_buckets(session_item_features(mine))
    items = item_features(ev)
    made = [session_item_recency(mine)]
    if variant == "069":
        made.append(session_item_cvr(counts, items, ev))
    if vectors is not None:
        made += [last_item_distances(pairs, mine, v, name) for name, v in vectors.items.items()]
        made.append(user_item_dot(pairs, vectors.sessions, vectors.factors))
    by_pair = [counts, *map(by_pair_buckets, made), *[features[n] for n in FEATURE_TABLES[variant]]]
    tables = [
        (session_features(mine), ("session",)),
        (item_repeat_frame(ev), ("aid",)),
        (items, ("aid",)),
        (item_hourly(ev, *hours), ("aid", "ts_hour")),
        *[(t, PAIR) for t in by_pair],
    ]
    return add_labels(add_item_age(assemble(base, tables, bucketed=True)), ground_truth)


def by_pair_buckets(df: DataFrame) -> DataFrame:
    """Write a table in buckets of (session, aid)."""
    return stage_by(df, PAIR)


def packed(df: DataFrame) -> DataFrame:
    """Write a table that is as large as the result."""
    return stage(df, "zstd")


def build(
    ev: DataFrame,
    ground_truth: DataFrame,
    vectors: Vectors | None = None,
    variant: str = "067",
    neighbours: DataFrame | None = None,
    similar: DataFrame | None = None,
    limits: dict[str, int] | None = None,
    keep: Callable[[DataFrame], DataFrame] = packed,
    keep_features: Callable[[DataFrame], DataFrame] = by_pair_buckets,
) -> tuple[DataFrame, DataFrame]:
    """Dataset and sampled dataset of a variant.

    ``keep`` writes the pairs and the dataset, ``keep_features`` the feature tables, which
    several later steps read; by default they are written to the shared folder, the features in
    buckets of the pair. They must have read a table when they return: what was written on the
    way to it is deleted then, so that of all tables only the dataset is left.
    """

    def feature(n: str) -> DataFrame:
        return apart(lambda: C.TABLES[n](ev), keep_features)

    def found(features: dict[str, DataFrame]) -> DataFrame:
        only_found = {n: feature(n) for n in CANDIDATE_SOURCES if n not in features}
        return user_item(ev, features | only_found, variant, neighbours, similar, limits)

    def made() -> DataFrame:
        features = {n: feature(n) for n in FEATURE_TABLES[variant]}
        pairs = apart(lambda: found(features), keep)
        return dataset(ev, pairs, features, ground_truth, vectors, variant)

    full = apart(made, keep)
    return full, sampled_dataset(full, written=True)


def frame(
    ev_train: DataFrame,
    ev_test: DataFrame,
    matrices: dict[str, DataFrame],
    labels: DataFrame | None = None,
    vectors: dict[str, DataFrame] | None = None,
    reduce_to: Sequence[str] | None = None,
) -> DataFrame:
    """Training frame of the dataframe half: history and matrices, all features, labels.

    ``reduce_to`` keeps only the sessions with a label of one of these actions.
    """
    log = ev_test if reduce_to is None or labels is None else with_labels(ev_test, labels, reduce_to)
    own = log.select("session", "aid").distinct()
    grown = grow_outer(own, [matrix_features(own, m, v) for v, m in matrices.items()])
    out = (
        matrix_counts(grown, list(matrices))
        .join(session_frame(log), "session", "left")
        .join(item_frame(ev_train, ev_test), "aid", "left")
        .join(session_item_actions(log), ["session", "aid"], "left")
    )
    out = relative_features(out)
    for suffix, v in (vectors or {}).items():
        out = out.join(last_item_angle(own_pairs(out), log, v, suffix), ["session", "aid"], "left")
    if labels is not None:
        out = add_label_flags(out, labels)
        for a in ACTIONS:
            out = session_has_label(out, f"{a}_gt")
    return out.drop(
        "session_last_ts", *[f"a2s_last_{n}_ts" for n in ("action", "click", "cart", "order")]
    )


def own_pairs(df: DataFrame) -> DataFrame:
    return df.select("session", "aid").where(F.col("aid").isNotNull())
