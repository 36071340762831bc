"""Co-visitation edges and the candidate features built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sessionrank.functions.numbers import ratio
from sessionrank.operators.filters import with_scalars
from sessionrank.operators.order import EVENT_TIES, in_order, with_micros
from sessionrank.operators.ranks import any_rank, keep_any_rank, percent, row_numbers
from sessionrank.schema import ACTIONS, action_weight
from sessionrank.settings import both_dealt, hot_rows, stage

CVRS = ("cvr_click_to_cart_order", "cvr_cart_to_order")
COUNTS = tuple(f"count_{a}" for a in ACTIONS)
ALL_COUNTS = (*COUNTS, "count_all", "weighted_count_all")
LIST_ROWS = 1000  # neighbours of an item in one row
EXPANDED_ROWS = 500_000  # rows of (session, neighbour) that a task sums and ranks


def pair_cvr(counts: DataFrame) -> DataFrame:
    """Add smoothed conversion rates of a pair; the averages run over all pairs.

    The counts are read for the averages and for the rates, so they are written once.
    """
    counts = stage(counts)
    means = counts.agg(F.avg("count_clicks").alias("_mean_clicks"), F.avg("count_carts").alias("_mean_carts"))
    clicks, carts, orders = (F.col(c) for c in COUNTS)
    return (
        with_scalars(counts, means)
        .withColumn(CVRS[0], ratio(carts + orders, clicks + F.col("_mean_clicks")))
        .withColumn(CVRS[1], ratio(orders, carts + F.col("_mean_carts")))
        .drop("_mean_clicks", "_mean_carts")
    )


def top_neighbours(
    counts: DataFrame,
    scores: Sequence[str],
    k: int = 300,
    min_count: int = 2,
    then: Sequence[str] = CVRS,
) -> DataFrame:
    """Keep a pair if one of its scores is large enough and among the ``k`` best of ``aid_x``.

    One pass: rows whose score reaches ``min_count`` sort before all others of their list, so
    ranking everything and testing both conditions gives the same union of lists. Pairs
    without any such score, most of a co-visit table, are left out before the sorts. An item
    with very many neighbours is ranked by many tasks.
    """
    counts = counts.where(F.greatest(*[F.col(s) for s in scores], F.lit(min_count - 1)) >= min_count)
    rank = {
        f"_rank_{score}": [*[F.col(c).desc_nulls_last() for c in (score, *then)], F.col("aid_y").asc()] for score in scores
    }
    keep = None
    for score in scores:
        hit = (F.col(score) >= min_count) & (F.col(f"_rank_{score}") <= k)
        keep = hit if keep is None else keep | hit
    return row_numbers(counts, "aid_x", rank).where(keep).drop(*rank)


def top_transitions(norm: DataFrame, k: int = 500) -> DataFrame:
    """Keep a transition among the ``k`` best of its first item by either normalised count.

    The table is counted and ranked, so it is written once.
    """
    return keep_any_rank(
        stage(norm),
        "aid_x",
        {"_r1": "norm_transition_count", "_r2": "norm_transition_user_count"},
        k,
        tie="aid_y",
    ).drop("_r1", "_r2")


def history(ev: DataFrame, time_weight: bool = False) -> DataFrame:
    """Items of the target sessions, one row per (session, aid).

    ``n`` events, ``w``/``ww`` sum of the action weight and of its square; with
    ``time_weight`` also the recency weight ``2**(percent_rank + 0.1) - 1`` summed alone
    (``tw``) and times the action weight (``twt``).
    """
    target = ev.where(F.col("split") != "train")
    weight = action_weight()
    if time_weight:
        placed = in_order(with_micros(target), ["session"], "us", EVENT_TIES, want={"_rank": "rank", "_size": "size"})
        recency = F.pow(F.lit(2.0), percent(F.col("_rank"), F.col("_size")) + 0.1) - 1
        target = placed.withColumn("_recency", recency)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"), F.sum(weight * weight).alias("ww")]
    if time_weight:
        aggs += [F.sum("_recency").alias("tw"), F.sum(F.col("_recency") * weight).alias("twt")]
    return target.groupBy("session", "aid").agg(*aggs)


def expand(latest: DataFrame, edges: DataFrame, how: str = "inner") -> DataFrame:
    """Neighbours of the items of a session.

    ``latest`` has one row per (session, aid), so repeated events do not multiply the join,
    and ``edges`` is cut to the best neighbours per item. A popular item meets many sessions;
    its join partition is split at run time (adaptive skew join). That needs a shuffle right
    below both sides of the join, so the edges are written first: as they come, they are
    already dealt by their first item.
    """
    return _meet(latest, stage(edges), how)


def _meet(latest: DataFrame, edges: DataFrame, how: str = "inner") -> DataFrame:
    return both_dealt(latest, edges.withColumnRenamed("aid_x", "aid"), ["aid"], how).withColumnRenamed("aid", "aid_x")


class Spread:
    """Sum, mean and sample deviation of ``value * factor`` over events, from folded rows.

    A folded row stands for n events with factors of sum s and square sum q, so the event
    sums are value*s and value**2*q. Sums are aggregated first (``aggs``); mean and
    deviation follow from them (``rest``), after ranking, so that sorts move fewer columns.
    """

    def __init__(self, prefix: str, label: str, value: str, factor: str, count: str, stddev: bool):
        self.names = {fn: f"{fn}_{prefix}_{label}" for fn in ("sum", "avg", "stddev")}
        self.value, self.factor, self.count, self.stddev = value, factor, count, stddev
        self.squares = f"_squares_{label}"

    def aggs(self) -> dict[str, Column]:
        out = {self.names["sum"]: F.sum(F.col(self.value) * F.col(self.factor))}
        if self.stddev:
            v = F.col(self.value).cast("double")
            out[self.squares] = F.sum(v * v * F.col("ww" if self.factor == "w" else self.factor))
        return out

    def rest(self) -> dict[str, Column]:
        total, count = F.col(self.names["sum"]).cast("double"), F.col(self.count)
        out = {self.names["avg"]: total / count}
        if self.stddev:
            full = F.col(self.squares) * count
            rest = full - total * total
            # whole-number sums are exact here; for others, below rounding error it is 0
            safe = F.when(rest > full * 1e-13, rest).otherwise(F.lit(0.0))
            out[self.names["stddev"]] = F.sqrt(F.try_divide(safe, count * (count - 1)))
        return out


def neighbour_lists(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """The edges of an item as one row: ``aid_x`` and an array, in one order, for each other column.

    ``longest`` is a number of neighbours that no item exceeds. Where it is not known, or above
    ``LIST_ROWS``, the edges are written and counted, and longer lists are cut into pieces of about that many.
    """
    columns = [c for c in edges.columns if c != "aid_x"]
    keys = ["aid_x"]
    if longest is None or longest > LIST_ROWS:
        edges = stage(edges)
        sizes = edges.groupBy("aid_x").agg(F.count(F.lit(1)).alias("_n"))
        if (sizes.agg(F.max("_n")).first()[0] or 0) > LIST_ROWS:
            pieces = stage(sizes.select("aid_x", F.ceil(F.col("_n") / LIST_ROWS).alias("_pieces")))
            number = F.pmod(F.xxhash64("aid_y"), F.col("_pieces")).alias("_piece")
            edges = both_dealt(edges, pieces, ["aid_x"]).select("aid_x", *columns, number)
            keys.append("_piece")
    lists = edges.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("_edges"))
    return lists.select("aid_x", *[F.col("_edges")[c].alias(c) for c in columns])


def _rank_neighbours(
    latest: DataFrame, edges: DataFrame, aggs: dict[str, Column], scores: dict, k: int, longest: int | None = None
) -> DataFrame:
    """Aggregate per (session, neighbour), rank and keep.

    What meets is an item of a session and the list of its neighbours, and lists travel to the session
    whole: they are opened, summed and ranked by the task that gets them, so that no row of a (session,
    neighbour) is shuffled. The lists that each session will get are counted first, from their sizes: a task gets
    those of about ``EXPANDED_ROWS`` rows. Where one session would get more than ``hot_rows``, the
    rows are dealt by (session, neighbour) and ranked in ranges. A session has at most all neighbours of the edges.
    """
    spark = latest.sparkSession
    lists, latest = stage(neighbour_lists(edges, longest)), stage(latest)
    columns = [c for c in lists.columns if c != "aid_x"]
    sizes = lists.select("aid_x", F.size("aid_y").alias("_n"))
    per_session = _meet(latest.select("session", "aid"), sizes).groupBy("session").agg(F.sum("_n").alias("_n"))
    most, total = per_session.agg(F.max("_n"), F.sum("_n")).first()
    found = _meet(latest, lists).drop("aid_x")
    if plain := (most or 0) <= hot_rows(spark):
        tasks = max(spark.sparkContext.defaultParallelism, -(-(total or 0) // EXPANDED_ROWS))
        found = found.repartition(tasks, "session")
    opened = found.select(*[c for c in latest.columns if c != "aid"], F.inline(F.arrays_zip(*columns)))
    scored = opened.groupBy("session", F.col("aid_y").alias("aid")).agg(*[v.alias(n) for n, v in aggs.items()])
    members = most or 0 if plain else lists.select(F.explode("aid_y"))
    return keep_any_rank(scored, "session", scores, k, members=members)


def _score_neighbours(
    latest: DataFrame, edges: DataFrame, spreads: list[Spread], more: dict[str, Column], scores: dict, k: int, longest: int | None = None
) -> DataFrame:
    """Neighbours ranked and kept, with complete statistics."""
    aggs = {name: agg for s in spreads for name, agg in s.aggs().items()} | more
    kept = _rank_neighbours(latest, edges, aggs, scores, k, longest)
    rest = {name: col for s in spreads for name, col in s.rest().items()}
    return kept.withColumns(rest).drop(*[s.squares for s in spreads])


# Float scores are compared in steps of this size, so that the order in which partial sums
# arrive cannot change a rank.
SCORE_STEP = 1e-9


def _steady(score: str) -> Column:
    return F.rint(F.col(score) / SCORE_STEP)


def covisit_features(
    ev: DataFrame,
    edges: DataFrame,
    prefix: str,
    counts: Sequence[str] = COUNTS,
    stddev: bool = False,
    k: int | None = 1000,
    short_names: bool = True,
    count_rank_by_events: bool = False,
) -> DataFrame:
    """Score the neighbours of each target session and keep those ranked well by any score.

    Per (session, neighbour): sum, mean (and deviation) of the pair counts over the session's
    events, plain and times the action weight, the same of the conversion rates, and a rank
    per score. ``short_names`` names ranks by action (``..._click``), otherwise by count
    column; ``count_rank_by_events`` ranks by events instead of by summed action weight.
    """
    P = prefix
    events = f"covisit_{P}_count"
    spreads = []
    for c in counts:
        spreads += [Spread(P, f"type_{c}", c, "w", events, stddev), Spread(P, c, c, "n", events, stddev)]
    spreads += [Spread(P, c, c, "n", events, stddev) for c in CVRS]

    def short(c: str) -> str:
        return c.removeprefix("count_").removesuffix("s") if short_names else c

    scores: dict[str, Column | str] = {}
    for c in counts:
        scores[f"rn_covisit_{P}_type_{short(c)}"] = f"sum_{P}_type_{c}"
        scores[f"rn_covisit_{P}_{short(c)}"] = f"sum_{P}_{c}"
    scores[f"rn_covisit_{P}_type_aid_count"] = f"covisit_{P}_type_count"
    scores[f"rn_covisit_{P}_aid_count"] = events if count_rank_by_events else f"covisit_{P}_type_count"
    for c in CVRS:
        scores[f"rn_covisit_{P}_{c}"] = _steady(f"sum_{P}_{c}")
    more = {f"covisit_{P}_type_count": F.sum("w"), events: F.sum("n")}
    return _score_neighbours(history(ev), edges, spreads, more, scores, k)


def weighted_covisit_features(ev: DataFrame, weights: DataFrame, prefix: str, k: int = 1000) -> DataFrame:
    """Score neighbours by pair weight: plain, times action weight, recency, and both."""
    P = prefix
    w = F.col("weight")
    sums = {"": F.sum(w * F.col("n")), "type_": F.sum(w * F.col("w")), "time_": F.sum(w * F.col("tw")), "type_time_": F.sum(w * F.col("twt"))}
    events = {"": "n", "type_": "w", "time_": "tw", "type_time_": "twt"}
    aggs: dict[str, Column] = {}
    for s, total in sums.items():
        aggs[f"sum_{P}_{s}weight"] = total
        aggs[f"avg_{P}_{s}weight"] = total / F.sum("n")
        aggs[f"covisit_{P}_{s}count"] = F.sum(events[s])
    scores = {
        f"rn_{P}": f"sum_{P}_weight",
        f"rn_time_weight_{P}": _steady(f"sum_{P}_time_weight"),
        f"rn_type_weight_{P}": f"sum_{P}_type_weight",
        f"rn_type_time_weight_{P}": _steady(f"sum_{P}_type_time_weight"),
    }
    return _rank_neighbours(history(ev, time_weight=True), weights, aggs, scores, k)


def bigram_features(ev: DataFrame, norm: DataFrame, prefix: str, k_item: int = 500, k: int = 1000) -> DataFrame:
    """Score the followers of a session's items by normalised transition counts."""
    P = prefix
    names = ("norm_transition_count", "norm_transition_user_count")
    events = f"{P}_count"
    spreads = []
    scores: dict[str, Column | str] = {}
    for c in names:
        spreads += [Spread(P, f"type_weight_{c}", c, "w", events, True), Spread(P, c, c, "n", events, True)]
        scores[f"rn_{P}_type_weight_{c}"] = _steady(f"sum_{P}_type_weight_{c}")
        scores[f"rn_{P}_{c}"] = _steady(f"sum_{P}_{c}")
    scores[f"rn_{P}_type_weight_aid_count"] = f"{P}_type_weight_count"
    scores[f"rn_{P}_aid_count"] = events
    more = {f"{P}_type_weight_count": F.sum("w"), events: F.sum("n")}
    # an edge is kept by either of two ranks
    return _score_neighbours(history(ev), top_transitions(norm, k_item), spreads, more, scores, k, longest=2 * k_item)


def candidates_of(features: DataFrame, k: int) -> DataFrame:
    """The (session, aid) rows of a feature table that some rank puts among the first ``k``."""
    ranks = [c for c in features.columns if c.startswith("rn_")]
    return features.where(any_rank(ranks, k))


def covisit_matrix(counts: DataFrame, score: str = "weight", k: int = 20) -> DataFrame:
    """Edge list in matrix form: weight, share of the item's total weight, and rank from 0.

    Totals are an aggregate and ranks come from ``row_numbers``, so an item with very many
    neighbours spans tasks. The counts are read for both and written once.
    """
    rows = stage(counts.select(F.col("aid_x").alias("aid"), "aid_y", F.col(score).alias("_score")))
    totals = rows.groupBy("aid").agg(F.sum("_score").alias("_total"))
    ranked = row_numbers(rows, "aid", {"_rank": [F.col("_score").desc(), F.col("aid_y").asc()]}).where(F.col("_rank") <= k)
    return ranked.join(totals, "aid").select(
        "aid",
        "aid_y",
        F.col("_score").cast("double").alias("wgt"),
        (F.col("_score") / F.col("_total")).alias("wgt_rel"),
        (F.col("_rank") - 1).cast("long").alias("n"),
    )


def matrix_features(pairs: DataFrame, matrix: DataFrame, suffix: str) -> DataFrame:
    """Neighbours of the distinct items of a session, with weight statistics per neighbour.

    The matrix is written first, as in ``expand``, so that a popular item can be split.
    """
    items = pairs.select("session", "aid").distinct()
    return (
        both_dealt(items, stage(matrix), ["aid"])
        .groupBy("session", F.col("aid_y").alias("aid"))
        .agg(
            F.sum("wgt").alias(f"wgt_{suffix}_sum"),
            F.avg("wgt").alias(f"wgt_{suffix}_mean"),
            F.sum("wgt_rel").alias(f"wgt_rel_{suffix}_sum"),
            F.avg("wgt_rel").alias(f"wgt_rel_{suffix}_mean"),
            F.min("n").alias(f"{suffix}_indmin"),
            F.count(F.lit(1)).alias(f"{suffix}_num"),
        )
    )


def matrix_counts(df: DataFrame, versions: Sequence[str]) -> DataFrame:
    """Fill the gaps of the matrix columns and count how many matrices proposed the item."""
    fills: dict[str, Column] = {}
    for v in versions:
        fills[f"{v}_num"] = F.coalesce(F.col(f"{v}_num"), F.lit(0))
        for c in (f"{v}_indmin", f"wgt_{v}_sum", f"wgt_{v}_mean", f"wgt_rel_{v}_sum", f"wgt_rel_{v}_mean"):
            fills[c] = F.coalesce(F.col(c), F.lit(-1))
    filled = df.withColumns(fills)

    def plus(cols: list[Column]) -> Column:
        total = cols[0]
        for c in cols[1:]:
            total = total + c
        return total

    return filled.withColumns(
        {
            "matrices_num": plus([(F.col(f"{v}_num") > 0).cast("long") for v in versions]),
            "matrices_numsum": plus([F.col(f"{v}_num") for v in versions]),
            "matrices_wgt_rel_mean": plus([F.col(f"wgt_{v}_mean") for v in versions]),
        }
    )
