"""Features of items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionrank.functions.numbers import open_ratio, ratio
from sessionrank.functions.times import HOUR, epoch_dow, hour_start, seconds
from sessionrank.operators.filters import with_scalars
from sessionrank.operators.order import in_order, with_micros
from sessionrank.operators.ranks import histogram_before, position_by_count
from sessionrank.schema import ACTIONS, MISSING_POSITION, is_action
from sessionrank.settings import stage

# Short action codes used in column names of the ratio features.
CODES = {"clicks": "CL", "carts": "CA", "orders": "OR"}
STEPS = (("clicks", "carts"), ("carts", "orders"), ("clicks", "orders"))
HOURS = (1, 3, 5, 12)


def _per_session_item(ev: DataFrame) -> DataFrame:
    """Events per (session, item, action): the fold that every item count starts from."""
    return ev.groupBy("session", "aid").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(is_action(a)).alias(a) for a in ACTIONS]
    )


def _per_item(folded: DataFrame, *aggs: Column) -> DataFrame:
    """One row per item, written once: averages, ranks and rates read it again and again.

    It is as long as the catalogue, while computing it takes a pass over the log.
    """
    return stage(folded.groupBy("aid").agg(*aggs))


def item_features(ev: DataFrame) -> DataFrame:
    """Sessions and events per action, first and last time, and smoothed conversion rates.

    Counts are NULL where the item has no such action, and so are the rates built on them.
    """
    folded = ev.groupBy("session", "aid").agg(
        *[F.count_if(is_action(a)).alias(a) for a in ACTIONS], F.min("ts").alias("lo"), F.max("ts").alias("hi")
    )
    none = F.lit(None).cast("long")

    def positive(c: Column) -> Column:
        return F.when(c > 0, c).otherwise(none)

    counts = _per_item(
        folded,
        *[positive(F.count_if(F.col(a) > 0)).alias(f"n_session_{a}") for a in ACTIONS],
        *[positive(F.sum(a)).alias(f"action_count_{a}") for a in ACTIONS],
        F.min("lo").alias("action_min_ts"),
        F.max("hi").alias("action_max_ts"),
    )
    kinds = ("n_session", "action_count")
    means = counts.agg(*[F.avg(f"{k}_{a}").alias(f"_mean_{k}_{a}") for k in kinds for a in ("clicks", "carts")])
    out = with_scalars(counts, means)
    for k in kinds:
        clicks, carts, orders = (F.col(f"{k}_{a}") for a in ACTIONS)
        from_clicks = clicks + F.col(f"_mean_{k}_clicks")
        from_carts = carts + F.col(f"_mean_{k}_carts")
        out = out.withColumns(
            {
                f"{k}_cvr_click_to_cart_order": ratio(carts + orders, from_clicks),
                f"{k}_cvr_click_to_cart": ratio(carts, from_clicks),
                f"{k}_cvr_click_to_order": ratio(orders, from_clicks),
                f"{k}_cvr_cart_to_order": ratio(orders, from_carts),
            }
        )
    return out.drop(*means.columns)


def popular(features: DataFrame, type: str, k: int = 20) -> DataFrame:
    """The ``k`` items with the most sessions of an action, best first (``rn`` from 1)."""
    count = F.col(f"n_session_{type}")
    top = features.select("aid", count.alias("n")).orderBy(F.col("n").desc_nulls_last(), "aid").limit(k)
    # at most k rows are left
    return top.select("aid", F.row_number().over(Window.orderBy(F.col("n").desc_nulls_last(), "aid")).alias("rn"))


def _one_log_ratios(ev: DataFrame, suffix: str) -> DataFrame:
    """Conversion ratios, share of the mean and ranks on distinct (session, item, action)."""
    nums = _per_item(_per_session_item(ev), *[F.count_if(F.col(a) > 0).alias(f"num_{a}") for a in ACTIONS])
    means = nums.agg(*[F.avg(f"num_{a}").alias(f"_mean_{a}") for a in ACTIONS])
    out = with_scalars(nums, means)
    cols = {}
    for a, b in STEPS:
        cols[f"aid_{CODES[a]}2{CODES[b]}_{suffix}"] = open_ratio(F.col(f"num_{b}"), F.col(f"num_{a}"))
    for a in ACTIONS:
        cols[f"aid_{CODES[a]}_vs_mean_{suffix}"] = ratio(F.col(f"num_{a}"), F.col(f"_mean_{a}"))
    out = out.withColumns(cols)
    for a in ACTIONS:
        hist = histogram_before(nums, f"num_{a}")
        rank = F.col("_rows_before") + (F.col("_freq") + 1) / F.lit(2.0)
        ranks = hist.select(
            f"num_{a}",
            rank.alias(f"aid_{CODES[a]}_rank_int_{suffix}"),
            (rank / F.col("_rows")).alias(f"aid_{CODES[a]}_rank_pct_{suffix}"),
        )
        out = out.join(F.broadcast(ranks), f"num_{a}", "left")
    return out.drop(*[f"num_{a}" for a in ACTIONS], *means.columns)


def item_ratios(ev_train: DataFrame, ev_test: DataFrame) -> DataFrame:
    """Ratio features of the train log (``trn``), the test log (``tst``) and test over train.

    Missing values: -1 for ratios, ``MISSING_POSITION`` for ranks, 2 for percentile ranks.
    """
    trn, tst = _one_log_ratios(ev_train, "trn"), _one_log_ratios(ev_test, "tst")
    both = trn.join(tst, "aid", "full")
    stems = [c.removesuffix("_trn") for c in trn.columns if c != "aid"]
    change = {}
    for s in stems:
        new, old = F.col(f"{s}_tst"), F.col(f"{s}_trn")
        # infinite over infinite is undefined, like 0/0
        change[f"{s}_tst_vs_trn"] = F.when(F.isnan(open_ratio(new, old)), None).otherwise(open_ratio(new, old))
    both = both.withColumns(change)
    fills = {}
    for s in stems:
        default = float(MISSING_POSITION) if "_rank_int" in s else 2.0 if "_rank_pct" in s else -1.0
        for suffix in ("trn", "tst", "tst_vs_trn"):
            fills[f"{s}_{suffix}"] = F.coalesce(F.col(f"{s}_{suffix}"), F.lit(default))
    return both.withColumns(fills)


def item_positions(ev: DataFrame, suffix: str, default: int = MISSING_POSITION) -> DataFrame:
    """0-based position of the item by number of events, per action."""
    counts = stage(ev.groupBy("type", "aid").agg(F.count(F.lit(1)).alias("n")))
    placed = position_by_count(counts, ["type"], "n", "place")
    return placed.groupBy("aid").agg(
        *[
            F.coalesce(F.max(F.when(is_action(a), F.col("place"))), F.lit(default).cast("long")).alias(f"{a}_rating_{suffix}")
            for a in ACTIONS
        ]
    )


def item_multi_share(ev: DataFrame, suffix: str, default: float = -1.0) -> DataFrame:
    """Share of an item's sessions that repeat the action on it."""
    folded = _per_session_item(ev)
    return folded.groupBy("aid").agg(
        *[
            F.coalesce(ratio(F.count_if(F.col(a) > 1), F.count_if(F.col(a) > 0)), F.lit(default)).alias(
                f"aid_multi_{a}_percent_{suffix}"
            )
            for a in ACTIONS
        ]
    )


def item_favourite_dow(ev: DataFrame, suffix: str) -> DataFrame:
    """Weekday with the most events per item and action; the earlier weekday among equals."""
    days = ev.groupBy("aid", epoch_dow(seconds()).alias("dow")).agg(*[F.count_if(is_action(a)).alias(a) for a in ACTIONS])
    return days.groupBy("aid").agg(
        *[
            F.max_by(F.when(F.col(a) > 0, F.col("dow")), F.struct(F.col(a), -F.col("dow"))).alias(
                f"aid_{a}_favourite_dow_{suffix}"
            )
            for a in ACTIONS
        ]
    )


def item_frame(ev_train: DataFrame, ev_test: DataFrame) -> DataFrame:
    """All item columns of the dataframe half: ratios, positions, repeat shares, weekdays."""
    full = ev_train.unionByName(ev_test)
    logs = {"test": ev_test, "train": ev_train, "full": full}
    parts = [item_ratios(ev_train, ev_test)]
    for suffix, log in logs.items():
        parts += [item_positions(log, suffix), item_multi_share(log, suffix), item_favourite_dow(log, suffix)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "aid", "full")
    fills = {}
    for c in out.columns:
        if "_rating_" in c:
            fills[c] = F.coalesce(F.col(c), F.lit(MISSING_POSITION).cast("long"))
        elif "_multi_" in c:
            fills[c] = F.coalesce(F.col(c), F.lit(-1.0))
    return out.withColumns(fills)


def item_repeat(ev: DataFrame) -> DataFrame:
    """Statistics of the events per (session, item)."""
    counts = ev.groupBy("session", "aid").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("aid").agg(
        F.avg("n").alias("avg_repeat_count"),
        F.stddev_samp("n").alias("stddev_repeat_count"),
        F.min("n").alias("min_repeat_count"),
        F.max("n").alias("max_repeat_count"),
    )


def item_type_transitions(ev: DataFrame) -> DataFrame:
    """Smoothed probability of an action after the previous action on the same item.

    First actions (no previous one) count in the global average only.
    """
    steps = in_order(
        with_micros(ev), ["session", "aid"], "us", ["type"], want={"_prev": "prev"}, carry=["type"]
    )
    counts = stage(steps.groupBy("aid", F.col("_prev.type").alias("before"), "type").agg(F.count(F.lit(1)).alias("n")))
    mean = counts.agg(F.avg("n").alias("_mean"))
    total = F.sum("n").over(Window.partitionBy("aid", "before"))
    prob = with_scalars(counts.withColumn("_total", total), mean).withColumn(
        "p", ratio(F.col("n"), F.col("_total") + F.col("_mean"))
    )
    return prob.groupBy("aid").agg(
        *[
            F.sum(F.when((F.col("before") == a) & is_action(b), F.col("p"))).alias(f"transition_prob_{a}_{b}")
            for a in ACTIONS
            for b in ACTIONS
        ]
    )


def item_repeat_frame(ev: DataFrame) -> DataFrame:
    """Repeat statistics and action transitions of every item."""
    return item_repeat(ev).join(item_type_transitions(ev), "aid", "full")


def item_hour_counts(ev: DataFrame) -> DataFrame:
    """Events per item, hour (epoch second of its start) and action."""
    return ev.groupBy("aid", hour_start(seconds()).alias("ts_hour")).agg(
        *[F.count_if(is_action(a)).alias(f"hour_visit_count_{a}") for a in ACTIONS]
    )


def item_hourly(
    ev: DataFrame, start: int | None = None, end: int | None = None, hours: Sequence[int] = HOURS
) -> DataFrame:
    """Mean and deviation of the hourly counts over the last hours that have events.

    ``start`` and ``end`` are epoch seconds of the first and last hour used. An item has at
    most one row per hour, so its window is bounded by the length of the log.
    """
    counts = item_hour_counts(ev)
    if start is not None:
        counts = counts.where(F.col("ts_hour") >= start)
    if end is not None:
        counts = counts.where(F.col("ts_hour") <= end)
    along = Window.partitionBy("aid").orderBy("ts_hour")
    new = {}
    for h in hours:
        frame = along.rangeBetween(-h * HOUR, 0)
        for a in ACTIONS:
            new[f"avg_{h}hour_visit_count_{a}"] = F.avg(f"hour_visit_count_{a}").over(frame)
            new[f"std_{h}hour_visit_count_{a}"] = F.stddev_samp(f"hour_visit_count_{a}").over(frame)
    return counts.withColumns(new)
