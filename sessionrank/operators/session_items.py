"""Features of (session, item) pairs from the session's own events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sessionrank.functions.numbers import open_ratio, ratio
from sessionrank.functions.times import epoch_dow, seconds, whole_units
from sessionrank.operators.filters import with_scalars
from sessionrank.operators.order import EVENT_TIES, in_order, with_micros
from sessionrank.schema import ACTIONS, is_action

RATE_NAMES = {
    "clicks2carts": ("visit_count_clicks", "action_count_cvr_click_to_cart"),
    "clicks2orders": ("visit_count_clicks", "action_count_cvr_click_to_order"),
    "clicks2cart_orders": ("visit_count_clicks", "action_count_cvr_click_to_cart_order"),
    "carts2orders": ("visit_count_carts", "action_count_cvr_cart_to_order"),
}


def session_item_features(ev: DataFrame) -> DataFrame:
    """Counts, recency-weighted counts and time distances of a session's items."""
    placed = in_order(
        with_micros(ev), ["session"], "us", EVENT_TIES, want={"_last": "last", "_dense": "rdense"}
    ).withColumn("_ago", whole_units(F.col("_last"), F.col("us")))
    closeness = F.lit(1.0) / (F.ln(F.col("_ago") + 1) + 1)
    out = placed.groupBy("session", "aid").agg(
        *[F.count_if(is_action(a)).alias(f"visit_count_{a}") for a in ACTIONS],
        *[F.sum(F.when(is_action(a), closeness)).alias(f"time_weighted_visit_count_{a}") for a in ACTIONS],
        F.min("_ago").alias("min_seconds_to_latest"),
        F.max("_ago").alias("max_seconds_to_latest"),
        F.avg("_dense").alias("avg_session_dense_rank"),
        F.stddev_samp("_dense").alias("std_session_dense_rank"),
    )
    clicks, carts, orders = (F.col(f"visit_count_{a}") for a in ACTIONS)
    out = out.withColumn("type_weighted_visit_counts", clicks + 6 * carts + 3 * orders)
    best = Window.partitionBy("session").orderBy(F.col("type_weighted_visit_counts").desc(), "aid")
    return out.withColumn("rn_type_weighted_visit_counts", F.row_number().over(best))


def session_item_cvr(counts: DataFrame, items: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Smoothed conversion rates of a session's items and the actions they let expect.

    The averages run over all pairs of ``log``, or over ``counts`` itself.
    """
    everyone = counts
    if log is not None:
        everyone = log.groupBy("session", "aid").agg(*[F.count_if(is_action(a)).alias(f"visit_count_{a}") for a in ACTIONS])
    means = everyone.agg(F.avg("visit_count_clicks").alias("_mc"), F.avg("visit_count_carts").alias("_mk"))
    clicks, carts, orders = (F.col(f"visit_count_{a}") for a in ACTIONS)
    from_clicks, from_carts = clicks + F.col("_mc"), carts + F.col("_mk")
    rates = {
        "clicks2carts": ratio(carts, from_clicks),
        "clicks2orders": ratio(orders, from_clicks),
        "clicks2cart_orders": ratio(carts + orders, from_clicks),
        "carts2orders": ratio(orders, from_carts),
    }
    out = with_scalars(counts.select("session", "aid", *[f"visit_count_{a}" for a in ACTIONS]), means)
    out = out.withColumns({f"cvr_visit_count_{n}": r for n, r in rates.items()})
    item_rates = sorted({r for _, r in RATE_NAMES.values()})
    out = out.join(items.select("aid", *item_rates), "aid", "left")
    expected = {}
    for n, (base, item_rate) in RATE_NAMES.items():
        expected[f"visit_count_{n}_exp_value_per_session"] = F.col(base) * F.col(f"cvr_visit_count_{n}")
        expected[f"visit_count_{n}_exp_value_per_all"] = F.col(base) * F.col(item_rate)
    return out.withColumns(expected).drop("_mc", "_mk", *item_rates, *[f"visit_count_{a}" for a in ACTIONS])


def session_item_recency(ev: DataFrame) -> DataFrame:
    """Best place from the end among the session's events of an action, and seconds to its last event."""
    placed = in_order(with_micros(ev), ["session"], "us", EVENT_TIES, want={"_last": "last"})
    placed = in_order(placed, ["session", "type"], "us", ["aid"], want={"_place": "rpos"}, census=with_micros(ev), dealt=True)
    ago = whole_units(F.col("_last"), F.col("us"))
    return placed.groupBy("session", "aid").agg(
        *[F.min(F.when(is_action(a), F.col("_place"))).alias(f"latest_rank_{a}") for a in ACTIONS],
        *[F.min(F.when(is_action(a), ago)).alias(f"seconds_to_latest_{a}") for a in ACTIONS],
    )


def session_item_actions(ev: DataFrame) -> DataFrame:
    """Counts, last times and last positions (0 for the session's last event) per action.

    Defaults: 0 for counts, 999 for positions, -1 for times. ``a2s_best_action_type`` is the
    strongest action on the item: 0 click, 1 cart, 2 order.
    """
    placed = in_order(with_micros(ev), ["session"], "us", EVENT_TIES, want={"_back": "rpos"})
    sec, index = seconds(), F.col("_back") - 1
    aggs = []
    for a in ACTIONS:
        one = a[:-1]
        aggs += [
            F.count_if(is_action(a)).alias(f"a2s_{a}_num"),
            F.coalesce(F.max(F.when(is_action(a), sec)), F.lit(-1).cast("long")).alias(f"a2s_last_{one}_ts"),
            F.coalesce(F.min(F.when(is_action(a), index)), F.lit(999).cast("long")).alias(f"a2s_last_{one}_index"),
        ]
    out = placed.groupBy("session", "aid").agg(*aggs)
    names = [a[:-1] for a in ACTIONS]
    return out.withColumns(
        {
            "a2s_actions_num": F.col("a2s_clicks_num") + F.col("a2s_carts_num") + F.col("a2s_orders_num"),
            "a2s_last_action_index": F.least(*[F.col(f"a2s_last_{n}_index") for n in names]),
            "a2s_last_action_ts": F.greatest(*[F.col(f"a2s_last_{n}_ts") for n in names]),
            "a2s_best_action_type": F.when(F.col("a2s_orders_num") > 0, F.lit(2))
            .when(F.col("a2s_carts_num") > 0, F.lit(1))
            .otherwise(F.lit(0))
            .cast("long"),
        }
    )


def relative_features(df: DataFrame) -> DataFrame:
    """Shares, time distances and estimates of the assembled training frame.

    Needs the session frame, the a2s columns and the item ratio columns. Candidates the
    session never touched get the defaults of the a2s columns.
    """
    names = [a[:-1] for a in ACTIONS]
    fills = {f"a2s_{x}_num": 0 for x in ("actions", *ACTIONS)}
    fills |= {f"a2s_last_{n}_ts": -1 for n in ("action", *names)}
    fills |= {f"a2s_last_{n}_index": 999 for n in ("action", *names)}
    fills |= {"a2s_best_action_type": -1}
    out = df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast("long")) for c, v in fills.items()})

    new = {}
    for x in ("actions", *ACTIONS):
        new[f"a2s_{x}_rel"] = F.coalesce(open_ratio(F.col(f"a2s_{x}_num"), F.col(f"session_{x}")), F.lit(-1.0))
    length = F.col("session_full_length") + 1
    for suffix, ts in (("", "action"), *[(f"_{a}", a[:-1]) for a in ACTIONS]):
        diff = F.col("session_last_ts") - F.col(f"a2s_last_{ts}_ts")
        new[f"ts_diff{suffix}"] = diff
        new[f"ts_diff{suffix}_rel"] = ratio(diff, length)
    apart = F.abs(epoch_dow(F.col("session_last_ts")) - F.col("aid_clicks_favourite_dow_test"))
    around = F.when(apart > 3, 7 - apart).otherwise(apart)
    new["aid_clicks_favourite_dow_diff_test"] = F.coalesce(around, F.lit(14)).cast("long")
    for a, b, base in (("CL", "CA", "clicks"), ("CL", "OR", "clicks"), ("CA", "OR", "carts")):
        new[f"{b}_estimation_fr{a}_trn"] = _times(F.col(f"a2s_{base}_num"), F.col(f"aid_{a}2{b}_trn"))
    new["CA_estimation_frCL_tst"] = _times(F.col("a2s_clicks_num"), F.col("aid_CL2CA_tst"))
    return out.withColumns(new).drop("aid_clicks_favourite_dow_test")


def _times(count, rate):
    """Product where zero times infinite is undefined (NULL), as in dataframe arithmetic."""
    product = count * rate
    return F.when(~F.isnan(product), product)
