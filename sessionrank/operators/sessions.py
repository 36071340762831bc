"""Features of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionrank.functions.numbers import ratio
from sessionrank.functions.times import US, epoch_dow, hour_of_day, micros, seconds, whole_units
from sessionrank.operators.order import EVENT_TIES, in_order
from sessionrank.schema import ACTIONS, SUBSESSION_GAP_SECONDS, is_action
from sessionrank.settings import stage


def session_features(ev: DataFrame) -> DataFrame:
    """Length in seconds, events, and distinct items per action.

    Items are folded per (session, item) first, so distinct counts need no per-session set.
    """
    folded = ev.groupBy("session", "aid").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(micros()).alias("lo"),
        F.max(micros()).alias("hi"),
        *[F.max(is_action(a).cast("int")).alias(a) for a in ACTIONS],
    )
    return folded.groupBy("session").agg(
        whole_units(F.max("hi"), F.min("lo")).alias("search_seconds"),
        F.sum("n").alias("session_size"),
        *[F.sum(a).cast("long").alias(f"{a[:-1]}_aid_session_count") for a in ACTIONS],
    )


def session_counts(ev: DataFrame) -> DataFrame:
    """Actions and distinct items of a session, overall and per action."""
    folded = ev.groupBy("session", "aid").agg(*[F.count_if(is_action(a)).alias(a) for a in ACTIONS])
    out = [F.sum(sum((F.col(a) for a in ACTIONS), F.lit(0))).alias("session_actions"), F.count(F.lit(1)).alias("session_items")]
    for a in ACTIONS:
        out.append(F.sum(a).alias(f"session_{a}"))
        out.append(F.count_if(F.col(a) > 0).alias(f"session_items_{a[:-1]}ed"))
    return folded.groupBy("session").agg(*out)


def session_span(ev: DataFrame) -> DataFrame:
    """First and last whole second, and the length between them."""
    sec = seconds()
    return ev.groupBy("session").agg(
        (F.max(sec) - F.min(sec)).alias("session_full_length"),
        F.min(sec).alias("session_first_ts"),
        F.max(sec).alias("session_last_ts"),
    )


def subsessions(ev: DataFrame, gap_s: int = SUBSESSION_GAP_SECONDS) -> DataFrame:
    """Number the stretches of a session that are separated by a pause longer than ``gap_s``.

    Adds ``sec`` (whole second), ``gap`` (seconds since the previous event of the same
    stretch, NULL at its start) and ``sub`` (0 for the first stretch).
    """
    timed = ev.withColumn("sec", seconds())
    stepped = in_order(timed, ["session"], "sec", EVENT_TIES, want={"_prev": "prev"}, carry=["sec"])
    step = F.col("sec") - F.col("_prev.sec")
    flagged = stepped.withColumn("gap", step).withColumn("_cut", F.coalesce((step > gap_s).cast("long"), F.lit(0))).drop("_prev")
    numbered = in_order(flagged, ["session"], "sec", EVENT_TIES, want={"sub": "running"}, flag="_cut", census=timed)
    return numbered.withColumn("gap", F.when(F.col("_cut") == 0, F.col("gap"))).drop("_cut")


def subsession_features(ev: DataFrame, gap_s: int = SUBSESSION_GAP_SECONDS) -> DataFrame:
    """Number and mean size of the stretches of a session, and the pauses inside them.

    Both parts read the numbered events, so these are written once. The median is exact: pauses are whole seconds up to ``gap_s``, so a group holds at most
    that many different values.
    """
    rows = stage(subsessions(ev, gap_s).select("session", "aid", "type", "sec", "sub", "gap"))
    folded = rows.groupBy("session", "sub", "aid").agg(
        F.min("sec").alias("lo"), F.max("sec").alias("hi"), *[F.count_if(is_action(a)).alias(a) for a in ACTIONS]
    )
    parts = folded.groupBy("session", "sub").agg(
        (F.max("hi") - F.min("lo")).alias("length"),
        F.count(F.lit(1)).alias("items"),
        *[F.sum(a).alias(a) for a in ACTIONS],
    )
    per_session = parts.groupBy("session").agg(
        F.count(F.lit(1)).alias("session_real_num"),
        F.avg("length").alias("session_avg_real_length"),
        F.avg("items").alias("session_avg_real_items_num"),
        *[F.sum(a).alias(a) for a in ACTIONS],
    )
    actions = sum((F.col(a) for a in ACTIONS), F.lit(0))
    per_session = per_session.withColumn("session_actions_avg_real", ratio(actions, F.col("session_real_num")))
    for a in ACTIONS:
        per_session = per_session.withColumn(f"session_{a}_avg_real", ratio(F.col(a), F.col("session_real_num")))
    pauses = rows.groupBy("session").agg(
        F.coalesce(F.avg("gap"), F.lit(-1.0)).alias("session_click_diff_mean"),
        F.coalesce(F.percentile("gap", F.lit(0.5)), F.lit(-1.0)).alias("session_click_diff_median"),
    )
    return per_session.drop(*ACTIONS).join(pauses, "session")


def session_clock(ev: DataFrame) -> DataFrame:
    """Mean hour of day per action, and the weekdays of the first and last event."""
    sec = seconds()
    hours = [
        F.coalesce(F.avg(F.when(is_action(a), hour_of_day(sec))), F.lit(-1.0)).alias(f"session_{a}_avg_hour") for a in ACTIONS
    ]
    return ev.groupBy("session").agg(
        *hours, epoch_dow(F.min(sec)).alias("session_start_dow"), epoch_dow(F.max(sec)).alias("session_end_dow")
    )


SESSION_FRAME = (
    "session",
    "session_actions",
    "session_avg_real_items_num",
    "session_avg_real_length",
    "session_carts",
    "session_carts_avg_hour",
    "session_carts_avg_real",
    "session_click_diff_mean",
    "session_clicks",
    "session_orders",
    "session_full_length",
    "session_items",
    "session_items_carted",
    "session_items_clicked",
    "session_last_ts",
)


def session_frame(ev: DataFrame) -> DataFrame:
    """The session columns the training frame uses; all parts share the key."""
    parts = [session_counts(ev), session_span(ev), subsession_features(ev), session_clock(ev)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "session")
    return out.select(*SESSION_FRAME)
