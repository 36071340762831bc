"""Ground truth in long, wide and exploded form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionrank.schema import is_action


def wide_ground_truth(labels: DataFrame) -> DataFrame:
    """One row per session: the list of each action, and the first clicked item."""
    def items(action: str):
        return F.first(F.when(is_action(action), F.col("ground_truth")), ignorenulls=True)

    return (
        labels.groupBy("session")
        .agg(items("clicks").alias("click_labels"), items("carts").alias("cart_label"), items("orders").alias("order_label"))
        .withColumn("click_label", F.get("click_labels", F.lit(0)))
        .select("session", "click_labels", "click_label", "cart_label", "order_label")
    )


def explode_labels(labels: DataFrame) -> DataFrame:
    """One row per (session, action, labelled item)."""
    return labels.select("session", "type", F.explode("ground_truth").alias("aid"))


def label_flags(labels: DataFrame) -> DataFrame:
    """One row per labelled (session, item) with a 0/1 column per action."""
    long = explode_labels(labels)
    return long.groupBy("session", "aid").agg(
        *[F.max(is_action(a).cast("long")).alias(f"{a}_gt") for a in ("clicks", "carts", "orders")]
    )
