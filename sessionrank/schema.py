"""Column contracts and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Fixed values (they decide results, so they are kept as plain text).
ACTIONS = ("clicks", "carts", "orders")
ACTION_CODES = {"clicks": 0, "carts": 1, "orders": 2}
ACTION_WEIGHTS = {"clicks": 1, "carts": 6, "orders": 3}
RECALL_WEIGHTS = {"clicks": 0.1, "carts": 0.3, "orders": 0.6}
LIST_LENGTH = 20
LONG_LIST_LENGTH = 50
MISSING_POSITION = 2_000_000
SUBSESSION_GAP_SECONDS = 7200

RAW_EVENTS = T.StructType(
    [
        T.StructField("session", T.LongType()),
        T.StructField("aid", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("type", T.StringType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("session", T.LongType()),
        T.StructField("aid", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("type", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)

LABELS = T.StructType(
    [
        T.StructField("session", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("ground_truth", T.ArrayType(T.LongType())),
    ]
)


def action_weight(col: str = "type") -> Column:
    """Weight of an action; NULL for an unknown action."""
    (first, weight), *rest = ACTION_WEIGHTS.items()
    out = F.when(F.col(col) == first, F.lit(weight))
    for name, weight in rest:
        out = out.when(F.col(col) == name, F.lit(weight))
    return out.cast("long")


def is_action(name: str, col: str = "type") -> Column:
    return F.col(col) == F.lit(name)
