"""Ranked lists per session: top k, padding and submission format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionrank.schema import LIST_LENGTH, LONG_LIST_LENGTH


def topk(df: DataFrame, score: str, k: int = LIST_LENGTH, key: str = "session", item: str = "aid") -> DataFrame:
    """The ``k`` best rows per session with their place ``rn``; equal scores by item."""
    order = Window.partitionBy(key).orderBy(F.col(score).desc_nulls_last(), item)
    return df.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def topk_lists(
    df: DataFrame, score: str, k: int = LONG_LIST_LENGTH, key: str = "session", item: str = "aid"
) -> DataFrame:
    """One row per session with the best items and their scores, best first."""
    best = topk(df.select(key, item, score), score, k, key, item)
    packed = F.sort_array(F.collect_list(F.struct("rn", F.col(item).alias("i"), F.col(score).alias("s"))))
    return best.groupBy(key).agg(packed.alias("_l")).select(key, F.col("_l.i").alias("aids"), F.col("_l.s").alias("scores"))


def prediction_lists(scores: dict[str, tuple[DataFrame, str]], k: int = LONG_LIST_LENGTH) -> DataFrame:
    """Lists of several models side by side: ``<name>_pred`` and ``<name>_pred_score``."""
    out = None
    for name, (df, score) in scores.items():
        lists = topk_lists(df, score, k).select(
            "session", F.col("aids").alias(f"{name}_pred"), F.col("scores").alias(f"{name}_pred_score")
        )
        out = lists if out is None else out.join(lists, "session", "full")
    return out


def popular_list(popular: DataFrame) -> Column:
    """The items of a ``popular`` table (at most k rows) as one array, best first."""
    packed = F.sort_array(F.collect_list(F.struct("rn", "aid")))
    return popular.agg(F.transform(packed, lambda x: x["aid"]).alias("a")).scalar()


def pad_lists(lists: DataFrame, popular: DataFrame, k: int = LIST_LENGTH, dedupe: bool = False, col: str = "aids") -> DataFrame:
    """Fill lists shorter than ``k`` with popular items.

    Items already listed may come again; ``dedupe`` leaves them out and takes the next ones.
    """
    with_fill = lists.withColumn("_fill", popular_list(popular))
    fill = F.array_except("_fill", col) if dedupe else F.col("_fill")
    missing = F.greatest(F.lit(k) - F.size(col), F.lit(0))
    return with_fill.withColumn(col, F.concat(col, F.slice(fill, F.lit(1), missing))).drop("_fill")


def to_submission(lists: DataFrame, types: Sequence[str]) -> DataFrame:
    """Rows ``"<session>_<action>"`` with space-joined items, once for each of ``types``.

    A score for carts and orders together gives both rows.
    """
    rows = lists.withColumn("_t", F.explode(F.array(*[F.lit(t) for t in types])))
    cols = [
        F.concat_ws("_", F.col("session").cast("string"), F.col("_t")).alias("session_type"),
        F.array_join(F.transform("aids", lambda a: a.cast("string")), " ").alias("labels"),
    ]
    return rows.select(*cols, *(["scores"] if "scores" in lists.columns else []))


def from_submission(sub: DataFrame) -> DataFrame:
    """Rows of a submission as (session, type, place from 1, aid[, score]); ``<NA>`` items are dropped."""
    head = F.split("session_type", "_")
    base = sub.select(
        head.getItem(0).cast("long").alias("session"),
        head.getItem(1).alias("type"),
        F.posexplode(F.split("labels", " ")).alias("_p", "_a"),
        *(["scores"] if "scores" in sub.columns else []),
    ).where(~F.col("_a").isin("<NA>", ""))
    out = ["session", "type", (F.col("_p") + 1).alias("place"), F.col("_a").cast("long").alias("aid")]
    if "scores" in sub.columns:
        out.append(F.get("scores", F.col("_p")).alias("score"))
    return base.select(*out)
