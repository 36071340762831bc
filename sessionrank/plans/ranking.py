"""From fold models to lists, and from several models' lists to a submission."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sessionrank.operators.items import popular
from sessionrank.operators.learn import predict_mean
from sessionrank.operators.lists import pad_lists, to_submission, topk_lists
from sessionrank.operators.stacking import blend
from sessionrank.schema import LONG_LIST_LENGTH

# Model weights of the final blend per action.
BLEND_WEIGHTS = {"clicks": (2, 1), "carts": (1, 1), "orders": (1, 1)}


def predict_lists(models: dict[str, Sequence], df: DataFrame, features: Sequence[str], k: int = LONG_LIST_LENGTH) -> DataFrame:
    """Submission rows from fold models keyed by the actions they score (joined by a comma)."""
    parts = []
    for types, folds in models.items():
        scored = predict_mean(folds, df, features).select("session", "aid", "pred")
        parts.append(to_submission(topk_lists(scored, "pred", k), types.split(",")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def blended_submission(lists: dict[str, DataFrame], item_table: DataFrame) -> DataFrame:
    """Blend the lists of two models, fill them with popular items, and format."""
    parts = []
    for type, weights in BLEND_WEIGHTS.items():
        of_type = {m: df.where(df["session_type"].contains(type[:-1])) for m, df in lists.items()}
        mixed = blend(of_type, dict(zip(lists, weights)))
        parts.append(pad_lists(mixed, popular(item_table, type)))
    mixed = reduce(lambda a, b: a.unionByName(b), parts)
    labels = F.array_join(F.transform("aids", lambda a: a.cast("string")), " ")
    return mixed.select("session_type", labels.alias("labels")).orderBy("session_type")
