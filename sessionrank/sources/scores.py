"""Reading model scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def merge_full(dfs: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Full outer join of several tables on shared keys."""
    return reduce(lambda a, b: a.join(b, list(on), "full"), dfs)


def load_scores(
    spark: SparkSession, paths: dict[str, str], renames: dict[str, str] | None = None, drop: Sequence[str] = ()
) -> DataFrame:
    """Read one score file per action and merge them into (session, aid, pred_<action>...).

    Each file has session, aid and a score column named ``pred``, ``<action>_pred`` or as
    given in ``renames``; index and target columns are listed in ``drop``.
    """
    renames = renames or {}

    def one(action: str, path: str) -> DataFrame:
        df = spark.read.parquet(path).drop(*drop)
        names = {"pred": f"pred_{action}", f"{action}_pred": f"pred_{action}", **renames}
        return df.withColumnsRenamed(names).select("session", "aid", f"pred_{action}")

    return merge_full([one(a, p) for a, p in paths.items()], ["session", "aid"])
