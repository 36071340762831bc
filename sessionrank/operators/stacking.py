"""Stacking of several models' scores and blending of their lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionrank.operators.lists import from_submission
from sessionrank.operators.ranks import row_numbers
from sessionrank.schema import ACTIONS, LIST_LENGTH, LONG_LIST_LENGTH


def rank_scores(
    scores: DataFrame, model: str, k: int = LONG_LIST_LENGTH, types: Sequence[str] | None = None, rank: str = "dense_rank"
) -> DataFrame:
    """Score and rank per action in long form: (session, aid, model, action columns).

    Kept are rows among the first ``k`` of any action. A model may lack some actions.
    ``rank`` is ``dense_rank``, or ``row_number`` with equal scores in item order. A session with
    very many candidates is ranked by many tasks.
    """
    types = [t for t in (types or ACTIONS) if f"pred_{t}" in scores.columns]
    ties = {"dense_rank": [], "row_number": ["aid"]}[rank]
    ranks = {f"{t}_rank": [F.col(f"pred_{t}").desc_nulls_last(), *ties] for t in types}
    best = F.least(*[F.col(r) for r in ranks]) if len(ranks) > 1 else F.col(next(iter(ranks)))
    rows = scores.select("session", "aid", *[f"pred_{t}" for t in types])
    return _long(row_numbers(rows, "session", ranks, fn=rank).where(best <= k), model)


def _long(ranked: DataFrame, model: str) -> DataFrame:
    none_score, none_rank = F.lit(None).cast("double"), F.lit(None).cast("long")
    cols = []
    for t in ACTIONS:
        has = f"pred_{t}" in ranked.columns
        cols.append((F.col(f"pred_{t}").cast("double") if has else none_score).alias(f"pred_{t}"))
        cols.append((F.col(f"{t}_rank").cast("long") if has else none_rank).alias(f"{t}_rank"))
    return ranked.select("session", "aid", F.lit(model).alias("model"), *cols)


def unpack_lists(lists: DataFrame, model: str, k: int = LONG_LIST_LENGTH) -> DataFrame:
    """List predictions as long score rows; the rank is the place in the list.

    Accepts ``click_pred``/``click_pred_score`` columns (and cart, order), or submission rows
    (``session_type, labels, scores``). A pair is kept with all its scores if any list has it
    among its first ``k``.
    """
    if "session_type" in lists.columns:
        rows = from_submission(lists)
        rows = rows.withColumn("_t", F.regexp_extract("type", "^(click|cart|order)", 1))
    else:
        parts = [_list_rows(name) for name in ("click", "cart", "order")]
        rows = lists.select("session", F.explode(F.concat(*parts)).alias("r")).select("session", "r.*")
    aggs = []
    for t in ACTIONS:
        hit = F.col("_t") == t[:-1]
        aggs += [F.max(F.when(hit, F.col("score"))).alias(f"pred_{t}"), F.max(F.when(hit, F.col("place"))).alias(f"{t}_rank")]
    wide = rows.groupBy("session", "aid").agg(*aggs, F.min("place").alias("_best"))
    return _long(wide.where(F.col("_best") <= k), model)


def _list_rows(name: str) -> Column:
    """One list as an array of (_t, place, aid, score) rows; a missing list has none."""
    zipped = F.arrays_zip(F.col(f"{name}_pred").alias("a"), F.col(f"{name}_pred_score").alias("s"))
    rows = F.coalesce(zipped, F.array().cast("array<struct<a:bigint,s:double>>"))

    def row(x: Column, i: Column) -> Column:
        return F.struct(F.lit(name).alias("_t"), (i + 1).alias("place"), x["a"].alias("aid"), x["s"].alias("score"))

    return F.transform(rows, row)


def stack(long_scores: Sequence[DataFrame], models: Sequence[str]) -> DataFrame:
    """All models' pairs with a score and rank column per model and action.

    The models are united in long form and turned by one aggregate, one shuffle in place of
    a join per model.
    """
    rows = reduce(lambda a, b: a.unionByName(b), long_scores)
    aggs: list[Column] = []
    for m in models:
        of_model = F.col("model") == m
        for t in ACTIONS:
            aggs.append(F.max(F.when(of_model, F.col(f"pred_{t}"))).alias(f"{m}_pred_{t}"))
            aggs.append(F.max(F.when(of_model, F.col(f"{t}_rank"))).alias(f"{m}_{t}_rank"))
    return rows.groupBy("session", "aid").agg(*aggs)


def blend(
    lists: dict[str, DataFrame], weights: dict[str, float], missing: float = 1 / 50, k: int = LIST_LENGTH, depth: int = LONG_LIST_LENGTH
) -> DataFrame:
    """Weighted mean of reciprocal places of several models' lists (``session_type, labels``).

    An item a model does not list counts as ``missing``; only the first ``depth`` places of a
    list are read.
    """
    parts = []
    for model, df in lists.items():
        places = df.select("session_type", F.posexplode(F.split("labels", " ")).alias("_p", "aid")).where(
            (F.col("_p") < depth) & (F.col("aid") != "")
        )
        parts.append(places.select("session_type", "aid", F.lit(model).alias("model"), (1 / (F.col("_p") + 1)).alias("r")))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    per_model = rows.groupBy("session_type", "aid").agg(
        *[F.max(F.when(F.col("model") == m, F.col("r"))).alias(f"_{i}") for i, m in enumerate(lists)]
    )
    total = sum((F.coalesce(F.col(f"_{i}"), F.lit(missing)) * F.lit(float(weights[m])) for i, m in enumerate(lists)), F.lit(0.0))
    scored = per_model.select("session_type", F.col("aid").cast("long").alias("aid"), (total / len(lists)).alias("score"))
    order = Window.partitionBy("session_type").orderBy(F.col("_step").desc(), "aid")
    best = scored.withColumn("_step", F.rint(F.col("score") * 1e12)).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    packed = F.sort_array(F.collect_list(F.struct("rn", "aid", "score")))
    return best.groupBy("session_type").agg(packed.alias("_l")).select(
        "session_type", F.col("_l.aid").alias("aids"), F.col("_l.score").alias("scores")
    )
