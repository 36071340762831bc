"""Recall of ranked lists and candidate sets, and ranking quality of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame, functions as F

from sessionrank.functions.numbers import ratio
from sessionrank.operators.lists import topk
from sessionrank.operators.order import in_order
from sessionrank.schema import ACTIONS, LIST_LENGTH, RECALL_WEIGHTS

NAMES = {"clicks": "click", "carts": "cart", "orders": "order"}


def recall_lists(
    pred: DataFrame, ground_truth: DataFrame, k: int = LIST_LENGTH, by: Column | None = None
) -> DataFrame:
    """Recall at ``k`` of prediction lists, per action and weighted.

    ``pred`` has ``click_pred``, ``cart_pred``, ``order_pred``. Clicks count sessions whose
    first click is listed; carts and orders count listed labels out of at most ``k`` per session.
    ``by`` groups the result, for example by shard. A missing list or label counts no hit.
    """
    joined = pred.join(ground_truth, "session", "left")

    def listed(name: str) -> Column:
        return F.slice(f"{name}_pred", 1, k)

    click_hit = F.coalesce(F.array_contains(listed("click"), F.col("click_label")), F.lit(False)).cast("long")
    parts = {"click": (click_hit, F.col("click_label").isNotNull().cast("long"))}
    for name in ("cart", "order"):
        label = F.col(f"{name}_label")
        hits = F.coalesce(F.size(F.array_intersect(listed(name), label)), F.lit(0))
        # least() passes over NULL, so a missing list must be told apart first
        known = F.when(label.isNull(), 0).otherwise(F.least(F.array_size(label), F.lit(k)))
        parts[name] = (F.when(label.isNull() | F.col(f"{name}_pred").isNull(), 0).otherwise(hits), known)
    groups = [] if by is None else [by]
    sums = joined.groupBy(*groups).agg(
        *[F.sum(h).alias(f"{n}_hits") for n, (h, _) in parts.items()],
        *[F.sum(d).alias(f"{n}_labels") for n, (_, d) in parts.items()],
    )
    recalls = {f"{n}_recall": ratio(F.col(f"{n}_hits"), F.col(f"{n}_labels")) for n in parts}
    out = sums.withColumns(recalls)
    weighted = sum((F.lit(RECALL_WEIGHTS[a]) * F.col(f"{NAMES[a]}_recall") for a in ACTIONS), F.lit(0.0))
    return out.withColumn("recall", weighted)


def recall_long(scores: DataFrame, labels: DataFrame, score: str, type: str, k: int = LIST_LENGTH) -> DataFrame:
    """Recall at ``k`` of one action from scored rows and label arrays.

    The denominator counts only sessions that have scored rows.
    """
    best = topk(scores, score, k).select("session", "aid")
    known = labels.where(F.col("type") == type).join(best.select("session").distinct(), "session", "left_semi")
    hits = best.join(known.select("session", F.explode("ground_truth").alias("aid")), ["session", "aid"])
    found = hits.agg(F.count(F.lit(1)).alias("n")).scalar()
    return known.agg(F.sum(F.least(F.array_size("ground_truth"), F.lit(k))).alias("labels")).select(
        found.alias("hits"), "labels", ratio(found, F.col("labels")).alias("recall")
    )


def candidate_recall(cands: DataFrame, labels: DataFrame, denominators: dict[str, int] | None = None, k: int = LIST_LENGTH) -> DataFrame:
    """Share of labels that are among the candidates, at most ``k`` hits per session and action.

    Without ``denominators`` the labels themselves are counted, at most ``k`` per session.
    """
    long = labels.select("session", "type", F.explode("ground_truth").alias("aid"))
    hits = (
        long.join(cands.select("session", "aid").distinct(), ["session", "aid"])
        .groupBy("session", "type")
        .agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n"))
        .groupBy("type")
        .agg(F.sum("n").alias("hits"))
    )
    if denominators is None:
        known = labels.groupBy("type").agg(F.sum(F.least(F.array_size("ground_truth"), F.lit(k))).cast("long").alias("labels"))
    else:
        known = labels.select("type").distinct()
        size = None
        for t, n in denominators.items():
            size = F.when(F.col("type") == t, n) if size is None else size.when(F.col("type") == t, n)
        known = known.withColumn("labels", size.cast("long"))
    out = known.join(hits, "type", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.withColumn("recall", ratio(F.col("hits"), F.col("labels")))


def auc(df: DataFrame, score: str, label: str) -> float:
    """Area under the ROC curve."""
    rows = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("l"))
    return BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="l").evaluate(rows)


def auc_table(df: DataFrame, score: str, label: str) -> DataFrame:
    """The same area as a one-row table, from the counts of positives and negatives per score.

    Rank sum form: a positive beats the negatives below it and half of those at its score.
    Scores are folded to distinct values, and running totals use stretches, not one task.
    """
    folded = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")
    )
    running = in_order(folded.withColumn("all", F.lit(1)), ["all"], "s", [], want={"neg_to": "running"}, flag="neg")
    below = F.col("neg_to") - F.col("neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    return running.agg(ratio(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def shard_recall(pred: DataFrame, ground_truth: DataFrame, n: int, shards: Sequence[int], k: int = LIST_LENGTH) -> DataFrame:
    """Recall per shard of sessions and over all of them (shard -1)."""
    shard = F.pmod(F.col("session"), F.lit(n)).cast("long").alias("shard")
    kept = pred.where(F.pmod(F.col("session"), F.lit(n)).isin(*shards))
    per = recall_lists(kept, ground_truth, k, by=shard)
    return per.unionByName(recall_lists(kept, ground_truth, k).withColumn("shard", F.lit(-1).cast("long")))
