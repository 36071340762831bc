"""Item sequences, transition graph, random walks, and learned item vectors."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, functions as F

from sessionrank.functions import vectors as V
from sessionrank.functions.hashing import draw
from sessionrank.operators import factorise as fa
from sessionrank.operators.dataset import dense_ids
from sessionrank.operators.filters import dedup_consecutive
from sessionrank.operators.order import EVENT_TIES, in_order, with_micros
from sessionrank.settings import stage

MAX_SENTENCE = 1000
STEPS_PER_STAGE = 5
SESSION_PASSES, WALK_PASSES, RANK_PASSES = 100, 30, 30
# Share above which items are thinned out, and exponents of the noise of sessions and of walks.
SAMPLE, SESSION_NOISE, WALK_NOISE = 1e-4, -0.5, 0.0


def sentences(ev: DataFrame, max_len: int = MAX_SENTENCE, min_len: int = 2, overlap: int = 0) -> DataFrame:
    """Items of a session in order, repeats of the previous item left out.

    A session longer than ``max_len`` gives several consecutive parts, so no row grows with
    the log; a part ends with the first ``overlap`` items of the next one, so that with the
    width of a context no two neighbours are parted. Sessions below ``min_len`` events are
    left out.
    """
    sized = ev.join(
        ev.groupBy("session").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_len).select("session"),
        "session",
        "left_semi",
    )
    placed = in_order(with_micros(dedup_consecutive(sized)), ["session"], "us", EVENT_TIES, want={"_pos": "pos"}, census=with_micros(ev), dealt=True)
    at = F.col("_pos") - 1
    part = F.floor(at / F.lit(float(max_len))).cast("long")
    shared = (F.pmod(at, F.lit(max_len)) < overlap) & (part > 0)
    parts = F.when(shared, F.array(part - 1, part)).otherwise(F.array(part))
    return (
        placed.withColumn("part", F.explode(parts)).groupBy("session", "part")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", "aid"))).alias("s"))
        .select("session", "part", F.col("s.aid").alias("items"))
    )


def edges(ev: DataFrame) -> DataFrame:
    """Distinct (lag_aid, aid) steps from an event to the next one of the session."""
    steps = in_order(with_micros(ev), ["session"], "us", EVENT_TIES, want={"_prev": "prev"}, carry=["aid"])
    return steps.where(F.col("_prev").isNotNull()).select(F.col("_prev.aid").alias("lag_aid"), "aid").distinct()


def item2vec(
    sents: DataFrame,
    dim: int = 64,
    window: int = 5,
    min_count: int = 5,
    seed: int = 0,
    iterations: int = SESSION_PASSES,
    items_col: str = "items",
    all_items: DataFrame | None = None,
    method: str = "skipgram",
    max_len: int = MAX_SENTENCE,
    negatives: int = 5,
    exponent: float = SESSION_NOISE,
    sample: float = SAMPLE,
    shrink: bool = True,
    settings: fa.Settings = fa.Settings(),
) -> DataFrame:
    """Unit item vectors learned from item sequences; items of ``all_items`` never seen get zeros.

    ``method='skipgram'`` learns, for any number of items, from the weighted pairs of ``skipgram_pairs``
    against ``negatives`` noise items each, drawn with their count to the power of ``exponent``, in
    ``iterations`` passes over the distinct pairs; ``'factors'`` factorises the counts of items
    within ``window`` of each other (implicit ALS). ``max_len`` is the length at which the sequences were
    parted; what follows in one is overlap and counts once as a left neighbour.
    """
    sents = stage(sents.select(F.col(items_col).alias("items"), F.monotonically_increasing_id().alias("sent")))
    count = _counts(sents, max_len).where(F.col("n") >= min_count)
    if method == "factors":
        found = _context_factors(sents, count, dim, window, seed, max_len)
    elif method == "skipgram":
        pairs = skipgram_pairs(sents, window, min_count, sample, max_len, shrink)
        own = replace(settings, loss="skipgram", dim=dim, passes=iterations, negatives=negatives, seed=seed)
        vectors, _ = fa.learned(pairs, "aid_x", "aid_y", noise_weights(sents, min_count, exponent, max_len).withColumnRenamed("aid", "aid_y"), own)
        # an item that never has a neighbour keeps no direction
        found = count.select("aid").join(vectors.select(F.col("aid_x").alias("aid"), V.unit("vector").alias("vector")), "aid")
    else:
        raise ValueError(f"method is skipgram or factors, not {method}")
    if all_items is None:
        return found
    zeros = F.array_repeat(F.lit(0.0), dim)
    return (
        all_items.select("aid").distinct().join(found, "aid", "left").select("aid", F.coalesce("vector", zeros).alias("vector"))
    )


def _counts(sents: DataFrame, max_len: int) -> DataFrame:
    """How often each item occurs, overlaps left out."""
    each = sents.select(F.posexplode("items").alias("i", "aid")).where(F.col("i") < max_len)
    return each.groupBy("aid").agg(F.count(F.lit(1)).alias("n"))


def noise_weights(sents: DataFrame, min_count: int = 5, exponent: float = SESSION_NOISE, max_len: int = MAX_SENTENCE) -> DataFrame:
    """(aid, w): whole numbers in proportion to the count to the power of ``exponent``; the count itself for 1."""
    scale = 1.0 if exponent >= 1 else 1e6
    weight = F.greatest(F.lit(1), F.round(F.lit(scale) * F.pow(F.col("n").cast("double"), F.lit(float(exponent)))).cast("long"))
    return _counts(sents, max_len).where(F.col("n") >= min_count).select("aid", weight.alias("w"))


def skipgram_pairs(
    sents: DataFrame, window: int = 5, min_count: int = 5, sample: float = SAMPLE, max_len: int = MAX_SENTENCE, shrink: bool = True
) -> DataFrame:
    """(aid_x, aid_y, w) of items within ``window`` of each other in ``sents`` (sent, items), in both directions.

    Items below ``min_count`` are taken out before distances count. Instead of drawing a window from 1 to
    ``window`` for each item and drawing which occurrences are kept, every pair has the weight that these draws
    give it on average: (window - distance + 1) / window, with ``shrink``, times both items' chances
    sqrt(sample / share) + sample / share, 1 at most, of being kept. What the learner reads is
    bounded by the pairs of items, not by the log.
    """
    count = _counts(sents, max_len).where(F.col("n") >= min_count)
    total = count.agg(F.sum("n")).scalar()
    share = F.lit(sample) * total / F.col("n")
    keep = F.least(F.lit(1.0), F.sqrt(share) + share) if sample else F.lit(1.0)
    known = stage(count.select("aid", keep.alias("keep")))
    each = sents.select("sent", F.posexplode("items").alias("i", "aid")).join(known, "aid")
    # a part has no more than max_len items and the overlap
    parts = each.groupBy("sent").agg(F.sort_array(F.collect_list(F.struct("i", "aid"))).alias("s"))
    at = parts.select("s", F.posexplode("s").alias("p", "x")).where(F.col("x.i") < max_len)
    near = at.select(F.col("x.aid").alias("x"), F.posexplode(F.expr(f"slice(s, p + 2, {window})")).alias("k", "y"))
    weight = F.sum((F.lit(window) - F.col("k")) / F.lit(window)) if shrink else F.sum(F.lit(1.0))
    sums = near.groupBy("x", F.col("y.aid").alias("y")).agg(weight.alias("w"))
    both = F.explode(F.array(F.struct(F.col("x").alias("aid_x"), F.col("y").alias("aid_y")), F.struct(F.col("y").alias("aid_x"), F.col("x").alias("aid_y"))))
    sums = sums.select(both.alias("p"), "w").groupBy("p.aid_x", "p.aid_y").agg(F.sum("w").alias("w"))
    x, y = (known.select(F.col("aid").alias(f"aid_{c}"), F.col("keep").alias(f"_{c}")) for c in "xy")
    return sums.join(x, "aid_x").join(y, "aid_y").select("aid_x", "aid_y", (F.col("w") * F.col("_x") * F.col("_y")).alias("w"))


def context_counts(sents: DataFrame, window: int, max_len: int = MAX_SENTENCE) -> DataFrame:
    """How often two items are at most ``window`` apart, in both directions: (aid_x, aid_y, n)."""
    at = sents.select("items", F.posexplode("items").alias("i", "aid")).where(F.col("i") < max_len)
    near = at.select("aid", F.explode(F.expr(f"slice(items, i + 2, {window})")).alias("other"))
    counts = near.groupBy("aid", "other").agg(F.count(F.lit(1)).alias("n"))
    both = F.explode(F.array(F.struct(F.col("aid").alias("aid_x"), F.col("other").alias("aid_y")), F.struct(F.col("other").alias("aid_x"), F.col("aid").alias("aid_y"))))
    return counts.select(both.alias("p"), "n").groupBy("p.aid_x", "p.aid_y").agg(F.sum("n").alias("n"))


def _context_factors(sents: DataFrame, count: DataFrame, dim: int, window: int, seed: int, max_len: int) -> DataFrame:
    ids = stage(dense_ids(count.select("aid"), "aid", "_i"))
    x, y = (ids.select(F.col("aid").alias(f"aid_{c}"), F.col("_i").alias(f"_{c}")) for c in "xy")
    pairs = stage(context_counts(sents, window, max_len).join(x, "aid_x").join(y, "aid_y").select("_x", "_y", F.log1p("n").alias("_r")))
    model = ALS(userCol="_x", itemCol="_y", ratingCol="_r", implicitPrefs=True, rank=dim, seed=seed).fit(pairs)
    named = model.userFactors.join(ids, F.col("id") == F.col("_i"))
    return named.select("aid", V.unit(F.col("features").cast("array<double>")).alias("vector"))


def random_walks(edge_list: DataFrame, length: int = 20, per_node: int = 10, seed: int = 0) -> DataFrame:
    """Uniform random walks of at most ``length`` nodes, ``per_node`` from every start node.

    Neighbours are numbered per node, and a step joins on (node, number) instead of carrying
    neighbour lists, so nodes with many neighbours cost no more than others; one with very many
    is numbered in stretches. A walk ends at
    a node without outgoing edges. The plan is cut every few steps.
    """
    edge_list = stage(edge_list.select(F.col("lag_aid").alias("node"), F.col("aid").alias("next")))
    numbered = in_order(edge_list, ["node"], "next", [], want={"_pos1": "pos"})
    numbered = numbered.select("node", "next", (F.col("_pos1") - 1).alias("number"))
    degree = numbered.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    steps = stage(
        numbered.join(
            degree.select(F.col("node").alias("next"), F.col("degree").alias("next_degree")), "next", "left"
        )
    )
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(per_node - 1).cast("long"))
    walks = degree.select(F.col("node").alias("start"), "degree", F.explode(numbers).alias("walk")).withColumns({"node": F.col("start"), "items": F.array("start")})
    for i in range(1, length):
        pick = F.pmod(draw("start", "walk", F.lit(i), seed=seed), F.col("degree"))
        walks = (
            walks.withColumn("number", F.when(F.col("degree") > 0, pick))
            .join(steps, ["node", "number"], "left")
            .select(
                "start",
                "walk",
                F.coalesce("next", "node").alias("node"),
                F.coalesce("next_degree", F.lit(0)).alias("degree"),
                F.when(F.col("next").isNotNull(), F.concat("items", F.array("next"))).otherwise(F.col("items")).alias("items"),
            )
        )
        if i % STEPS_PER_STAGE == 0:
            walks = stage(walks)
    return walks.select("start", "walk", "items")


def implicit_factors(
    ev: DataFrame, rank: int = 64, reg: float = 0.01, iters: int = 10, seed: int = 0, alpha: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """Session and item factors from distinct (session, item) contacts.

    The factorisation needs 32-bit ids, so sessions and items are numbered first. Sessions
    without contact and unknown items have no row; ``user_item_dot`` decides what that means.
    """
    seen = ev.select("session", "aid").distinct()
    users, items = stage(dense_ids(ev, "session", "_u")), stage(dense_ids(ev, "aid", "_i"))
    contacts = seen.join(users, "session").join(items, "aid").select("_u", "_i", F.lit(1.0).alias("_r"))
    model = ALS(
        userCol="_u", itemCol="_i", ratingCol="_r", implicitPrefs=True, rank=rank, regParam=reg, maxIter=iters, seed=seed, alpha=alpha
    ).fit(stage(contacts))

    def named(factors: DataFrame, ids: DataFrame, number: str, key: str, vector: str) -> DataFrame:
        return factors.withColumnRenamed("id", number).join(ids, number).select(
            key, F.col("features").cast("array<double>").alias(vector)
        )

    return (
        named(model.userFactors, users, "_u", "session", "session_vector"),
        named(model.itemFactors, items, "_i", "aid", "aid_vector"),
    )


def contacts(ev: DataFrame) -> DataFrame:
    """(session, aid, w): each item of a session once."""
    return ev.select("session", "aid").distinct().withColumn("w", F.lit(1.0))


def popularity(ev: DataFrame) -> DataFrame:
    """(aid, w): the number of sessions that have an item, by which noise items are drawn."""
    return contacts(ev).groupBy("aid").agg(F.count(F.lit(1)).alias("w"))


def ranking_factors(
    ev: DataFrame, rank: int = 64, passes: int = RANK_PASSES, seed: int = 0, decay: float = 0.001, settings: fa.Settings = fa.Settings()
) -> tuple[DataFrame, DataFrame]:
    """Session and item vectors by Bayesian personalised ranking, ``rank`` + 1 numbers each.

    From distinct (session, item) contacts: each is to score above an item that the session does not have, drawn by its
    number of sessions in each of ``passes`` passes. The last number of an item is its bias, that of a session 1.
    """
    seen = stage(contacts(ev))
    own = replace(settings, loss="bpr", dim=rank, passes=passes, seed=seed, decay=decay)
    noise = seen.groupBy("aid").agg(F.count(F.lit(1)).alias("w"))
    users, items = fa.learned(seen, "session", "aid", noise, own)
    return users.withColumnRenamed("vector", "session_vector"), items.withColumnRenamed("vector", "aid_vector")
