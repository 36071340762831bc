"""Assembling, labelling and sampling the training set."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionrank.functions.hashing import bucket, draw
from sessionrank.functions.times import US, hour_start, whole_units
from sessionrank.operators.filters import semi
from sessionrank.operators.order import in_order
from sessionrank.sources.labels import label_flags
from sessionrank.schema import ACTIONS
from sessionrank.settings import both_dealt, stage, stage_by

PAIR = ("session", "aid")
SLOTS = 65_536
FEW_VALUES = 100_000
PART_VALUES = 1_000_000


def assemble(
    pairs: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str]]], bucketed: bool = False
) -> DataFrame:
    """Left join of feature tables onto candidate pairs.

    Tables on part of the pair key (by session, by item) are first joined with each other,
    so the pairs are shuffled once per key set and a popular item's partition can be split.
    Tables on the whole pair key come last and join one after another in one partitioning,
    so their many columns are never shuffled again. With ``bucketed`` the pairs are written
    before these last joins in the buckets of ``stage_by``; with tables written likewise no
    join after it moves a row.
    """
    groups: dict[tuple[str, ...], list[DataFrame]] = {}
    for df, keys in tables:
        groups.setdefault(tuple(keys), []).append(df)
    out, moved = pairs, False
    for keys in sorted(groups, key=lambda k: set(k) >= set(PAIR)):
        on = list(keys)
        if set(keys) >= set(PAIR):
            parts = groups[keys]
            if bucketed and not moved:
                out, moved = stage_by(out, PAIR), True
        else:
            parts = [reduce(lambda a, b: a.join(b, on, "full"), groups[keys])]
        for part in parts:
            out = both_dealt(out, part, on, "left") if set(keys) >= set(PAIR) else out.join(part, on, "left")
    return out


def session_clock_keys(ev: DataFrame) -> DataFrame:
    """Hour and minute (epoch seconds) just after a session's last event, for item joins by hour."""
    after = F.floor((F.max(F.unix_micros("ts")) + US) / F.lit(float(US))).cast("long")
    return ev.groupBy("session").agg(after.alias("_s")).select(
        "session", hour_start(F.col("_s")).alias("ts_hour"), (F.col("_s") - F.pmod("_s", F.lit(60))).alias("ts_minute")
    )


def in_list(item: Column, items: Column) -> Column:
    """1 if the item is in the array, else 0; a NULL array counts as empty."""
    return F.coalesce(F.array_contains(items, item).cast("long"), F.lit(0).cast("long"))


def add_labels(df: DataFrame, ground_truth: DataFrame) -> DataFrame:
    """0/1 labels from wide ground truth."""
    aid = F.col("aid")
    truth = ground_truth.select(
        "session", F.col("click_label").alias("_click"), F.col("cart_label").alias("_cart"), F.col("order_label").alias("_order")
    )
    joined = df.join(truth, "session", "left")
    return joined.withColumns(
        {
            "click_label": F.coalesce((aid == F.col("_click")).cast("long"), F.lit(0).cast("long")),
            "cart_label": in_list(aid, F.col("_cart")),
            "order_label": in_list(aid, F.col("_order")),
        }
    ).drop("_click", "_cart", "_order")


def add_item_age(df: DataFrame) -> DataFrame:
    """Whole seconds from an item's last and first event to the session's end minute.

    Needs ``ts_minute`` (epoch seconds) and the item's ``action_max_ts``/``action_min_ts``.
    """
    now = F.col("ts_minute") * US
    return df.withColumns(
        {
            "seconds_from_last_aid_action": whole_units(now, F.unix_micros("action_max_ts")),
            "seconds_from_first_aid_action": whole_units(now, F.unix_micros("action_min_ts")),
        }
    ).drop("ts_minute", "ts_hour", "action_max_ts", "action_min_ts")


def add_label_flags(df: DataFrame, labels: DataFrame) -> DataFrame:
    """0/1 columns ``<action>_gt`` by joining the exploded labels."""
    joined = df.join(label_flags(labels), ["session", "aid"], "left")
    return joined.withColumns({f"{a}_gt": F.coalesce(F.col(f"{a}_gt"), F.lit(0).cast("long")) for a in ACTIONS})


def session_has_label(df: DataFrame, label: str, name: str | None = None) -> DataFrame:
    """1 for all candidates of a session that has a positive one."""
    name = name or f"{label.removesuffix('_gt')}_session"
    return df.withColumn(name, F.max(label).over(Window.partitionBy("session")))


def positive_sessions(df: DataFrame, label: str) -> DataFrame:
    """Rows of the sessions with at least one positive candidate."""
    hits = df.where(F.col(label) == 1).select("session").distinct()
    return semi(df, hits, ["session"])


def add_fold(df: DataFrame, n: int = 5, seed: int = 0, key: str = "session") -> DataFrame:
    """Random fold per session; all rows of a session share it."""
    return df.withColumn("fold", bucket(key, n=n, seed=seed))


def deal_folds(df: DataFrame, n: int = 5, seed: int = 0, key: str = "session") -> DataFrame:
    """Folds of even size; all rows of a session share one.

    Sessions are numbered by falling size, equal sizes in random order, and dealt to the folds
    forth and back (0 to n - 1, then n - 1 to 0), so no two folds differ by more rows than the
    largest session has. The histogram of sizes, with at most sqrt(2 N) rows for N rows, gives the
    first number of each size; sessions of one size are numbered among themselves, in several
    tasks where they are many. NULL sessions are one session.
    """
    sizes = stage(df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_size")).withColumn("_draw", draw("_key", seed=seed)))
    histogram = sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("_n"))
    larger = Window.orderBy(F.col("_size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = stage(histogram.select("_size", F.coalesce(F.sum("_n").over(larger), F.lit(0)).alias("_first")))
    placed = in_order(sizes, ["_size"], "_draw", ["_key"], want={"_pos": "pos"})
    turn = F.pmod(F.col("_first") + F.col("_pos") - 1, F.lit(2 * n))
    few = first.limit(FEW_VALUES + 1).count() <= FEW_VALUES
    dealt = placed.join(F.broadcast(first) if few else first, "_size").select(
        "_key", F.when(turn < n, turn).otherwise(2 * n - 1 - turn).alias("fold")
    )
    return df.join(dealt, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def _any_positive(labels: Sequence[str]) -> Column:
    return F.greatest(*[F.col(c) for c in labels]) == 1 if len(labels) > 1 else F.col(labels[0]) == 1


def sample_negatives(df: DataFrame, labels: Sequence[str], ratio: int = 20, seed: int = 0, written: bool = False) -> DataFrame:
    """All positives and at most ``ratio`` times as many random negatives, exactly.

    The wanted number of smallest draws is found without a global sort: draws are counted
    in 65,536 slots, whole slots are taken up to the limit, and only the slot on the limit
    is ranked. The rows are read for the counts and for each part, so they are written once,
    unless they come from a table that is (``written``).
    """
    df = df if written else stage(df)
    positive = _any_positive(labels)
    drawn = df.withColumn("_draw", draw("session", "aid", seed=seed))
    slot = F.floor(F.col("_draw") / F.lit(2.0**32 / SLOTS)).cast("long")
    neg = drawn.where(~positive).withColumn("_slot", slot)
    wanted = (df.agg(F.count_if(positive).alias("n")).scalar() * ratio).alias("w")
    counts = neg.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0))
    # at most SLOTS rows in this window
    plan = counts.withColumn("_upto", upto).withColumn("_left", wanted - (F.col("_upto") - F.col("_n"))).where(F.col("_left") > 0)
    full = plan.where(F.col("_n") <= F.col("_left")).select("_slot")
    edge = plan.where(F.col("_n") > F.col("_left")).select("_slot", "_left")
    whole = neg.join(F.broadcast(full), "_slot", "left_semi")
    order = Window.partitionBy("_slot").orderBy("_draw", "session", "aid")
    part = (
        neg.join(F.broadcast(edge), "_slot").withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= F.col("_left"))
    )
    cols = df.columns
    return df.where(positive).unionByName(whole.select(*cols)).unionByName(part.select(*cols))


def keep_negatives(df: DataFrame, label: str, one_in: int = 15, seed: int = 0) -> DataFrame:
    """All positives, and each negative with chance 1 in ``one_in``."""
    return df.where((F.col(label) == 1) | (bucket("session", "aid", n=one_in, seed=seed) == 0))


def sampled_dataset(df: DataFrame, n_folds: int = 5, ratio: int = 20, seed: int = 0, written: bool = False) -> DataFrame:
    """Training rows: target sessions, sampled negatives, folds and the combined label. ``written``: ``df`` is a written table."""
    base = df.where(F.col("split") != "train")
    rows = sample_negatives(base, ["click_label", "cart_label", "order_label"], ratio, seed, written)
    both = ((F.col("cart_label") + F.col("order_label")) >= 1).cast("long")
    return add_fold(rows, n_folds, seed).withColumn("cart_order_label", both)


def dense_ids(df: DataFrame, col: str, name: str) -> DataFrame:
    """Number the distinct values of a column from 0, without a global sort.

    Values fall into slots by hash; each slot is numbered on its own and shifted by the
    sizes of the slots before it.
    """
    ids = stage(df.select(col).distinct()).withColumn("_slot", F.pmod(F.xxhash64(col), F.lit(SLOTS)))
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    # at most SLOTS rows in this window
    sizes = ids.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_slot").orderBy(col))
    placed = ids.withColumn("_rn", inside).join(F.broadcast(starts), "_slot")
    return placed.select(col, (F.col("_start") + F.col("_rn") - 1).cast("int").alias(name))


def ordered_ids(df: DataFrame, col: str, name: str, part_values: int = PART_VALUES) -> DataFrame:
    """Number the distinct values of a column from 0 in their order.

    Values are dealt to ranges of about ``part_values``; each range is numbered on its own and
    shifted by the sizes of the ranges before it. NULL is the first value, where there is one.
    """
    values = stage(df.select(col).distinct())
    parts = max(1, -(-values.count() // part_values))
    ranged = stage(values.repartitionByRange(parts, col).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range in this window
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(col))
    placed = ranged.withColumn("_rn", inside).join(F.broadcast(starts), "_part")
    return placed.select(col, (F.col("_start") + F.col("_rn") - 1).alias(name))


def _coded(df: DataFrame, c: str) -> DataFrame:
    """A category column as numbers from 0 in alphabetical order; NULL is the number after the last."""
    texts = df.withColumn(c, F.col(c).cast("string"))
    codes = stage(ordered_ids(texts.where(F.col(c).isNotNull()), c, "_code"))
    n = codes.count()
    number = F.coalesce("_code", F.lit(n)).cast("double")
    codes = F.broadcast(codes) if n <= FEW_VALUES else codes
    return texts.join(codes, c, "left").withColumn(c, number).drop("_code").select(*df.columns)


def encode(df: DataFrame, cat_cols: Sequence[str], num_cols: Sequence[str], missing: float = -1.0, cap: float = 1e18) -> DataFrame:
    """Columns for a tree learner: category codes, and numbers without NULL, NaN or infinity."""
    out = df
    for c in cat_cols:
        out = _coded(out, c)

    def clean(c: str) -> Column:
        x = F.col(c).cast("double")
        endless = F.abs(x) == float("inf")
        return F.when(x.isNull() | F.isnan(x), F.lit(missing)).when(endless, F.signum(x) * cap).otherwise(x)

    return out.withColumns({c: clean(c) for c in num_cols}) if num_cols else out
