"""Item pairs that occur together in a session.

The base result is one row per (session, aid_x, aid_y) with a 0/1 column per action of the
second event. It holds the distinct pairs of all three actions in one row, so counting
sessions per pair and action is a plain sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sessionrank.functions.times import US
from sessionrank.operators.filters import of_types
from sessionrank.operators.order import EVENT_TIES, in_order, with_micros
from sessionrank.schema import ACTIONS, is_action
from sessionrank.settings import both_dealt, cell_items, stage

UNIT_SECONDS = {"SECOND": 1, "HOUR": 3600}
FEW_CELLS = 100_000


def reach_micros(max_gap: int, unit: str, strict: bool) -> int:
    """Time gap in microseconds that a pair must stay below.

    Gaps are compared in whole units, cut towards zero: ``strict`` keeps fewer than
    ``max_gap`` units, otherwise ``max_gap`` whole units are still kept, that is anything
    below ``max_gap + 1`` units (a limit of 24 hours reaches to just below 25).
    """
    return (max_gap if strict else max_gap + 1) * UNIT_SECONDS[unit] * US


def _flag(action: str) -> Column:
    return is_action(action).cast("int")


def pair_flags(
    ev: DataFrame,
    max_gap: int = 1,
    unit: str = "HOUR",
    strict: bool = False,
    types: Sequence[str] | None = None,
    last_n: int | None = None,
) -> DataFrame:
    """Pairs of different events of a session with a limited time gap.

    Events are first folded to one row per (session, time bucket, item), with bucket width
    equal to the reach. Two events of one bucket are always within reach, and between
    neighbouring buckets the last event of the one and the first of the other decide. So the
    self-join works on distinct items per bucket, however many events a session has. Buckets
    are joined with themselves and the next one; a meeting with the next bucket gives both
    directions. Buckets with many distinct items are joined in slices of the first side.
    """
    reach = reach_micros(max_gap, unit, strict)
    events = ev if types is None else of_types(ev, types)

    def in_cells(rows: DataFrame) -> DataFrame:
        return with_micros(rows).withColumn("cell", F.col("us") - F.pmod(F.col("us"), F.lit(reach)))

    timed = in_cells(events if last_n is None else last_times(events, last_n))

    def ends(fn, head: str) -> list[Column]:
        return [fn(F.when(is_action(a), F.col("us"))).alias(f"{head}_{a}") for a in ACTIONS]

    key = ["session", "cell", "aid"]
    # read by both sides and for the sizes of the cells
    folded = stage(timed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *ends(F.max, "hi"), *ends(F.min, "lo")))
    again = F.col("n") > 1
    last = folded.select(*key, again.alias("again_a"), *[f"hi_{a}" for a in ACTIONS])
    early = folded.select(*key, again.alias("again_b"), *[f"lo_{a}" for a in ACTIONS])
    wide = _wide_cells(folded, cell_items(ev.sparkSession))
    first = (
        last.withColumnRenamed("aid", "aid_a")
        .join(wide, ["session", "cell"], "left")
        .withColumn("slice", F.pmod(F.xxhash64("aid_a"), F.coalesce("slices", F.lit(1))).cast("int"))
        .drop("slices")
    )
    second = (
        early.withColumnRenamed("aid", "aid_b")
        .withColumn("ahead", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("cell", F.col("cell") - F.col("ahead") * F.lit(reach))
        .join(wide, ["session", "cell"], "left")
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
        .drop("slices")
    )
    same, x, y = F.col("ahead") == 0, F.col("aid_a"), F.col("aid_b")
    latest = F.greatest(*[F.col(f"hi_{a}") for a in ACTIONS])
    earliest = F.least(*[F.col(f"lo_{a}") for a in ACTIONS])
    there = F.when(same, (x != y) | F.col("again_a")).otherwise(earliest - latest < reach)
    back = F.when(same, (x != y) | F.col("again_b")).otherwise(earliest - latest < reach)
    # of the two meetings that one bucket gives two items, one is kept
    met = both_dealt(first, second, ["session", "cell", "slice"]).where((~same | _ascending(x, y)) & (there | back))
    forward = _mask([F.when(same, F.col(f"lo_{a}").isNotNull()).otherwise(F.col(f"lo_{a}") - latest < reach) for a in ACTIONS])
    backward = _mask([F.when(same, F.col(f"hi_{a}").isNotNull()).otherwise(earliest - F.col(f"hi_{a}") < reach) for a in ACTIONS])
    return _both_ways(met, _mask([there]) * PRESENT + forward, _mask([back]) * PRESENT + backward)


def _wide_cells(folded: DataFrame, size: int, cell: str = "cell") -> DataFrame:
    """Cells with more than ``size`` distinct items and the number of slices to join them in.

    The limit does not depend on the log. The table is written; it is broadcast only where
    it is known to have ``FEW_CELLS`` rows at most, and joined by a shuffle otherwise.
    """
    cell = ["session", cell]
    counts = folded.groupBy(*cell).agg(F.count(F.lit(1)).alias("_items")).where(F.col("_items") > size)
    wide = stage(counts.select(*cell, F.ceil(F.col("_items") / size).cast("int").alias("slices")))
    return F.broadcast(wide) if wide.limit(FEW_CELLS + 1).count() <= FEW_CELLS else wide


#: Bits of a direction: one for each action, then whether there is a pair in this direction.
PRESENT = 1 << len(ACTIONS)


def _mask(bits: Sequence[Column]) -> Column:
    """Conditions as one number; NULL is false."""
    return sum((F.when(b, F.lit(1 << i)).otherwise(F.lit(0)) for i, b in enumerate(bits)), F.lit(0))


def _ascending(x: Column, y: Column) -> Column:
    return F.coalesce(x.isNull() | (x <= y), F.lit(False))


def _both_ways(met: DataFrame, forward: Column, back: Column) -> DataFrame:
    """Distinct pairs of a session, of meetings of ``aid_a`` and ``aid_b`` with the bits of each direction.

    Two items travel as one row with the bits of both directions, and become two rows once they are distinct.
    """
    x, y = F.col("aid_a"), F.col("aid_b")
    up, shift = _ascending(x, y), 2 * PRESENT
    bits = F.when(up, forward + back * shift).otherwise(back + forward * shift).cast("int")
    rows = met.select("session", F.when(up, x).otherwise(y).alias("_lo"), F.when(up, y).otherwise(x).alias("_hi"), bits.alias("_bits"))
    one = rows.groupBy("session", "_lo", "_hi").agg(F.bit_or("_bits").alias("_bits"))
    own, other = F.col("_bits") % shift, F.floor(F.col("_bits") / shift).cast("int")

    def way(first: str, second: str, mask: Column) -> Column:
        return F.struct(F.col(first).alias("aid_x"), F.col(second).alias("aid_y"), mask.alias("bits"))

    with_itself = F.array(way("_lo", "_hi", own.bitwiseOR(other)))
    ways = F.when(F.col("_lo").eqNullSafe(F.col("_hi")), with_itself).otherwise(F.array(way("_lo", "_hi", own), way("_hi", "_lo", other)))
    found = one.select("session", F.explode(ways).alias("p")).where(F.col("p.bits") >= PRESENT)
    flags = [F.col("p.bits").bitwiseAND(F.lit(1 << i)).cast("boolean").cast("int").alias(a) for i, a in enumerate(ACTIONS)]
    return found.select("session", "p.aid_x", "p.aid_y", *flags)


def last_times(ev: DataFrame, n: int) -> DataFrame:
    """Events at the last ``n`` distinct times of their session."""
    ranked = in_order(with_micros(ev), ["session"], "us", EVENT_TIES, want={"_back": "rdense"})
    return ranked.where(F.col("_back") <= n).select(*ev.columns)


def window_flags(ev: DataFrame, size: int = 2, rank: str = "row_number", last_n: int | None = None) -> DataFrame:
    """Pairs of events at most ``size`` positions apart.

    ``rank='row_number'`` counts events, ``'dense_rank'`` counts distinct times (events at one
    time then do not pair). Positions are joined by equality on (session, position), which
    spreads a long session over all tasks; only forward offsets are joined and each meeting
    gives both directions. Times with many distinct items are joined in slices of the first side.
    """
    kind = {"row_number": "pos", "dense_rank": "dense"}[rank]
    want = {"at": kind}
    if last_n is not None:
        want["_back"] = "rdense"
    placed = in_order(with_micros(ev), ["session"], "us", EVENT_TIES, want=want)
    if last_n is not None:
        placed = placed.where(F.col("_back") <= last_n)
    spots = stage(placed.groupBy("session", "at", "aid").agg(*[F.max(_flag(a)).alias(a) for a in ACTIONS]))
    ahead = F.array(*[F.lit(i) for i in range(1, size + 1)])
    mask = _mask([F.col(a) == 1 for a in ACTIONS]) + PRESENT
    here = spots.select("session", "at", F.col("aid").alias("aid_a"), mask.alias("bits_a"))
    there = spots.withColumn("ahead", F.explode(ahead)).select(
        "session", (F.col("at") - F.col("ahead")).alias("at"), F.col("aid").alias("aid_b"), mask.alias("bits_b")
    )
    if rank == "dense_rank":
        wide = _wide_cells(spots, cell_items(ev.sparkSession), "at")
        slices = F.coalesce("slices", F.lit(1))
        here = here.join(wide, ["session", "at"], "left").withColumn("slice", F.pmod(F.xxhash64("aid_a"), slices).cast("int")).drop("slices")
        there = there.join(wide, ["session", "at"], "left").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("slices")
        met = both_dealt(here, there, ["session", "at", "slice"])
    else:
        met = both_dealt(here, there, ["session", "at"])
    return _both_ways(met, F.col("bits_b"), F.col("bits_a"))


def long_pairs(flags: DataFrame, keep_type: bool) -> DataFrame:
    """Pairs as DISTINCT (session, aid_x, aid_y[, type of the second event])."""
    if not keep_type:
        return flags.select("session", "aid_x", "aid_y")
    named = F.filter(F.array(*[F.when(F.col(a) == 1, F.lit(a)) for a in ACTIONS]), lambda t: t.isNotNull())
    return flags.select("session", "aid_x", "aid_y", F.explode(named).alias("type"))


def pairs_time(
    ev: DataFrame,
    max_gap: int = 3600,
    unit: str = "SECOND",
    strict: bool = True,
    types: Sequence[str] | None = None,
    keep_type: bool = False,
    last_n: int | None = None,
) -> DataFrame:
    """Distinct item pairs of a session whose events are close in time."""
    return long_pairs(pair_flags(ev, max_gap, unit, strict, types, last_n), keep_type)


def pairs_window(ev: DataFrame, size: int = 2, rank: str = "row_number", last_n: int | None = None) -> DataFrame:
    """Distinct item pairs of a session whose events are close in position."""
    return long_pairs(window_flags(ev, size, rank, last_n), True)


def pair_weight(pairs: DataFrame, min_support: int = 2) -> DataFrame:
    """Number of sessions per pair; ``pairs`` has one row per session and pair."""
    return pairs.groupBy("aid_x", "aid_y").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= min_support)


def pair_type_counts(flags: DataFrame, totals: bool = False) -> DataFrame:
    """Number of sessions per pair and action of the second event; 0 where there is none."""
    counts = flags.groupBy("aid_x", "aid_y").agg(*[F.sum(a).cast("long").alias(f"count_{a}") for a in ACTIONS])
    if totals:
        clicks, carts, orders = (F.col(f"count_{a}") for a in ACTIONS)
        counts = counts.withColumn("count_all", clicks + carts + orders)
        counts = counts.withColumn("weighted_count_all", clicks + 6 * carts + 3 * orders)
    return counts


def transitions(ev: DataFrame) -> DataFrame:
    """Item followed by the next item: occurrences and sessions."""
    steps = in_order(with_micros(ev), ["session"], "us", EVENT_TIES, want={"_then": "next"}, carry=["aid"])
    per_session = (
        steps.where(F.col("_then").isNotNull())
        .groupBy("session", F.col("aid").alias("aid_x"), F.col("_then.aid").alias("aid_y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_session.groupBy("aid_x", "aid_y").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_sessions"))


def normalise_transitions(tr: DataFrame) -> DataFrame:
    """Transition counts over the geometric mean of the outgoing totals of both items.

    The counts are read three times, so they are written once; the totals are, so that both
    sides of the joins are shuffled for them and a popular item can be split.
    """
    tr = stage(tr)
    out = stage(tr.groupBy("aid_x").agg(F.sum("n").alias("_n"), F.sum("n_sessions").alias("_s")))
    left = out.select("aid_x", F.col("_n").alias("_nx"), F.col("_s").alias("_sx"))
    right = out.select(F.col("aid_x").alias("aid_y"), F.col("_n").alias("_ny"), F.col("_s").alias("_sy"))
    one = F.lit(1)
    scaled = tr.join(left, "aid_x", "left").join(right, "aid_y", "left")
    return scaled.select(
        "aid_x",
        "aid_y",
        (F.col("n") / F.sqrt(F.coalesce("_nx", one) * F.coalesce("_ny", one))).alias("norm_transition_count"),
        (F.col("n_sessions") / F.sqrt(F.coalesce("_sx", one) * F.coalesce("_sy", one))).alias(
            "norm_transition_user_count"
        ),
    )
