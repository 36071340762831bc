"""Ranking of candidate tables and global ranks.

Candidate tables have one row per (session, item), so a session group is at most as long
as the catalogue; ``row_numbers`` ranks groups above ``hot_rows`` in many tasks. Event groups
go through ``order.in_order``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionrank.operators.order import EVENT_TIES, FEW_KEYS, in_order, with_micros
from sessionrank.settings import hot_rows, stage

FUNCTIONS = {"row_number": F.row_number, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "rank": F.rank}


def rank_in(keys: Sequence[str], order: Sequence[Column], fn: str = "row_number") -> Column:
    """Rank inside bounded groups, e.g. candidates of a session."""
    return FUNCTIONS[fn]().over(Window.partitionBy(*keys).orderBy(*order))


def deal_ranges(rows: DataFrame, key: str, order: Sequence[Column], limit: int, n: int) -> DataFrame:
    """``n`` rows written in ranges of (key, order), numbered ascending in ``_range``.

    Ranges hold half of ``limit`` rows on average. Their borders come from Spark's sample of each
    input part, whose error is about a tenth, so none reaches the limit unless rows are
    equal in the key and the whole order.
    """
    parts = max(1, -(-2 * n // limit))
    return stage(rows.repartitionByRange(parts, key, *order).withColumn("_range", F.spark_partition_id()))


def row_numbers(
    df: DataFrame, key: str, orders: dict[str, Sequence[Column]], members: DataFrame | int | None = None, fn: str = "row_number"
) -> DataFrame:
    """One row number, or dense rank (``fn``), per order inside the groups of ``key``.

    Where no group has more than ``hot_rows`` rows these are plain windows in one partitioning.
    Rows of larger groups are dealt to ranges of each order in turn: a task numbers the rows of
    a range, and the rows in earlier ranges of the group, a small table, are added. Every
    sort then meets a bounded number of rows, whatever the scores and ties. Rows equal in
    the whole order are numbered in any order; rows without a key are not parted. A dense rank
    has its equal rows in one range, and the greatest rank of a range is what comes before the next.

    ``members`` is a table whose distinct rows no group can outnumber, such as the items that
    may be proposed. It is counted instead of ``df``, where that is costly to derive.
    """
    limit = hot_rows(df.sparkSession)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumns(
            {name: rank_in([key], order, fn) for name, order in orders.items()}
        )

    if members is not None:
        if (members if isinstance(members, int) else members.distinct().count()) <= limit:
            return plain(df)
        df = stage(df)
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= limit:
        return plain(df)
    if members is None:
        df = stage(df)
    large = stage(sizes.where(F.col("_n") > limit))
    groups, n = large.agg(F.count(F.lit(1)), F.sum("_n")).first()
    names = large.select(key)
    names = F.broadcast(names) if groups <= FEW_KEYS else names
    hot = df.join(names, key, "left_semi")
    for name, order in orders.items():
        dealt = deal_ranges(hot, key, order, limit, n)
        along = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        placed = dealt.withColumn("_inside", rank_in([key, "_range"], order, fn))
        if fn == "row_number":
            before = dealt.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
        else:
            before = placed.groupBy(key, "_range").agg(F.max("_inside").alias("_n"))
        before = before.select(key, "_range", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
        hot = (
            placed.join(before, [key, "_range"])
            .withColumn(name, (F.col("_inside") + F.col("_before")).cast("int"))
            .drop("_range", "_inside", "_before")
        )
    return plain(df.join(names, key, "left_anti")).unionByName(hot)


def row_ranks(
    df: DataFrame, key: str, scores: dict[str, Column | str], tie: str = "aid", members: DataFrame | int | None = None
) -> DataFrame:
    """One row number per score, greatest first, equal scores by ``tie``.

    A score is the name of a column or an expression. Expressions become columns first: a
    sort evaluates its expressions at every comparison. ``members`` as in ``row_numbers``.
    """
    made = {f"_score{i}": s for i, s in enumerate(scores.values()) if not isinstance(s, str)}
    names = [s if isinstance(s, str) else f"_score{i}" for i, s in enumerate(scores.values())]
    orders = {rank: [F.col(name).desc_nulls_last(), F.col(tie)] for rank, name in zip(scores, names)}
    rows = df.withColumns(made) if made else df
    return row_numbers(rows, key, orders, members).drop(*made)


def any_rank(names: Sequence[str], k: int) -> Column:
    """True where one of the ranks is at most ``k``."""
    return F.least(*[F.col(n) for n in names]) <= k if len(names) > 1 else F.col(names[0]) <= k


def keep_any_rank(
    df: DataFrame,
    key: str,
    scores: dict[str, Column | str],
    k: int,
    tie: str = "aid",
    members: DataFrame | int | None = None,
) -> DataFrame:
    """Add the ranks and keep rows that are among the first ``k`` of at least one."""
    return row_ranks(df, key, scores, tie, members).where(any_rank(list(scores), k))


def event_ranks(ev: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Position columns of every event in its group.

    ``rn`` and ``rn_last`` count from the first and from the last event, ``dense_ts`` and
    ``dense_ts_last`` count distinct times, ``pct`` is the percent rank by time, and
    ``group_size`` the number of events.
    """
    timed = with_micros(ev)
    out = in_order(
        timed,
        list(keys),
        "us",
        [t for t in EVENT_TIES if t not in keys],
        want={
            "rn": "pos",
            "rn_last": "rpos",
            "_rank": "rank",
            "dense_ts": "dense",
            "dense_ts_last": "rdense",
            "group_size": "size",
        },
    )
    return out.withColumn("pct", percent(F.col("_rank"), F.col("group_size"))).drop("us", "_rank")


def percent(rank: Column, size: Column) -> Column:
    """Percent rank from a rank and the group size; 0 for a single row."""
    return F.when(size > 1, (rank - 1) / (size - 1).cast("double")).otherwise(F.lit(0.0))


def last_item(ev: DataFrame, type: str | None = None, name: str = "last_aid") -> DataFrame:
    """Item of the latest event of each session, optionally of one action: an aggregate, no sort."""
    events = ev if type is None else ev.where(F.col("type") == type)
    return events.groupBy("session").agg(F.max_by("aid", F.struct("ts", "aid")).alias(name))


def histogram_before(df: DataFrame, col: str, keys: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """Frequencies of the values of a count column, with the number of rows before each.

    Distinct values of a positive count whose sum is N are at most sqrt(2 N), so the sorted
    table stays small for any log.
    """
    freq = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_freq"))
    order = F.col(col).desc() if descending else F.col(col).asc()
    along = Window.partitionBy(*keys).orderBy(order)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return freq.withColumns(
        {"_rows_before": F.coalesce(F.sum("_freq").over(before), F.lit(0)), "_rows": F.sum("_freq").over(whole)}
    )


def average_rank(df: DataFrame, col: str, name: str, pct: bool = False, descending: bool = True) -> DataFrame:
    """Global rank where equal values share their mean rank; ``pct`` divides by the row count."""
    hist = histogram_before(df, col, (), descending)
    rank = F.col("_rows_before") + (F.col("_freq") + 1) / F.lit(2.0)
    hist = hist.select(col, (rank / F.col("_rows") if pct else rank).alias(name))
    return df.join(F.broadcast(hist), col, "left").select(*df.columns, name)


def position_by_count(counts: DataFrame, keys: Sequence[str], count: str, name: str, item: str = "aid") -> DataFrame:
    """0-based global position by descending count, equal counts by item.

    Items of one count value may be most of the catalogue, so their order is found with the
    stretch windows and the offsets come from the count histogram.
    """
    inside = in_order(counts, [*keys, count], item, [], want={"_inside": "pos"})
    hist = histogram_before(counts, count, keys).select(*keys, count, "_rows_before")
    joined = inside.join(F.broadcast(hist), [*keys, count])
    position = (F.col("_rows_before") + F.col("_inside") - 1).cast("long")
    return joined.select(*counts.columns, position.alias(name))
