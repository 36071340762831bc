"""Positions, neighbours and running totals inside ordered groups.

A plain window puts every row of a key into one task, which fails when one session holds
a large share of the log. Here the largest key is looked up first. Where none has more than
``hot_rows`` rows, the plan is the plain window. Otherwise hot keys are cut into consecutive
stretches of the ordering column, again and again until none is too large; windows run per
(key, stretch), and a small table of stretch totals supplies the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionrank.settings import hot_rows, stage

TASK_ROWS = 250_000  # of a log, that a task orders
MAX_LEVELS = 40  # a cut makes a stretch a quarter as wide at most: 40 part any two numbers of 64 bits
FEW_KEYS = 500_000


def _sizes(rows: DataFrame, on: Sequence[str], lead: str) -> DataFrame:
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min(lead).alias("_lo"), F.max(lead).alias("_hi"))


def cut_hot(
    df: DataFrame, keys: Sequence[str], lead: str, census: DataFrame | None = None, dealt: bool = False
) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """Add stretch numbers that follow the order of the numeric column ``lead``.

    Returns all rows, the rows of hot keys alone, and the names of the stretch columns; no
    hot rows and no columns where no key is hot. All rows are dealt by key and stretch to as many
    tasks as hold ``TASK_ROWS`` each, where they are more than that: the memory of a task does not
    grow with the log, whatever the number of shuffle partitions. A key of n rows gets about 4 n / hot_rows
    stretches of equal width, and each that is still too large is cut in the same way, so
    that any distribution of values ends in stretches below the limit. Only rows with one
    value of ``lead`` cannot be parted. A list of hot keys or stretches has at most
    rows / hot_rows entries; it is written, and broadcast if that is few.

    Rows are counted in ``census``, a table that holds at least the keys and ``lead`` of all
    rows of ``df``: the log itself, where ``df`` is expensive to derive from it. ``dealt`` says that
    an order by ``keys`` or fewer has dealt the rows already.
    """
    limit = hot_rows(df.sparkSession)

    def number(rows: DataFrame, hot: DataFrame, on: list[str], how: str, name: str) -> DataFrame:
        part = F.floor((F.col(lead) - F.col("_lo")) / F.col("_span") * F.col("_parts"))
        joined = rows.join(hot, on, how)
        at = F.coalesce(F.least(part, F.col("_parts") - 1) + 1, F.lit(0)).cast("long")
        return joined.withColumn(name, at).drop("_lo", "_span", "_parts")

    def too_large(sizes: DataFrame, on: list[str]) -> DataFrame:
        span = (F.col("_hi") - F.col("_lo")).cast("double").alias("_span")
        parts = (4 * F.ceil(F.col("_n") / limit)).cast("double").alias("_parts")
        hot = stage(sizes.where((F.col("_n") > limit) & (F.col("_hi") > F.col("_lo"))).select(*on, "_lo", span, parts))
        return F.broadcast(hot) if hot.limit(FEW_KEYS + 1).count() <= FEW_KEYS else hot

    def largest(sizes: DataFrame) -> tuple[int, int]:
        most, n = sizes.agg(F.max(F.when(F.col("_hi") > F.col("_lo"), F.col("_n"))), F.sum("_n")).first()
        return most or 0, n or 0

    every, only = df, None
    counted = (df if census is None else census).select(*keys, lead)
    names: list[str] = []
    sizes = _sizes(counted, keys, lead)
    most, n = largest(sizes)
    while len(names) < MAX_LEVELS and most > limit:
        on, name = [*keys, *names], f"_stretch{len(names)}"
        hot = too_large(sizes, on)
        how = "left" if names else "inner"
        only = number(df if only is None else only, hot, on, how, name)
        counted = number(counted, hot, on, how, name)
        every = number(every, hot, on, "left", name)
        names.append(name)
        sizes = _sizes(counted, [*keys, *names], lead)
        most, _ = largest(sizes)
    if n > TASK_ROWS and not dealt:
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
        every = every.repartition(tasks, *keys, *names)
    return every, only, names


def in_order(
    df: DataFrame,
    keys: Sequence[str],
    lead: str,
    ties: Sequence[str],
    want: dict[str, str],
    carry: Sequence[str] = (),
    flag: str | None = None,
    census: DataFrame | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Add ordered-group columns.

    Rows of a key are ordered by the numeric column ``lead`` and then by ``ties``. ``want``
    maps new column names to one of: ``pos`` (row number), ``rpos`` (row number from the
    end), ``rank`` and ``dense`` (by ``lead`` only), ``rdense`` (dense rank from the end),
    ``size``, ``last`` (greatest ``lead``), ``first`` (least ``lead``), ``prev`` and ``next``
    (struct of the ``carry`` columns of the neighbouring row), ``running`` (sum of ``flag``
    up to and including the row). ``census`` and ``dealt`` are explained at ``cut_hot``.
    """
    kinds = set(want.values())
    base, hot, stretches = cut_hot(df, keys, lead, census, dealt)
    part = [*keys, *stretches]
    by_row = Window.partitionBy(*part).orderBy(lead, *ties)
    by_lead = Window.partitionBy(*part).orderBy(lead)
    whole = Window.partitionBy(*part)
    row = F.struct(*carry) if carry else None

    ordered: dict[str, Column] = {}
    if kinds & {"pos", "rpos"}:
        ordered["_pos"] = F.row_number().over(by_row)
    if "prev" in kinds:
        ordered["_prev"] = F.lag(row).over(by_row)
    if "next" in kinds:
        ordered["_next"] = F.lead(row).over(by_row)
    if "running" in kinds:
        ordered["_run"] = F.sum(flag).over(by_row.rowsBetween(Window.unboundedPreceding, 0))
    leads: dict[str, Column] = {}
    if "rank" in kinds:
        leads["_rank"] = F.rank().over(by_lead)
    if kinds & {"dense", "rdense"}:
        leads["_dense"] = F.dense_rank().over(by_lead)
    totals: dict[str, Column] = {}
    if kinds & {"size", "rpos"}:
        totals["_size"] = F.count(F.lit(1)).over(whole)
    if "rdense" in kinds:
        totals["_levels"] = F.max("_dense").over(whole)
    if "last" in kinds:
        totals["_last"] = F.max(lead).over(whole)
    if "first" in kinds:
        totals["_first"] = F.min(lead).over(whole)
    out = base
    for group in (ordered, leads, totals):
        if group:
            out = out.withColumns(group)

    if stretches:
        offsets = stage(_stretch_offsets(hot, keys, stretches, lead, ties, kinds, row, flag))
        few = offsets.limit(FEW_KEYS + 1).count() <= FEW_KEYS
        out = out.join(F.broadcast(offsets) if few else offsets, part, "left")

    def shifted(local: str, offset: str) -> Column:
        return F.col(local) + F.coalesce(F.col(offset), F.lit(0)) if stretches else F.col(local)

    def total(local: str, overall: str) -> Column:
        return F.coalesce(F.col(overall), F.col(local)) if stretches else F.col(local)

    formulas = {
        "pos": lambda: shifted("_pos", "_before"),
        "rpos": lambda: total("_size", "_all") - shifted("_pos", "_before") + 1,
        "rank": lambda: shifted("_rank", "_before"),
        "dense": lambda: shifted("_dense", "_levels_before"),
        "rdense": lambda: total("_levels", "_levels_all") - shifted("_dense", "_levels_before") + 1,
        "size": lambda: total("_size", "_all"),
        "last": lambda: total("_last", "_last_all"),
        "first": lambda: total("_first", "_first_all"),
        "prev": lambda: F.coalesce(F.col("_prev"), F.col("_prev_row")) if stretches else F.col("_prev"),
        "next": lambda: F.coalesce(F.col("_next"), F.col("_next_row")) if stretches else F.col("_next"),
        "running": lambda: shifted("_run", "_run_before"),
    }
    plain = {"prev", "next"}
    new = [
        (formulas[kind]() if kind in plain else formulas[kind]().cast("long")).alias(name) for name, kind in want.items()
    ]
    return out.select(*[c for c in df.columns if c not in want], *new)


def _stretch_offsets(hot, keys, stretches, lead, ties, kinds, row, flag) -> DataFrame:
    """One row per stretch of a hot key: what lies before it and in the whole key."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    if kinds & {"dense", "rdense"}:
        aggs.append(F.count_distinct(lead).alias("_d"))
    if "last" in kinds:
        aggs.append(F.max(lead).alias("_hi"))
    if "first" in kinds:
        aggs.append(F.min(lead).alias("_lo"))
    place = F.struct(lead, *ties)
    if "prev" in kinds:
        aggs.append(F.max_by(row, place).alias("_end_row"))
    if "next" in kinds:
        aggs.append(F.min_by(row, place).alias("_start_row"))
    if "running" in kinds:
        aggs.append(F.sum(flag).alias("_f"))
    table = hot.groupBy(*keys, *stretches).agg(*aggs)

    along = Window.partitionBy(*keys).orderBy(*stretches)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    over_key = Window.partitionBy(*keys)
    cols = [F.sum("_n").over(before).alias("_before"), F.sum("_n").over(over_key).alias("_all")]
    if kinds & {"dense", "rdense"}:
        cols += [F.sum("_d").over(before).alias("_levels_before"), F.sum("_d").over(over_key).alias("_levels_all")]
    if "last" in kinds:
        cols.append(F.max("_hi").over(over_key).alias("_last_all"))
    if "first" in kinds:
        cols.append(F.min("_lo").over(over_key).alias("_first_all"))
    if "prev" in kinds:
        cols.append(F.lag("_end_row").over(along).alias("_prev_row"))
    if "next" in kinds:
        cols.append(F.lead("_start_row").over(along).alias("_next_row"))
    if "running" in kinds:
        cols.append(F.sum("_f").over(before).alias("_run_before"))
    return table.select(*keys, *stretches, *cols)


def with_micros(ev: DataFrame) -> DataFrame:
    """The log with its time as epoch microseconds in ``us``, the lead column of events."""
    return ev.withColumn("us", F.unix_micros("ts"))


EVENT_TIES = ["aid", "type"]
