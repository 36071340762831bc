"""The split paths for hot sessions, items and buckets give the same results."""

import pytest

from registry.catalogue import QUERIES
from registry.check import compare

SPLIT = [
    "w_row_number",
    "w_dense_rank",
    "w_percent_rank",
    "w_lag_lead",
    "w_running_sum",
    "w_partition_agg",
    "dedup_consecutive",
    "pairs_time",
    "pairs_time_1hour_typed",
    "pairs_time_1days_typed",
    "pairs_window",
    "pairs_window_dense",
    "bigram_counts",
    "cov_session_agg_w",
    "sess_real",
    "sess_gaps",
    "item_rating",
    "item_transition",
    "si_counts",
    "si_time",
    "si_latest",
    "si_a2s",
    "emb_sentences",
    "emb_edges",
    "ev_auc",
]


@pytest.mark.parametrize("name", SPLIT)
def test_split_paths(spark, duck, sf_dir, small_limits, name):
    message, rows, _ = compare(spark, duck, QUERIES[name], sf_dir)
    assert message is None, message


def test_one_session_with_a_third_of_all_rows(spark, small_limits):
    """A hot session with a burst: positions and neighbours equal a plain window."""
    from pyspark.sql import Window, functions as F

    from sessionrank.operators.order import in_order

    base = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).cast("long").alias("session"),
        (F.col("id") * 7919 % 41).alias("aid"),
        F.lit("clicks").alias("type"),
        F.when(F.col("id") % 5 == 0, F.col("id") * 1_000_000).otherwise(F.lit(10_000_000) + F.col("id") % 97).alias("us"),
    )
    got = in_order(
        base, ["session"], "us", ["aid", "type"], {"pos": "pos", "rpos": "rpos", "dense": "dense", "size": "size", "n": "next"}, carry=["us", "aid"]
    ).select("session", "us", "aid", "pos", "rpos", "dense", "size", F.col("n.us").alias("n_us"), F.col("n.aid").alias("n_aid"))
    w = Window.partitionBy("session").orderBy("us", "aid", "type")
    size = F.count(F.lit(1)).over(Window.partitionBy("session"))
    want = base.select(
        "session",
        "us",
        "aid",
        F.row_number().over(w).cast("long").alias("pos"),
        (size - F.row_number().over(w) + 1).cast("long").alias("rpos"),
        F.dense_rank().over(Window.partitionBy("session").orderBy("us")).cast("long").alias("dense"),
        size.alias("size"),
        F.lead("us").over(w).alias("n_us"),
        F.lead("aid").over(w).alias("n_aid"),
    )
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("power", [1, 3, 8])
def test_stretches_stay_below_the_limit(spark, power):
    """Also for real scores that crowd near zero."""
    from pyspark.sql import functions as F

    from sessionrank.operators.order import cut_hot
    from sessionrank.settings import HOT_ROWS_KEY

    rows = spark.range(20_000).select(F.lit(1).alias("all"), F.pow((F.col("id") + 1) / 20_000, F.lit(float(power))).alias("s"))
    spark.conf.set(HOT_ROWS_KEY, "500")
    try:
        every, only, names = cut_hot(rows, ["all"], "s")
    finally:
        spark.conf.unset(HOT_ROWS_KEY)
    assert every.groupBy(*names).count().agg(F.max("count")).first()[0] <= 500
    assert every.count() == only.count() == 20_000
    # stretches follow the order of the scores
    ends = every.groupBy(*names).agg(F.min("s").alias("lo"), F.max("s").alias("hi")).orderBy(*names).collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(ends, ends[1:]))


def test_plain_window_where_nothing_is_hot(spark):
    from pyspark.sql import functions as F

    from sessionrank.operators.order import in_order

    rows = spark.range(100).select((F.col("id") % 7).alias("session"), F.col("id").alias("us"))
    plan = in_order(rows, ["session"], "us", [], {"pos": "pos"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_popular_item_is_split(spark):
    """One item in most sessions: the adaptive plan splits its partition in the join with the edges."""
    from pyspark.sql import functions as F

    from sessionrank.operators import covisit as cv

    n = 60_000
    latest = spark.range(n).select(F.col("id").alias("session"), F.when(F.col("id") % 10 < 9, F.lit(1)).otherwise(F.col("id") % 500).alias("aid"), F.lit(1).alias("n")).repartition(8)
    counts = spark.range(5_000).select((F.col("id") % 500).alias("aid_x"), F.col("id").alias("aid_y"), F.lit(3).alias("weight"))
    edges = cv.top_neighbours(counts, ["weight"], 300, then=())
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        out = cv.expand(latest, edges)
        out.write.format("noop").mode("overwrite").save()
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == n * 10 and "skew=true" in plan


RANKED = ["w_multi_rank_filter", "cov_topk", "cov_session_agg", "cov_session_agg_w", "bigram_candidates", "join_matrix", "st_rank_model", "st_rank_rows"]


@pytest.mark.parametrize("name", RANKED)
def test_ranks_of_hot_groups(spark, duck, sf_dir, name):
    """Groups above the limit are ranked by many tasks, with the same ranks."""
    from sessionrank.settings import HOT_ROWS_KEY

    spark.conf.set(HOT_ROWS_KEY, "25")
    try:
        message, rows, _ = compare(spark, duck, QUERIES[name], sf_dir)
    finally:
        spark.conf.unset(HOT_ROWS_KEY)
    assert message is None and rows, message


def test_ranges_of_ranks_stay_below_the_limit(spark):
    """One group with a third of all rows, most scores equal, some null: equal ranks, bounded ranges."""
    from pyspark.sql import Window, functions as F

    from sessionrank.operators import ranks as rk
    from sessionrank.settings import HOT_ROWS_KEY

    limit = 500
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 997 == 1, F.lit(None)).otherwise(F.col("id") % 400).cast("long").alias("session"),
        F.col("id").alias("aid"),
        F.when(F.col("id") % 10 < 8, F.lit(2)).when(F.col("id") % 10 == 8, F.lit(None)).otherwise(F.col("id") * 7919 % 83).alias("n"),
        F.pow(F.col("id") % 101 / 100, F.lit(9.0)).alias("x"),
    )
    scores = {"r_n": "n", "r_x": F.col("x") * 2}
    spark.conf.set(HOT_ROWS_KEY, str(limit))
    try:
        got = rk.row_ranks(rows, "session", scores)
        kept = rk.keep_any_rank(rows, "session", scores, 3, members=rows.select("aid")).count()
        hot = rows.where("session = 7")
        dealt = rk.deal_ranges(hot, "session", [F.col("n").desc_nulls_last(), F.col("aid")], limit, hot.count())
    finally:
        spark.conf.unset(HOT_ROWS_KEY)
    want = rows
    for name, score in (("r_n", "n"), ("r_x", "x")):
        want = want.withColumn(name, F.row_number().over(Window.partitionBy("session").orderBy(F.col(score).desc_nulls_last(), "aid")))
    assert got.schema.names == want.schema.names and got.count() == 30_000
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert kept == want.where("r_n <= 3 or r_x <= 3").count()
    sizes = dealt.groupBy("_range").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= limit and sizes[1] == hot.count()


def test_dense_ranks_of_a_hot_group(spark):
    """Many equal scores and some null: ranks without gaps across the ranges."""
    from pyspark.sql import Window, functions as F

    from sessionrank.operators import ranks as rk
    from sessionrank.settings import HOT_ROWS_KEY

    rows = spark.range(6_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 400).alias("session"),
        F.col("id").alias("aid"),
        F.when(F.col("id") % 11 > 0, F.col("id") * 7919 % 83 / 83).alias("p"),
    )
    order = [F.col("p").desc_nulls_last()]
    spark.conf.set(HOT_ROWS_KEY, "200")
    try:
        out = rk.row_numbers(rows, "session", {"r": order}, fn="dense_rank")
        got, plan = out.collect(), out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(HOT_ROWS_KEY)
    want = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("session").orderBy(*order))).collect()
    assert sorted(got, key=lambda x: x["aid"]) == sorted(want, key=lambda x: x["aid"])
    assert "_range" in plan


def test_ranks_are_plain_windows_where_nothing_is_hot(spark):
    from pyspark.sql import functions as F

    from sessionrank.operators.ranks import row_ranks

    rows = spark.range(100).select((F.col("id") % 7).alias("session"), F.col("id").alias("aid"), (F.col("id") % 5).alias("n"))
    plan = row_ranks(rows, "session", {"r": "n", "q": F.col("n") + 1})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
