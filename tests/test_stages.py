"""Stages of a data set: bucketed on the pair, so that joins move no rows."""

import pytest
from pyspark.sql import functions as F

from sessionrank.operators.dataset import PAIR, assemble
from sessionrank.settings import stage_by


@pytest.fixture()
def shuffled_joins(spark):
    """No broadcast joins, which hide exchanges at small sizes."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k in keys:
        spark.conf.unset(k)


def tables(spark, kept):
    pairs = spark.range(4_000).select((F.col("id") % 90).alias("session"), F.floor(F.col("id") / 90).alias("aid"))
    by_pair = [
        kept(spark.range(m * 700).select((F.col("id") % 90).alias("session"), F.floor(F.col("id") / 90).alias("aid"), (F.col("id") * m).alias(f"f{m}")))
        for m in range(1, 18)
    ]
    sessions = spark.range(60).select(F.col("id").alias("session"), (F.col("id") * 2).alias("s"))
    items = spark.range(40).select(F.col("id").alias("aid"), (F.col("id") * 3).alias("i"))
    return pairs, [(t, PAIR) for t in by_pair] + [(sessions, ("session",)), (items, ("aid",))]


def test_seventeen_joins_without_an_exchange(spark, shuffled_joins):
    pairs, bucketed = tables(spark, lambda t: stage_by(t, PAIR))
    out = assemble(pairs, bucketed, bucketed=True)
    out.write.format("noop").mode("overwrite").save()
    rows = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") >= 17 and "Exchange" not in plan
    plain = assemble(*tables(spark, lambda t: t))
    assert out.columns == plain.columns and len(rows) == 4_000
    assert sorted(rows, key=str) == sorted(plain.collect(), key=str)


def test_bucketed_tables_leave_no_name(spark):
    before = len(spark.catalog.listTables())
    table = stage_by(spark.range(100).select((F.col("id") % 9).alias("session"), F.col("id").alias("aid")), PAIR)
    assert len(spark.catalog.listTables()) == before
    assert table.count() == 100 and table.groupBy("session").count().count() == 9
    empty = stage_by(spark.range(0).select(F.col("id").alias("session"), F.col("id").alias("aid")), PAIR)
    assert empty.count() == 0 and empty.join(table, list(PAIR)).count() == 0
