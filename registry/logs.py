"""Event logs, labels and vectors derived from the given tables, in Spark and in SQL.

``small``: the events table, one session per user, no equal times in a session.
``big``: order lines, one session per customer, with equal times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionrank.functions.vectors import unit
from sessionrank.settings import stage

CUT = "2024-01-24"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _instant(ntz):
    """Wall-clock time read as UTC, whatever the session time zone is."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ntz))


def _split():
    return F.when(F.col("session") % 5 == 0, F.lit("valid")).otherwise(F.lit("train"))


def small_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").alias("session"),
            F.get_json_object("props", "$.k").cast("long").alias("aid"),
            _instant(F.col("ts")).alias("ts"),
            F.when(kind.isin("click", "view", "error"), "clicks").when(kind == "signup", "carts").when(kind == "purchase", "orders").alias("type"),
        )
        .withColumn("split", _split())
    )


def _late():
    return (F.col("split") == "valid") & (F.unix_micros("ts") >= F.unix_micros(F.lit(f"{CUT} 00:00:00+00:00").cast("timestamp")))


def small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_all(spark, sf_dir).where(~_late())


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First click, and the distinct carted and ordered items, after the cut."""
    late = small_all(spark, sf_dir).where(_late())
    first = F.array(F.min_by("aid", F.struct("ts", "aid")))
    clicks = late.where(F.col("type") == "clicks").groupBy("session", "type").agg(first.alias("ground_truth"))
    others = (
        late.where(F.col("type") != "clicks")
        .groupBy("session", "type")
        .agg(F.sort_array(F.collect_set("aid")).alias("ground_truth"))
    )
    return clicks.unionByName(others)


def big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read several times by most queries, and written for each of them."""
    flag = F.col("l_returnflag")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    at = F.unix_micros(_instant(F.col("o_orderdate"))) + F.col("l_linenumber").cast("long") * 1_000_000
    return stage(
        lines.join(orders, "l_orderkey")
        .select(
            F.col("o_custkey").alias("session"),
            F.col("l_partkey").alias("aid"),
            F.timestamp_micros(at).alias("ts"),
            F.when(flag == "N", "clicks").when(flag == "A", "carts").when(flag == "R", "orders").alias("type"),
        )
        .withColumn("split", _split())
    )


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("aid"), unit(F.col("embedding").cast("array<double>")).alias("vector"))


def session_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of the distinct items of each target session of the small log."""
    items = small(spark, sf_dir).where(F.col("split") != "train").select("session", "aid").distinct()
    parts = items.join(item_vectors(spark, sf_dir), "aid").select("session", F.posexplode("vector").alias("i", "x"))
    means = parts.groupBy("session", "i").agg(F.avg("x").alias("x"))
    packed = F.sort_array(F.collect_list(F.struct("i", "x")))
    return means.groupBy("session").agg(packed.alias("p")).select("session", F.col("p.x").alias("session_vector"))


SMALL_ALL_SQL = """
log_all AS (
  SELECT user_id AS session, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS aid, epoch_us(ts) AS us,
         CASE event_type WHEN 'click' THEN 'clicks' WHEN 'view' THEN 'clicks' WHEN 'error' THEN 'clicks' WHEN 'signup' THEN 'carts' WHEN 'purchase' THEN 'orders' END AS type,
         CASE WHEN user_id % 5 = 0 THEN 'valid' ELSE 'train' END AS split
  FROM events
),
"""
SMALL_SQL = SMALL_ALL_SQL + f"""
log AS (SELECT * FROM log_all WHERE split = 'train' OR us < epoch_us(TIMESTAMP '{CUT}')),
"""
LABELS_SQL = f"""
late AS (SELECT * FROM log_all WHERE split = 'valid' AND us >= epoch_us(TIMESTAMP '{CUT}')),
labels AS (
  SELECT session, type, [arg_min(aid, us)] AS ground_truth FROM late WHERE type = 'clicks' GROUP BY ALL
  UNION ALL
  SELECT session, type, list(DISTINCT aid ORDER BY aid) FROM late WHERE type <> 'clicks' GROUP BY ALL
),
truth AS (
  SELECT session, any_value(ground_truth) FILTER (type = 'clicks') AS click_labels,
         any_value(ground_truth[1]) FILTER (type = 'clicks') AS click_label,
         any_value(ground_truth) FILTER (type = 'carts') AS cart_label,
         any_value(ground_truth) FILTER (type = 'orders') AS order_label
  FROM labels GROUP BY session
),
"""
BIG_SQL = """
log AS (
  SELECT o_custkey AS session, l_partkey AS aid, epoch_us(o_orderdate) + l_linenumber * 1000000 AS us,
         CASE l_returnflag WHEN 'N' THEN 'clicks' WHEN 'A' THEN 'carts' WHEN 'R' THEN 'orders' END AS type,
         CASE WHEN o_custkey % 5 = 0 THEN 'valid' ELSE 'train' END AS split
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
"""
VECTORS_SQL = """
raw_vec AS (SELECT vec_id AS aid, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
vec AS (SELECT aid, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS vector FROM raw_vec),
"""
SESSION_VECTORS_SQL = """
svec AS (
  SELECT session, list(m ORDER BY i) AS session_vector FROM (
    SELECT session, i, avg(vector[i]) AS m
    FROM (SELECT DISTINCT session, aid FROM log WHERE split <> 'train') JOIN vec USING (aid), range(1, 65) AS r(i)
    GROUP BY session, i
  ) GROUP BY session
),
"""
WEIGHT_SQL = "CASE type WHEN 'clicks' THEN 1 WHEN 'carts' THEN 6 WHEN 'orders' THEN 3 END"
