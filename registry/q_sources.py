"""Sources, sinks, filters and set operations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from registry.core import add, joined
from registry.logs import BIG_SQL, LABELS_SQL, SMALL_ALL_SQL, SMALL_SQL, big, labels, small, small_all, table
from sessionrank.operators import filters as f
from sessionrank.operators.candidates import grow_outer, union_candidates
from sessionrank.operators.covisit import covisit_matrix, matrix_features
from sessionrank.operators.pairs import pair_flags, pair_weight
from sessionrank.schema import ACTION_CODES
from sessionrank.settings import shared_dir
from sessionrank.sources import events as e
from sessionrank.sources import labels as lb
from sessionrank.sources import scores as sc
from sessionrank.sources import sinks

EVENT_COLS = dict(ints=["session", "aid", "us"], texts=["type", "split"])


def us(df):
    return df.withColumn("us", F.unix_micros("ts"))


def src_events(spark, d):
    log = small_all(spark, d).withColumn("ts", F.unix_millis("ts"))
    base = shared_dir(spark)
    for part in ("train", "valid"):
        log.where(F.col("split") == part).drop("split").write.parquet(f"{base}/{part}")
    return us(e.load_events(spark, f"{base}/train", f"{base}/valid", "valid", "ms"))


add(
    "src_events",
    src_events,
    SMALL_ALL_SQL + "out AS (SELECT session, aid, us // 1000 * 1000 AS us, type, split FROM log_all)",
    **EVENT_COLS,
)
add(
    "src_type_map",
    lambda s, d: e.map_type(small(s, d), "type", ACTION_CODES).groupBy("session", "type").count(),
    SMALL_SQL
    + "out AS (SELECT session, CASE type WHEN 'clicks' THEN 0 WHEN 'carts' THEN 1 ELSE 2 END AS type, count(*) AS count FROM log GROUP BY ALL)",
    ints=["session", "type", "count"],
)


def ground_truth(s, d):
    t = lb.wide_ground_truth(labels(s, d))
    return t.withColumns({c: joined(c) for c in ("click_labels", "cart_label", "order_label")})


add(
    "src_ground_truth",
    ground_truth,
    SMALL_ALL_SQL
    + LABELS_SQL
    + "out AS (SELECT session, click_label, array_to_string(click_labels, ' ') AS click_labels, array_to_string(cart_label, ' ') AS cart_label, array_to_string(order_label, ' ') AS order_label FROM truth)",
    ints=["session", "click_label"],
    texts=["click_labels", "cart_label", "order_label"],
)
add(
    "src_labels_explode",
    lambda s, d: lb.explode_labels(labels(s, d)),
    SMALL_ALL_SQL + LABELS_SQL + "out AS (SELECT session, type, unnest(ground_truth) AS aid FROM labels)",
    ints=["session", "aid"],
    texts=["type"],
)


def src_predictions(s, d):
    base = shared_dir(s)
    log = small(s, d)
    for t in ("clicks", "carts", "orders"):
        rows = log.where(F.col("type") == t).groupBy("session", "aid").agg(F.count(F.lit(1)).cast("double").alias("pred"))
        rows.withColumn("__index_level_0__", F.lit(0)).write.parquet(f"{base}/{t}")
    return sc.load_scores(s, {t: f"{base}/{t}" for t in ("clicks", "carts", "orders")}, drop=["__index_level_0__"])


PRED_SQL = """
out AS (
  SELECT session, aid, c.n AS pred_clicks, k.n AS pred_carts, o.n AS pred_orders
  FROM (SELECT session, aid, count(*) AS n FROM log WHERE type = 'clicks' GROUP BY ALL) c
  FULL JOIN (SELECT session, aid, count(*) AS n FROM log WHERE type = 'carts' GROUP BY ALL) k USING (session, aid)
  FULL JOIN (SELECT session, aid, count(*) AS n FROM log WHERE type = 'orders' GROUP BY ALL) o USING (session, aid)
)
"""
PRED_COLS = dict(ints=["session", "aid"], reals=["pred_clicks", "pred_carts", "pred_orders"])
add("src_predictions", src_predictions, SMALL_SQL + PRED_SQL, **PRED_COLS)


def snk_table(s, d):
    path = shared_dir(s)
    sinks.save_files(small(s, d), path, ["session"])
    return us(s.read.parquet(path))


add("snk_table", snk_table, SMALL_SQL + "out AS (SELECT * FROM log)", **EVENT_COLS)


def item_lists(s, d):
    return (
        small(s, d)
        .groupBy("session")
        .agg(F.sort_array(F.collect_set("aid")).alias("aids"))
        .select(F.concat("session", F.lit("_clicks")).alias("session_type"), joined("aids").alias("labels"))
    )


def snk_submission(s, d):
    path = shared_dir(s)
    sinks.write_submission(item_lists(s, d), path)
    return s.read.option("header", True).csv(path)


add(
    "snk_submission",
    snk_submission,
    SMALL_SQL
    + "out AS (SELECT session || '_clicks' AS session_type, array_to_string(list(DISTINCT aid ORDER BY aid), ' ') AS labels FROM log GROUP BY session)",
    texts=["session_type", "labels"],
)
add(
    "src_emb_rows",
    lambda s, d: e.vectors(table(s, d, "embeddings"), "vec_id", "embedding").select("aid", F.posexplode("vector").alias("i", "x")),
    """
    wide AS (SELECT vec_id AS aid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    out AS (SELECT aid, i - 1 AS i, v[i] / sqrt(list_dot_product(v, v)) AS x FROM wide, range(1, 65) AS r(i))
    """,
    ints=["aid", "i"],
    reals=["x"],
)

# --- filters and sets -------------------------------------------------------------------
add(
    "flt_type",
    lambda s, d: us(f.of_types(small(s, d), ["carts", "orders"])),
    SMALL_SQL + "out AS (SELECT * FROM log WHERE type <> 'clicks')",
    **EVENT_COLS,
)
add(
    "flt_target_sessions",
    lambda s, d: f.target_sessions(big(s, d)),
    BIG_SQL + "out AS (SELECT DISTINCT session FROM log WHERE split <> 'train')",
    ints=["session"],
)
add(
    "prj_except",
    lambda s, d: us(small(s, d)).drop("split", "ts"),
    SMALL_SQL + "out AS (SELECT * EXCLUDE (split) FROM log)",
    ints=["session", "aid", "us"],
    texts=["type"],
)
add(
    "shard_sessions",
    lambda s, d: f.shard_sessions(big(s, d), "valid", 20, [0, 5]),
    BIG_SQL + "out AS (SELECT DISTINCT session FROM log WHERE split = 'valid' AND session % 20 IN (0, 5))",
    ints=["session"],
)
add(
    "sess_with_label",
    lambda s, d: us(f.with_labels(small(s, d), labels(s, d))),
    SMALL_SQL + LABELS_SQL + "out AS (SELECT * FROM log WHERE session IN (SELECT session FROM labels WHERE type IN ('carts', 'orders')))",
    **EVENT_COLS,
)
add(
    "dedup_consecutive",
    lambda s, d: us(f.dedup_consecutive(big(s, d))),
    BIG_SQL
    + """
    seen AS (SELECT *, lag(aid) OVER (PARTITION BY session ORDER BY us, aid, type) AS before FROM log),
    out AS (SELECT * FROM seen WHERE before IS DISTINCT FROM aid)
    """,
    **EVENT_COLS,
)


def of_targets(log):
    return f.semi(log, f.target_sessions(log), ["session"])


add(
    "join_semi",
    lambda s, d: us(of_targets(big(s, d))),
    BIG_SQL + "out AS (SELECT * FROM log WHERE session IN (SELECT session FROM log WHERE split <> 'train'))",
    **EVENT_COLS,
)
add(
    "join_lookup",
    lambda s, d: f.lookup(
        small(s, d).select("session").distinct(),
        small(s, d).where("type = 'orders'").groupBy("session").agg(F.count(F.lit(1)).alias("orders"), F.max(F.unix_seconds("ts")).alias("last_order")),
        ["session"],
        {"orders": 0, "last_order": -1},
    ),
    SMALL_SQL
    + """
    o AS (SELECT session, count(*) AS orders, max(us // 1000000) AS last_order FROM log WHERE type = 'orders' GROUP BY session),
    out AS (SELECT s.session, coalesce(orders, 0) AS orders, coalesce(last_order, -1) AS last_order FROM (SELECT DISTINCT session FROM log) s LEFT JOIN o USING (session))
    """,
    ints=["session", "orders", "last_order"],
)
add(
    "join_scalar",
    lambda s, d: f.with_scalars(
        big(s, d).groupBy("aid").agg(F.count(F.lit(1)).alias("n")),
        big(s, d).agg(F.count(F.lit(1)).alias("total"), F.count_distinct("aid").alias("items")),
    ),
    BIG_SQL + "out AS (SELECT aid, count(*) AS n, (SELECT count(*) FROM log) AS total, (SELECT count(DISTINCT aid) FROM log) AS items FROM log GROUP BY aid)",
    ints=["aid", "n", "total", "items"],
)


def per_type(log, t):
    return log.where(F.col("type") == t).groupBy("session", "aid").agg(F.count(F.lit(1)).alias(f"pred_{t}"))


add(
    "join_full_outer",
    lambda s, d: sc.merge_full([per_type(big(s, d), t) for t in ("clicks", "carts", "orders")], ["session", "aid"]),
    BIG_SQL + PRED_SQL,
    **PRED_COLS,
)
add(
    "set_intersect",
    lambda s, d: f.common_sessions([per_type(big(s, d), t) for t in ("clicks", "carts", "orders")]),
    BIG_SQL
    + "out AS (SELECT session FROM log WHERE type = 'clicks' INTERSECT SELECT session FROM log WHERE type = 'carts' INTERSECT SELECT session FROM log WHERE type = 'orders')",
    ints=["session"],
)
add(
    "set_union_all",
    lambda s, d: us(f.union_all([small(s, d), big(s, d)])),
    SMALL_SQL + BIG_SQL.replace("log AS", "log2 AS") + "out AS (SELECT * FROM log UNION ALL SELECT * FROM log2)",
    **EVENT_COLS,
)


def with_shifted(log):
    """Own items of the log with two sources made from it; the log is written once."""
    return union_candidates(log, [log.select("session", c.alias("aid")) for c in (F.col("aid") + 1, F.col("aid") * 2)])


add(
    "set_union_distinct",
    lambda s, d: with_shifted(big(s, d)),
    BIG_SQL
    + """
    found AS (SELECT session, aid FROM log UNION ALL SELECT session, aid + 1 FROM log UNION ALL SELECT session, aid * 2 FROM log),
    out AS (SELECT DISTINCT session, aid, split FROM found LEFT JOIN (SELECT DISTINCT session, split FROM log) USING (session)
            WHERE session IN (SELECT session FROM log WHERE split <> 'train'))
    """,
    ints=["session", "aid"],
    texts=["split"],
)

PAIR_WEIGHT_SQL = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY us, aid, type) AS rn FROM log WHERE type = 'clicks'),
met AS (SELECT DISTINCT a.session, a.aid AS aid_x, b.aid AS aid_y FROM numbered a JOIN numbered b
        ON a.session = b.session AND a.rn <> b.rn AND abs(a.us - b.us) < 86400000000),
weights AS (SELECT aid_x, aid_y, count(*) AS weight FROM met GROUP BY ALL HAVING count(*) > 1),
"""
MATRIX_SQL = PAIR_WEIGHT_SQL + """
ranked AS (SELECT aid_x AS aid, aid_y, weight AS wgt, weight / sum(weight) OVER (PARTITION BY aid_x) AS wgt_rel,
           row_number() OVER (PARTITION BY aid_x ORDER BY weight DESC, aid_y) - 1 AS n FROM weights),
matrix AS (SELECT * FROM ranked WHERE n < 20),
"""
_OWN_SQL = "own AS (SELECT DISTINCT session, aid FROM log WHERE split <> 'train'),\n"
MATRIX_FEATURES_SQL = MATRIX_SQL + _OWN_SQL + """mf AS (SELECT session, aid_y AS aid, sum(wgt) AS wgt_m1_sum, avg(wgt) AS wgt_m1_mean, sum(wgt_rel) AS wgt_rel_m1_sum,
       avg(wgt_rel) AS wgt_rel_m1_mean, min(n) AS m1_indmin, count(*) AS m1_num
       FROM own JOIN matrix USING (aid) GROUP BY session, aid_y),
"""
MATRIX_COLS = dict(
    ints=["session", "aid", "m1_indmin", "m1_num"], reals=["wgt_m1_sum", "wgt_m1_mean", "wgt_rel_m1_sum", "wgt_rel_m1_mean"]
)


def _again(sql: str) -> str:
    """The same steps under other names, over carts and orders."""
    for name in ("numbered", "met", "weights", "ranked", "matrix", "mf"):
        sql = re.sub(rf"\b{name}\b", f"{name}2", sql)
    return sql.replace("m1", "m2").replace("type = 'clicks'", "type IN ('carts', 'orders')")


SECOND_MATRIX_SQL = _again(PAIR_WEIGHT_SQL + MATRIX_FEATURES_SQL.removeprefix(PAIR_WEIGHT_SQL).replace(_OWN_SQL, ""))


def matrix(s, d, types=("clicks",)):
    w = pair_weight(pair_flags(small(s, d), 24 * 3600, "SECOND", True, list(types)))
    return covisit_matrix(w, k=20)


def own(s, d):
    return small(s, d).where("split <> 'train'").select("session", "aid").distinct()


add(
    "join_matrix",
    lambda s, d: matrix_features(own(s, d), matrix(s, d), "m1"),
    SMALL_SQL + MATRIX_FEATURES_SQL + "out AS (SELECT * FROM mf)",
    **MATRIX_COLS,
)
add(
    "set_outer_grow",
    lambda s, d: grow_outer(own(s, d), [matrix_features(own(s, d), matrix(s, d), "m1")]),
    SMALL_SQL + MATRIX_FEATURES_SQL + "out AS (SELECT * FROM own FULL JOIN mf USING (session, aid))",
    **MATRIX_COLS,
)
