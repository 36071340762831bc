"""Ranked lists, evaluation, stacking, blending and the training set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from registry.core import add, joined
from registry.logs import BIG_SQL, LABELS_SQL, SMALL_SQL, big, labels, small
from registry.q_features import (
    DRAW,
    HOURLY_REALS,
    HOURLY_SQL,
    HOUR_COUNTS,
    ITEM_COUNTS,
    ITEM_SQL,
    LATEST_SQL as RECENCY_SQL,
    RATES,
    RECENCY_COLS,
    REPEAT_SQL,
    SI_INTS,
    SI_REALS,
    SI_SQL,
    TRANSITION_COLS,
    TRANSITION_SQL,
)
from sessionrank.operators import dataset as ds
from sessionrank.operators import evaluate as ev
from sessionrank.operators import items as it
from sessionrank.operators import lists as ls
from sessionrank.operators import session_items as si
from sessionrank.operators import sessions as se
from sessionrank.operators import stacking as st
from sessionrank.sources.labels import wide_ground_truth
from sessionrank.sources.scores import merge_full

# --- stand-in models: three scores from the session's own history and the item's popularity
def scores(s, d, which: int = 0):
    """Model scores of the sessions to predict for; ``which`` varies the model."""
    log = small(s, d)
    own = log.where("split <> 'train'").groupBy("session", "aid").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_seconds("ts") % 1000).alias("t"))
    pop = log.groupBy("aid").agg(F.count_if(F.col("type") == "orders").alias("o"), F.count_if(F.col("type") == "carts").alias("k"))
    x = own.join(pop, "aid")
    return x.select(
        "session",
        "aid",
        (F.col("n") * (which + 1) + F.col("k") % 7).cast("double").alias("pred_clicks"),
        ((F.col("k") * 3 + F.col("t") * which) % 101).cast("double").alias("pred_carts"),
        ((F.col("o") * 5 + F.col("t")) % (50 + which)).cast("double").alias("pred_orders"),
    )


def scores_sql(which: int = 0) -> str:
    return f"""
    own{which} AS (SELECT session, aid, count(*) AS n, max(us // 1000000 % 1000) AS t FROM log WHERE split <> 'train' GROUP BY session, aid),
    pop{which} AS (SELECT aid, count(*) FILTER (type = 'orders') AS o, count(*) FILTER (type = 'carts') AS k FROM log GROUP BY aid),
    score{which} AS (SELECT session, aid, n * {which + 1} + k % 7 AS pred_clicks, (k * 3 + t * {which}) % 101 AS pred_carts, (o * 5 + t) % (50 + {which}) AS pred_orders
                     FROM own{which} JOIN pop{which} USING (aid)),
    """


def list_sql(which: int, k: int) -> str:
    """Ranked lists per action, as arrays."""
    parts = ", ".join(
        f"(SELECT list(aid ORDER BY rn) FROM (SELECT aid, row_number() OVER (ORDER BY pred_{t} DESC, aid) AS rn FROM score{which} x WHERE x.session = q.session) WHERE rn <= {k}) AS {t[:-1]}_pred"
        for t in ("clicks", "carts", "orders")
    )
    return f"lists{which} AS (SELECT session, {parts} FROM (SELECT DISTINCT session FROM score{which}) q),"


def pred_lists(s, d, which: int = 0, k: int = 20):
    x = scores(s, d, which)
    return ls.prediction_lists({t: (x, f"pred_{t}s") for t in ("click", "cart", "order")}, k)


SCORES = SMALL_SQL + scores_sql()
add(
    "topk_session",
    lambda s, d: ls.topk(scores(s, d), "pred_carts", 5),
    SCORES + "out AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pred_carts DESC, aid) AS rn FROM score0 QUALIFY rn <= 5)",
    ints=["session", "aid", "rn"],
    reals=["pred_carts"],
)
add(
    "topk_list",
    lambda s, d: ls.topk_lists(scores(s, d), "pred_orders", 20).select("session", joined("aids").alias("aids"), F.array_join(F.transform("scores", lambda x: x.cast("long").cast("string")), " ").alias("scores")),
    SCORES
    + """t AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pred_orders DESC, aid) AS rn FROM score0 QUALIFY rn <= 20),
    out AS (SELECT session, array_to_string(list(aid ORDER BY rn), ' ') AS aids, array_to_string(list(pred_orders ORDER BY rn), ' ') AS scores FROM t GROUP BY session)""",
    ints=["session"],
    texts=["aids", "scores"],
)


def pad(s, d, dedupe):
    short = ls.topk_lists(scores(s, d), "pred_carts", 9)
    return ls.pad_lists(short, it.popular(it.item_features(small(s, d)), "carts"), 20, dedupe).select("session", joined("aids").alias("aids"))


POPULAR_SQL = "top AS (SELECT aid, row_number() OVER (ORDER BY count(DISTINCT session) DESC, aid) AS rn FROM log WHERE type = 'carts' GROUP BY aid ORDER BY rn LIMIT 20),"
SHORT_SQL = "short AS (SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY pred_carts DESC, aid) AS rn FROM score0 QUALIFY rn <= 9), len AS (SELECT session, count(*) AS n FROM short GROUP BY session),"
add(
    "join_pad",
    lambda s, d: pad(s, d, False),
    SCORES
    + POPULAR_SQL
    + SHORT_SQL
    + """
    filled AS (SELECT session, aid, rn FROM short UNION ALL SELECT session, aid, 100 + rn FROM len, top WHERE rn <= 20 - n),
    out AS (SELECT session, array_to_string(list(aid ORDER BY rn), ' ') AS aids FROM filled GROUP BY session)""",
    ints=["session"],
    texts=["aids"],
)
add(
    "bl_pad",
    lambda s, d: pad(s, d, True),
    SCORES
    + POPULAR_SQL
    + SHORT_SQL
    + """
    fresh AS (SELECT session, n, top.aid, row_number() OVER (PARTITION BY session ORDER BY top.rn) AS rn FROM len, top
              WHERE NOT EXISTS (SELECT 1 FROM short x WHERE x.session = len.session AND x.aid = top.aid)),
    filled AS (SELECT session, aid, rn FROM short UNION ALL SELECT session, aid, 100 + rn FROM fresh WHERE rn <= 20 - n),
    out AS (SELECT session, array_to_string(list(aid ORDER BY rn), ' ') AS aids FROM filled GROUP BY session)""",
    ints=["session"],
    texts=["aids"],
)


def submission(s, d, which=0, k=50):
    x = scores(s, d, which)
    clicks = ls.to_submission(ls.topk_lists(x, "pred_clicks", k), ["clicks"])
    return clicks.unionByName(ls.to_submission(ls.topk_lists(x, "pred_carts", k), ["carts", "orders"]))


def submission_sql(which=0, k=50) -> str:
    def one(t, score):
        return f"SELECT session || '_{t}' AS session_type, aid, row_number() OVER (PARTITION BY session ORDER BY {score} DESC, aid) AS rn FROM score{which} QUALIFY rn <= {k}"

    return f"""
    sub{which} AS (({one('clicks', 'pred_clicks')}) UNION ALL ({one('carts', 'pred_carts')}) UNION ALL ({one('orders', 'pred_carts')})),
    """


add(
    "sub_format",
    lambda s, d: submission(s, d),
    SCORES + submission_sql() + "out AS (SELECT session_type, array_to_string(list(aid ORDER BY rn), ' ') AS labels FROM sub0 GROUP BY session_type)",
    texts=["session_type", "labels"],
)


def blended(s, d):
    mixed = st.blend({"a": submission(s, d, 0), "b": submission(s, d, 1)}, {"a": 2, "b": 1})
    return mixed.select("session_type", joined("aids").alias("labels"))


add(
    "bl_reciprocal",
    blended,
    SCORES
    + scores_sql(1)
    + submission_sql(0)
    + submission_sql(1)
    + """
    mix AS (SELECT session_type, aid, (coalesce(1 / a.rn, 1 / 50) * 2 + coalesce(1 / b.rn, 1 / 50)) / 2 AS r
            FROM sub0 a FULL JOIN sub1 b USING (session_type, aid)),
    best AS (SELECT *, row_number() OVER (PARTITION BY session_type ORDER BY round(r, 12) DESC, aid) AS rn FROM mix QUALIFY rn <= 20),
    out AS (SELECT session_type, array_to_string(list(aid ORDER BY rn), ' ') AS labels FROM best GROUP BY session_type)""",
    texts=["session_type", "labels"],
)

# --- stacking ---------------------------------------------------------------------------
RANKED = ["pred_clicks", "clicks_rank", "pred_carts", "carts_rank", "pred_orders", "orders_rank"]


def ranked_sql(which: int, model: str, k: int) -> str:
    ranks = ", ".join(f"dense_rank() OVER (PARTITION BY session ORDER BY pred_{t} DESC) AS {t}_rank" for t in ("clicks", "carts", "orders"))
    return f"{model} AS (SELECT *, {ranks} FROM score{which} QUALIFY clicks_rank <= {k} OR carts_rank <= {k} OR orders_rank <= {k}),"


add(
    "st_rank_model",
    lambda s, d: st.rank_scores(scores(s, d), "m0", 50),
    SCORES + ranked_sql(0, "m0", 50) + "out AS (SELECT *, 'm0' AS model FROM m0)",
    ints=["session", "aid", "clicks_rank", "carts_rank", "orders_rank"],
    reals=["pred_clicks", "pred_carts", "pred_orders"],
    texts=["model"],
)


add(
    "st_rank_rows",
    lambda s, d: st.rank_scores(scores(s, d).drop("pred_carts", "pred_orders"), "all", 50, rank="row_number"),
    SCORES + "out AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pred_clicks DESC, aid) AS clicks_rank, 'all' AS model FROM score0 QUALIFY clicks_rank <= 50)",
    ints=["session", "aid", "clicks_rank"],
    reals=["pred_clicks"],
    texts=["model"],
)


def unpacked_sql(which: int, model: str, size: int, k: int) -> str:
    """Lists of ``size`` brought together; a pair stays with all its scores if any list has it among its first ``k``."""
    parts = {t: f"(SELECT session, aid, pred_{t}, row_number() OVER (PARTITION BY session ORDER BY pred_{t} DESC, aid) AS {t}_rank FROM score{which} QUALIFY {t}_rank <= {size})" for t in ("clicks", "carts", "orders")}
    return f"""{model} AS (SELECT * FROM {parts['clicks']} FULL JOIN {parts['carts']} USING (session, aid) FULL JOIN {parts['orders']} USING (session, aid)
                           WHERE clicks_rank <= {k} OR carts_rank <= {k} OR orders_rank <= {k}),"""


add(
    "st_unpack_lists",
    lambda s, d: st.unpack_lists(pred_lists(s, d, 0, 20), "m1", 8),
    SCORES + unpacked_sql(0, "m1", 20, 8) + "out AS (SELECT *, 'm1' AS model FROM m1)",
    ints=["session", "aid", "clicks_rank", "carts_rank", "orders_rank"],
    reals=["pred_clicks", "pred_carts", "pred_orders"],
    texts=["model"],
)


def submission_rows(s, d):
    sub = submission(s, d, 0, 50)
    with_scores = sub.withColumn("scores", F.transform(F.split("labels", " "), lambda x, i: (F.lit(1.0) / (i + 1))))
    return st.unpack_lists(with_scores, "m1", 50)


add(
    "st_unpack_submission",
    submission_rows,
    SCORES
    + submission_sql(0, 50)
    + """
    rows AS (SELECT split_part(session_type, '_', 1)::BIGINT AS session, split_part(session_type, '_', 2) AS t, aid, rn FROM sub0),
    out AS (SELECT session, aid, max(1 / rn) FILTER (t = 'clicks') AS pred_clicks, max(rn) FILTER (t = 'clicks') AS clicks_rank,
            max(1 / rn) FILTER (t = 'carts') AS pred_carts, max(rn) FILTER (t = 'carts') AS carts_rank,
            max(1 / rn) FILTER (t = 'orders') AS pred_orders, max(rn) FILTER (t = 'orders') AS orders_rank FROM rows GROUP BY session, aid)""",
    ints=["session", "aid", "clicks_rank", "carts_rank", "orders_rank"],
    reals=["pred_clicks", "pred_carts", "pred_orders"],
)


def stacked(s, d):
    rows = [
        st.rank_scores(scores(s, d, 0), "m0", 50),
        st.unpack_lists(pred_lists(s, d, 1, 50), "m1", 50),
        st.rank_scores(scores(s, d, 2).drop("pred_clicks"), "m2", 50),
    ]
    return st.stack(rows, ["m0", "m1", "m2"])


def _model_cols(m, kinds):
    return ", ".join(f"{m}.pred_{t} AS {m}_pred_{t}, {m}.{t}_rank AS {m}_{t}_rank" for t in kinds)


_three = ("clicks", "carts", "orders")
add(
    "st_union_pivot",
    stacked,
    SCORES
    + scores_sql(1)
    + scores_sql(2)
    + ranked_sql(0, "m0", 50)
    + unpacked_sql(1, "m1", 50, 50)
    + """m2 AS (SELECT session, aid, pred_carts, pred_orders, dense_rank() OVER (PARTITION BY session ORDER BY pred_carts DESC) AS carts_rank,
         dense_rank() OVER (PARTITION BY session ORDER BY pred_orders DESC) AS orders_rank FROM score2 QUALIFY carts_rank <= 50 OR orders_rank <= 50),
    base AS (SELECT session, aid FROM m0 UNION SELECT session, aid FROM m1 UNION SELECT session, aid FROM m2),
    """
    + f"out AS (SELECT base.session, base.aid, {_model_cols('m0', _three)}, {_model_cols('m1', _three)}, {_model_cols('m2', _three[1:])} FROM base LEFT JOIN m0 USING (session, aid) LEFT JOIN m1 USING (session, aid) LEFT JOIN m2 USING (session, aid))",
    ints=["session", "aid", *[f"{m}_{t}_rank" for m in ("m0", "m1") for t in _three], "m2_carts_rank", "m2_orders_rank"],
    reals=[*[f"{m}_pred_{t}" for m in ("m0", "m1") for t in _three], "m2_pred_carts", "m2_pred_orders"],
)


def one_type(s, d, which, t, k):
    x = scores(s, d, which)
    return ls.topk(x, f"pred_{t}", k).select("session", "aid", f"pred_{t}")


add(
    "st_convert",
    lambda s, d: merge_full([one_type(s, d, 0, "carts", 50), one_type(s, d, 1, "orders", 50)], ["session", "aid"]),
    SCORES
    + scores_sql(1)
    + """
    a AS (SELECT session, aid, pred_carts FROM score0 QUALIFY row_number() OVER (PARTITION BY session ORDER BY pred_carts DESC, aid) <= 50),
    b AS (SELECT session, aid, pred_orders FROM score1 QUALIFY row_number() OVER (PARTITION BY session ORDER BY pred_orders DESC, aid) <= 50),
    out AS (SELECT * FROM a FULL JOIN b USING (session, aid))""",
    ints=["session", "aid"],
    reals=["pred_carts", "pred_orders"],
)

# --- evaluation -------------------------------------------------------------------------
LISTED = SCORES + LABELS_SQL + list_sql(0, 20)
HITS_SQL = """
hits AS (SELECT session, CASE WHEN list_contains(click_pred, click_label) THEN 1 ELSE 0 END AS ch, CASE WHEN click_label IS NOT NULL THEN 1 ELSE 0 END AS cl,
         coalesce(len(list_intersect(cart_pred, cart_label)), 0) AS kh, CASE WHEN cart_label IS NULL THEN 0 ELSE least(len(cart_label), 20) END AS kl,
         coalesce(len(list_intersect(order_pred, order_label)), 0) AS oh, CASE WHEN order_label IS NULL THEN 0 ELSE least(len(order_label), 20) END AS ol
         FROM lists0 LEFT JOIN truth USING (session)),
"""
_sums = "sum(ch) AS click_hits, sum(cl) AS click_labels, sum(kh) AS cart_hits, sum(kl) AS cart_labels, sum(oh) AS order_hits, sum(ol) AS order_labels"
_recall = "sum(ch) / nullif(sum(cl), 0) AS click_recall, sum(kh) / nullif(sum(kl), 0) AS cart_recall, sum(oh) / nullif(sum(ol), 0) AS order_recall, 0.1 * sum(ch) / nullif(sum(cl), 0) + 0.3 * sum(kh) / nullif(sum(kl), 0) + 0.6 * sum(oh) / nullif(sum(ol), 0) AS recall"
RECALL_COLS = dict(
    ints=[f"{n}_{x}" for n in ("click", "cart", "order") for x in ("hits", "labels")], reals=["click_recall", "cart_recall", "order_recall", "recall"]
)
add(
    "ev_recall",
    lambda s, d: ev.recall_lists(pred_lists(s, d), wide_ground_truth(labels(s, d))),
    LISTED + HITS_SQL + f"out AS (SELECT {_sums}, {_recall} FROM hits)",
    **RECALL_COLS,
)
add(
    "ev_shards",
    lambda s, d: ev.shard_recall(pred_lists(s, d), wide_ground_truth(labels(s, d)), 20, [0, 5, 10]),
    LISTED
    + HITS_SQL
    + f"kept AS (SELECT * FROM hits WHERE session % 20 IN (0, 5, 10)), out AS (SELECT session % 20 AS shard, {_sums}, {_recall} FROM kept GROUP BY session % 20 UNION ALL SELECT -1, {_sums}, {_recall} FROM kept)",
    ints=["shard", *RECALL_COLS["ints"]],
    reals=RECALL_COLS["reals"],
)
add(
    "ev_recall_long",
    lambda s, d: ev.recall_long(scores(s, d), labels(s, d), "pred_carts", "carts"),
    SCORES
    + LABELS_SQL
    + """
    best AS (SELECT session, aid FROM score0 QUALIFY row_number() OVER (PARTITION BY session ORDER BY pred_carts DESC, aid) <= 20),
    known AS (SELECT * FROM labels WHERE type = 'carts' AND session IN (SELECT session FROM best)),
    x AS (SELECT (SELECT count(*) FROM best JOIN (SELECT session, unnest(ground_truth) AS aid FROM known) USING (session, aid)) AS hits,
          (SELECT sum(least(len(ground_truth), 20)) FROM known) AS labels),
    out AS (SELECT *, hits / labels AS recall FROM x)""",
    ints=["hits", "labels"],
    reals=["recall"],
)
add(
    "ev_candidates",
    lambda s, d: ev.candidate_recall(scores(s, d), labels(s, d)),
    SCORES
    + LABELS_SQL
    + """
    h AS (SELECT session, type, least(count(*), 20) AS n FROM (SELECT session, type, unnest(ground_truth) AS aid FROM labels) JOIN score0 USING (session, aid) GROUP BY ALL),
    k AS (SELECT type, sum(least(len(ground_truth), 20)) AS labels FROM labels GROUP BY type),
    out AS (SELECT type, labels, coalesce(sum(n), 0) AS hits, coalesce(sum(n), 0) / labels AS recall FROM k LEFT JOIN h USING (type) GROUP BY type, labels)""",
    ints=["labels", "hits"],
    reals=["recall"],
    texts=["type"],
)


def labelled(s, d):
    return ds.add_label_flags(scores(s, d), labels(s, d))


FLAGS_SQL = """
flags AS (SELECT session, aid, max(CASE WHEN type = 'clicks' THEN 1 ELSE 0 END) AS clicks_gt, max(CASE WHEN type = 'carts' THEN 1 ELSE 0 END) AS carts_gt,
          max(CASE WHEN type = 'orders' THEN 1 ELSE 0 END) AS orders_gt FROM (SELECT session, type, unnest(ground_truth) AS aid FROM labels) GROUP BY ALL),
gt AS (SELECT s.*, coalesce(clicks_gt, 0) AS clicks_gt, coalesce(carts_gt, 0) AS carts_gt, coalesce(orders_gt, 0) AS orders_gt FROM score0 s LEFT JOIN flags USING (session, aid)),
"""
GT = ["clicks_gt", "carts_gt", "orders_gt"]
add(
    "ev_auc",
    lambda s, d: ev.auc_table(labelled(s, d), "pred_carts", "carts_gt"),
    SCORES
    + LABELS_SQL
    + FLAGS_SQL
    + """
    out AS (SELECT avg(CASE WHEN p.pred_carts > n.pred_carts THEN 1.0 WHEN p.pred_carts = n.pred_carts THEN 0.5 ELSE 0 END) AS auc
            FROM (SELECT pred_carts FROM gt WHERE carts_gt = 1) p, (SELECT pred_carts FROM gt WHERE carts_gt = 0) n)""",
    reals=["auc"],
)

# --- training set -----------------------------------------------------------------------
add(
    "ds_label_join",
    labelled,
    SCORES + LABELS_SQL + FLAGS_SQL + "out AS (SELECT * FROM gt)",
    ints=["session", "aid", *GT],
)
add(
    "grp_max_label",
    lambda s, d: reduce(lambda a, g: ds.session_has_label(a, g), GT, labelled(s, d)),
    SCORES
    + LABELS_SQL
    + FLAGS_SQL
    + f"out AS (SELECT *, {', '.join(f'max({g}) OVER (PARTITION BY session) AS {g[:-3]}_session' for g in GT)} FROM gt)",
    ints=["session", "aid", *GT, *[f"{g[:-3]}_session" for g in GT]],
)
add(
    "ds_positive_sessions",
    lambda s, d: ds.positive_sessions(labelled(s, d), "clicks_gt"),
    SCORES + LABELS_SQL + FLAGS_SQL + "out AS (SELECT * FROM gt WHERE session IN (SELECT session FROM gt WHERE clicks_gt = 1))",
    ints=["session", "aid", *GT],
)


def aged(s, d):
    log = small(s, d)
    base = scores(s, d).select("session", "aid").join(ds.session_clock_keys(log), "session", "left")
    items = it.item_features(log).select("aid", "action_min_ts", "action_max_ts")
    return ds.add_labels(ds.add_item_age(base.join(items, "aid", "left")), wide_ground_truth(labels(s, d)))


AGE_SQL = """
ends AS (SELECT session, (max(us) + 1000000) // 60000000 * 60000000 AS minute_us, (max(us) + 1000000) // 3600000000 * 3600 AS ts_hour FROM log GROUP BY session),
life AS (SELECT aid, min(us) AS min_us, max(us) AS max_us FROM log GROUP BY aid),
"""


def cut(x):
    return f"CASE WHEN {x} < 0 THEN -(-({x}) // 1000000) ELSE ({x}) // 1000000 END"


LABEL_COLS_SQL = """coalesce(CASE WHEN aid = click_label THEN 1 ELSE 0 END, 0) AS click_label,
    CASE WHEN list_contains(cart_label, aid) THEN 1 ELSE 0 END AS cart_label, CASE WHEN list_contains(order_label, aid) THEN 1 ELSE 0 END AS order_label"""
AGES = ["seconds_from_last_aid_action", "seconds_from_first_aid_action"]
add(
    "ds_labels",
    aged,
    SCORES
    + LABELS_SQL
    + AGE_SQL
    + f"""out AS (SELECT session, aid, {cut('minute_us - max_us')} AS {AGES[0]}, {cut('minute_us - min_us')} AS {AGES[1]}, {LABEL_COLS_SQL}
          FROM score0 LEFT JOIN ends USING (session) LEFT JOIN life USING (aid) LEFT JOIN truth USING (session))""",
    ints=["session", "aid", *AGES, "click_label", "cart_label", "order_label"],
)
add(
    "ds_folds",
    lambda s, d: ds.add_fold(scores(s, d), 5, 3),
    SCORES + f"out AS (SELECT session, aid, {DRAW.format(key='session::VARCHAR', seed=3)} % 5 AS fold FROM score0)",
    ints=["session", "aid", "fold"],
)
PAIR_DRAW = "session || '|' || aid"
add(
    "ds_neg_sample",
    lambda s, d: ds.sample_negatives(labelled(s, d), GT, 20, 5),
    SCORES
    + LABELS_SQL
    + FLAGS_SQL
    + f"""
    pos AS (SELECT session, aid, 1 AS hit FROM gt WHERE greatest(clicks_gt, carts_gt, orders_gt) = 1),
    neg AS (SELECT session, aid, 0 AS hit FROM gt WHERE greatest(clicks_gt, carts_gt, orders_gt) = 0
            QUALIFY row_number() OVER (ORDER BY {DRAW.format(key=PAIR_DRAW, seed=5)}, session, aid) <= 20 * (SELECT count(*) FROM pos)),
    out AS (SELECT * FROM pos UNION ALL SELECT * FROM neg)""",
    ints=["session", "aid"],
)
add(
    "ds_neg_keep",
    lambda s, d: ds.keep_negatives(labelled(s, d), "carts_gt", 5, 2),
    SCORES + LABELS_SQL + FLAGS_SQL + f"out AS (SELECT * FROM gt WHERE carts_gt = 1 OR {DRAW.format(key=PAIR_DRAW, seed=2)} % 5 = 0)",
    ints=["session", "aid", "carts_gt"],
)


def encoded(s, d):
    log = big(s, d)
    per = log.groupBy("session", "aid", "type").agg(F.stddev_samp(F.unix_seconds("ts")).alias("dev"), F.count(F.lit(1)).alias("n"))
    return ds.encode(per, ["type"], ["dev", "n"])


add(
    "ds_encode",
    encoded,
    BIG_SQL
    + """g AS (SELECT session, aid, type, stddev_samp(us // 1000000) AS dev, count(*) AS n FROM log GROUP BY ALL),
    out AS (SELECT session, aid, CASE type WHEN 'carts' THEN 0 WHEN 'clicks' THEN 1 ELSE 2 END AS type, coalesce(dev, -1) AS dev, n FROM g)""",
    ints=["session", "aid", "type", "n"],
    reals=["dev"],
)


def assembled(s, d):
    log = small(s, d)
    pairs = log.where("split <> 'train'").select("session", "aid", "split").distinct().join(ds.session_clock_keys(log), "session", "left")
    tables = [
        (se.session_features(log), ["session"]),
        (it.item_repeat_frame(log), ["aid"]),
        (it.item_features(log).drop("action_min_ts", "action_max_ts"), ["aid"]),
        (it.item_hourly(log), ["aid", "ts_hour"]),
        (si.session_item_features(log), ["session", "aid"]),
        (si.session_item_recency(log), ["session", "aid"]),
    ]
    return ds.assemble(pairs, tables)


SESSION_SQL = """
sessfeat AS (SELECT session, (max(us) - min(us)) // 1000000 AS search_seconds, count(*) AS session_size FROM log GROUP BY session),
"""
ASSEMBLE_SQL = SESSION_SQL + REPEAT_SQL + TRANSITION_SQL + ITEM_SQL + HOURLY_SQL + SI_SQL + RECENCY_SQL + AGE_SQL
add(
    "join_assemble",
    assembled,
    SMALL_SQL
    + ASSEMBLE_SQL
    + """
    pairs AS (SELECT DISTINCT session, aid, split, ts_hour FROM log JOIN ends USING (session) WHERE split <> 'train'),
    out AS (SELECT * FROM pairs LEFT JOIN sessfeat USING (session) LEFT JOIN rep USING (aid) LEFT JOIN trans USING (aid) LEFT JOIN item USING (aid)
            LEFT JOIN hourly USING (aid, ts_hour) LEFT JOIN si USING (session, aid) LEFT JOIN recency USING (session, aid))""",
    ints=[
        *SI_INTS,
        "search_seconds",
        "session_size",
        "min_repeat_count",
        "max_repeat_count",
        *ITEM_COUNTS,
        *HOUR_COUNTS[1:],
        *RECENCY_COLS,
    ],
    reals=["avg_repeat_count", "stddev_repeat_count", *TRANSITION_COLS, *RATES, *HOURLY_REALS, *SI_REALS],
    texts=["split"],
)
