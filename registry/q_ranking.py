"""Ranking objectives, balanced folds, and learned factors by what their draws and first steps determine."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from registry.core import add
from registry.logs import LABELS_SQL, SMALL_SQL
from registry.q_features import DRAW
from registry.q_lists import FLAGS_SQL, SCORES, labelled, scores, scores_sql
from registry.q_vectors import FEATURES, FOLD_SQL, LEARNED, train_set
from sessionrank.operators import boosting as bo
from sessionrank.operators import dataset as ds

# --- folds ------------------------------------------------------------------------------
DEALT_SQL = f"""
sz AS (SELECT session, count(*) AS n FROM score0 GROUP BY 1),
pl AS (SELECT session, (row_number() OVER (ORDER BY n DESC, {DRAW.format(key='session::VARCHAR', seed=3)}, session) - 1) % 10 AS p FROM sz),
dealt AS (SELECT score0.*, CASE WHEN p < 5 THEN p ELSE 9 - p END AS fold FROM score0 JOIN pl USING (session)),
"""
add(
    "ds_folds_balanced",
    lambda s, d: ds.deal_folds(scores(s, d), 5, 3),
    SCORES + DEALT_SQL + "out AS (SELECT session, aid, fold FROM dealt)",
    ints=["session", "aid", "fold"],
)

# --- ranking objectives -----------------------------------------------------------------
RANK = bo.Settings()
GRADIENTS_SQL = (
    SCORES
    + LABELS_SQL
    + FLAGS_SQL
    + f"""
    placed AS (SELECT session, aid, clicks_gt + carts_gt AS y, row_number() OVER (PARTITION BY session ORDER BY aid) - 1 AS p FROM gt),
    disc AS (SELECT *, CASE WHEN p < {RANK.top} THEN 1 / log2(p + 2) ELSE 0 END AS d, pow(2, y) AS v FROM placed),
    best AS (SELECT session, sum(CASE WHEN q < {RANK.top} THEN (v - 1) / log2(q + 2) ELSE 0 END) AS best
             FROM (SELECT session, v, row_number() OVER (PARTITION BY session ORDER BY y DESC) - 1 AS q FROM disc) GROUP BY 1),
    pair AS (SELECT a.session, a.aid AS i, b.aid AS j, abs((a.v - b.v) * (a.d - b.d)) / best AS w
             FROM disc a JOIN disc b ON a.session = b.session AND a.y > b.y JOIN best ON best.session = a.session),
    each AS (SELECT session, i AS aid, -w / 2 AS g, w / 4 AS h FROM pair UNION ALL SELECT session, j, w / 2, w / 4 FROM pair),
    grads AS (SELECT gt.session, gt.aid, coalesce(sum(g), 0) AS grad, coalesce(sum(h), 0) AS hess FROM gt LEFT JOIN each USING (session, aid) GROUP BY 1, 2),
    """
)


def graded(s, d):
    return labelled(s, d).withColumn("grade", F.col("clicks_gt") + F.col("carts_gt"))


add(
    "ml_lambda_gradients",
    lambda s, d: bo.first_gradients(graded(s, d), "grade"),
    GRADIENTS_SQL + "out AS (SELECT * FROM grads)",
    ints=["session", "aid"],
    reals=["grad", "hess"],
)

PREDS = ["pred_clicks", "pred_carts", "pred_orders"]
_long = " UNION ALL ".join(f"SELECT session, aid, {i} AS f, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM score0" for i, c in enumerate(PREDS))
_shares = ", ".join(str(i / RANK.max_bin) for i in range(1, RANK.max_bin))
add(
    "ml_first_split",
    lambda s, d: bo.first_splits(ds.deal_folds(graded(s, d), 5, 3), PREDS, "grade"),
    GRADIENTS_SQL
    + DEALT_SQL
    + f"""
    wide AS ({_long}),
    lims AS (SELECT DISTINCT f, unnest(quantile_disc(x, [{_shares}])) AS lim FROM wide GROUP BY f),
    folds AS (SELECT DISTINCT fold AS k FROM dealt),
    sums AS (SELECT k, f, feature, lim, sum(CASE WHEN x <= lim THEN grad ELSE 0 END) AS gl, sum(CASE WHEN x <= lim THEN hess ELSE 0 END) AS hl,
                    count(*) FILTER (x <= lim) AS nl, sum(grad) AS g, sum(hess) AS h, count(*) AS n
             FROM wide JOIN grads USING (session, aid) JOIN dealt USING (session, aid) JOIN folds ON dealt.fold <> k JOIN lims USING (f) GROUP BY ALL),
    gained AS (SELECT k, f, feature, lim, round(pow(greatest(abs(gl) - {RANK.l1}, 0), 2) / (hl + {RANK.l2}) + pow(greatest(abs(g - gl) - {RANK.l1}, 0), 2) / (h - hl + {RANK.l2})
                      - pow(greatest(abs(g) - {RANK.l1}, 0), 2) / (h + {RANK.l2}), 10) AS gain FROM sums WHERE nl >= {RANK.min_rows} AND n - nl >= {RANK.min_rows}),
    out AS (SELECT k AS fold, feature, lim AS "limit", gain FROM gained WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY gain DESC, f, lim) = 1)""",
    ints=["fold"],
    reals=["limit", "gain"],
    texts=["feature"],
)


def ranked(s, d):
    data = train_set(s, d)
    _, oof = bo.cross_rank(data, FEATURES, "carts_gt", settings=replace(RANK, rounds=40, patience=5, depth=4))
    known = oof.join(data.select("session", "aid", "fold"), ["session", "aid"])
    return known.select("session", "aid", "fold", F.col("pred").between(-1e9, 1e9).cast("long").alias("valid"))


add("ml_lambdarank", ranked, FOLD_SQL, **LEARNED)
