"""The composed flows: candidate union, both dataset variants, sampling, training frame, submission."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import add
from registry.logs import LABELS_SQL, SESSION_VECTORS_SQL, SMALL_SQL, VECTORS_SQL, item_vectors, labels, session_vectors, small
from registry.q_covisit import (
    COUNTS_SQL,
    CVR_SQL,
    HOUR_US,
    LATEST_SQL,
    NORM_SQL,
    MATRIX_COLS,
    best_sql,
    counts_sql,
    fills_sql,
    bigram_sql,
    features_sql,
    place_pairs,
    time_pairs,
    weighted_sql,
)
from registry.q_features import (
    A2S_SQL,
    CLOCK_SQL,
    CVR_PAIR_REALS,
    CVR_PAIR_SQL,
    HOURLY_REALS,
    HOUR_COUNTS,
    ITEM_COUNTS,
    RATES,
    RECENCY_COLS,
    SI_INTS,
    SI_REALS,
    SUBSESSION_SQL,
    TRANSITION_COLS,
    per_type,
)
from registry.q_lists import AGES, ASSEMBLE_SQL, DRAW, FLAGS_SQL, LABEL_COLS_SQL, cut, submission, submission_sql, scores_sql
from registry.q_sources import MATRIX_FEATURES_SQL, SECOND_MATRIX_SQL, matrix
from registry.q_vectors import FEATURES as MODEL_FEATURES, item_neighbours, train_set
from sessionrank.operators import candidates as cd
from sessionrank.operators import covisit as cv
from sessionrank.operators import items as it
from sessionrank.operators import learn as ml
from sessionrank.operators import neighbours as nb
from sessionrank.plans import ranking as R
from sessionrank.plans import training_set as T
from sessionrank.schema import ACTIONS
from sessionrank.sources.labels import wide_ground_truth

WEIGHTS = "weights AS (SELECT aid_x, aid_y, count(*) AS weight FROM met GROUP BY ALL HAVING count(*) > 1),"


def _counted(name, pairs_sql, counts, stddev, totals):
    sql, cols = features_sql(name, counts, 1000, stddev, not totals, totals)
    return pairs_sql + COUNTS_SQL + CVR_SQL + best_sql(counts, 300) + LATEST_SQL + sql, cols


def _weighted(name, types):
    sql, cols = weighted_sql(name, 1000)
    return time_pairs(HOUR_US, types, False) + WEIGHTS + sql, cols


def _bigram(name):
    sql, cols = bigram_sql(name, 500, 1000)
    return NORM_SQL + LATEST_SQL + sql, cols


# SQL of every feature table on the log, and its columns
FEATURES = {
    "click2click_covisit_1hour": _weighted("click2click_covisit_1hour", "'clicks'"),
    "cart_order2cart_order_covisit_1hour": _weighted("cart_order2cart_order_covisit_1hour", "'carts', 'orders'"),
    "covisit_items_1hour": _counted("covisit_items_1hour", time_pairs(2 * HOUR_US), cv.COUNTS, False, False),
    "covisit_items_1days": _counted("covisit_items_1days", time_pairs(25 * HOUR_US), cv.COUNTS, False, False),
    "covisit_items_window_size5_v3": _counted("covisit_items_window_size5_v3", place_pairs("row_number"), cv.COUNTS, True, False),
    "covisit_items_window_size5_v4": _counted("covisit_items_window_size5_v4", place_pairs("dense_rank", 30), cv.ALL_COUNTS, True, True),
    "covisit_bigram_v2": _bigram("covisit_bigram_v2"),
}


def nested(name: str, alias: str) -> str:
    return f"{alias} AS (WITH {FEATURES[name][0].strip()} SELECT * FROM out),"


def candidate_rows(name: str) -> str:
    ranks = [c for c in FEATURES[name][1]["ints"] if c.startswith("rn_")]
    return f"SELECT session, aid FROM f_{name} WHERE " + " OR ".join(f"{r} <= {T.C.CANDIDATE_LIMITS[name]}" for r in ranks)


SIMILAR_SQL = """
ksim AS (SELECT q.aid AS start, i.aid, round(list_dot_product(q.vector, i.vector), 12) AS similarity FROM vec q, vec i),
knear AS (SELECT * FROM ksim QUALIFY row_number() OVER (PARTITION BY start ORDER BY similarity DESC, aid) <= 50),
finals AS (SELECT session, aid AS start FROM log QUALIFY row_number() OVER (PARTITION BY session, type ORDER BY us DESC, aid DESC) = 1),
alike AS (SELECT DISTINCT session, knear.aid FROM finals JOIN knear USING (start) WHERE knear.aid <> start AND similarity >= 0.85),
usim AS (SELECT session, aid, round(list_dot_product(list_transform(session_vector, lambda x: x / sqrt(list_dot_product(session_vector, session_vector))), vector), 12) AS similarity FROM svec, vec),
unear AS (SELECT session, aid FROM usim QUALIFY row_number() OVER (PARTITION BY session ORDER BY similarity DESC, aid) <= 50),
"""


def user_item_sql(variant: str) -> str:
    rows = [candidate_rows(n) for n in T.CANDIDATE_SOURCES] + ["SELECT session, aid FROM log"]
    if variant == "067":
        rows += ["SELECT session, aid FROM unear", "SELECT session, aid FROM alike"]
    return f"""
    found AS ({' UNION ALL '.join(rows)}),
    user_item AS (SELECT DISTINCT session, aid, split FROM found LEFT JOIN (SELECT DISTINCT session, split FROM log) USING (session)
                  WHERE session IN (SELECT session FROM log WHERE split <> 'train')),
    """


def base_sql(variant: str) -> str:
    names = dict.fromkeys((*T.CANDIDATE_SOURCES, *T.FEATURE_TABLES[variant]))
    return SMALL_SQL + VECTORS_SQL + SESSION_VECTORS_SQL + SIMILAR_SQL + "".join(nested(n, f"f_{n}") for n in names) + user_item_sql(variant)


def extra_sources(s, d, variant):
    if variant != "067":
        return {}
    return {
        "neighbours": nb.knn(session_vectors(s, d), item_vectors(s, d), 50, key="session", query_vec="session_vector"),
        "similar": cd.neighbour_candidates(small(s, d), item_neighbours(s, d), 0.85),
    }


def user_item(s, d, variant):
    log = small(s, d)
    features = {n: T.C.TABLES[n](log) for n in T.CANDIDATE_SOURCES}
    return T.user_item(log, features, variant, **extra_sources(s, d, variant))


for _v in ("067", "069"):
    add(
        f"user_item_{_v}",
        lambda s, d, v=_v: user_item(s, d, v),
        base_sql(_v) + "out AS (SELECT * FROM user_item)",
        ints=["session", "aid"],
        texts=["split"],
    )


def built(s, d, variant):
    vectors = T.Vectors({"w2v": item_vectors(s, d)}, session_vectors(s, d), item_vectors(s, d).withColumnRenamed("vector", "aid_vector"))
    return T.build(
        small(s, d),
        wide_ground_truth(labels(s, d)),
        vectors,
        variant,
        **extra_sources(s, d, variant),
    )


VEC_HEADS = {"last_cart_w2v": "carts", "last_order_w2v": "orders", "w2v": None}
VEC_REALS = [f"{p}{h}_{k}" for h in VEC_HEADS for k in ("cosine_similarity", "l2_distance") for p in ("", "diff_avg_", "diff_min_", "diff_max_")]
BPR_REALS = [f"{p}bpr_distance" for p in ("", "diff_avg_", "diff_min_", "diff_max_")]


def vector_sql() -> str:
    out = ""
    for head, kind in VEC_HEADS.items():
        where = f"WHERE type = '{kind}'" if kind else ""
        both = [f"{head}_cosine_similarity", f"{head}_l2_distance"]
        stats = ", ".join(f"{x} - {fn}({x}) OVER (PARTITION BY session) AS diff_{fn}_{x}" for x in both for fn in ("avg", "min", "max"))
        out += f"""
        l_{head} AS (SELECT session, aid AS last_aid FROM log {where} QUALIFY row_number() OVER (PARTITION BY session ORDER BY us DESC, aid DESC) = 1),
        d_{head} AS (SELECT p.session, p.aid, list_dot_product(v.vector, u.vector) AS {both[0]}, list_distance(v.vector, u.vector) AS {both[1]}
                     FROM user_item p LEFT JOIN l_{head} USING (session) LEFT JOIN vec v ON v.aid = p.aid LEFT JOIN vec u ON u.aid = last_aid),
        v_{head} AS (SELECT *, {stats} FROM d_{head}),
        """
    return out + """
    d_bpr AS (SELECT p.session, p.aid, list_dot_product(session_vector, vector) AS bpr_distance FROM user_item p LEFT JOIN svec USING (session) LEFT JOIN vec USING (aid)),
    v_bpr AS (SELECT *, bpr_distance - avg(bpr_distance) OVER w AS diff_avg_bpr_distance, bpr_distance - min(bpr_distance) OVER w AS diff_min_bpr_distance,
              bpr_distance - max(bpr_distance) OVER w AS diff_max_bpr_distance FROM d_bpr WINDOW w AS (PARTITION BY session)),
    """


def dataset_sql(variant: str):
    tables = T.FEATURE_TABLES[variant]
    joins = " ".join(f"LEFT JOIN f_{n} USING (session, aid)" for n in tables)
    vec = " ".join(f"LEFT JOIN v_{h} USING (session, aid)" for h in (*VEC_HEADS, "bpr"))
    more = CVR_PAIR_SQL if variant == "069" else ""
    cvr = "LEFT JOIN si_cvr USING (session, aid)" if variant == "069" else ""
    counts = f"sess3 AS (SELECT session, {per_type('count(DISTINCT aid)', '{one}_aid_session_count')} FROM log GROUP BY session),"
    sql = base_sql(variant) + LABELS_SQL + ASSEMBLE_SQL + more + counts + vector_sql() + f"""
    data AS (SELECT * EXCLUDE (click_label, cart_label, order_label), {cut('minute_us - item.max_us')} AS {AGES[0]}, {cut('minute_us - item.min_us')} AS {AGES[1]}, {LABEL_COLS_SQL}
            FROM user_item LEFT JOIN ends USING (session) LEFT JOIN sessfeat USING (session) LEFT JOIN sess3 USING (session) LEFT JOIN truth USING (session)
            LEFT JOIN rep USING (aid) LEFT JOIN trans USING (aid) LEFT JOIN item USING (aid) LEFT JOIN hourly USING (aid, ts_hour)
            LEFT JOIN recency USING (session, aid) LEFT JOIN si USING (session, aid) {cvr} {joins} {vec}),
    """
    ints = [*SI_INTS, "search_seconds", "session_size", *[f"{a[:-1]}_aid_session_count" for a in ACTIONS], "min_repeat_count", "max_repeat_count"]
    ints += [*ITEM_COUNTS, *HOUR_COUNTS[2:], *RECENCY_COLS, *AGES, "click_label", "cart_label", "order_label"]
    reals = ["avg_repeat_count", "stddev_repeat_count", *TRANSITION_COLS, *RATES, *HOURLY_REALS, *SI_REALS, *VEC_REALS, *BPR_REALS]
    if variant == "069":
        reals += CVR_PAIR_REALS
    for n in tables:
        ints += [c for c in FEATURES[n][1]["ints"] if c not in ("session", "aid")]
        reals += FEATURES[n][1]["reals"]
    return sql, dict(ints=ints, reals=reals)


for _v in ("067", "069"):
    _sql, _cols = dataset_sql(_v)
    add(f"dataset_{_v}", lambda s, d, v=_v: built(s, d, v)[0], _sql + "out AS (SELECT * FROM data)", **_cols, texts=["split"])

_sql, _ = dataset_sql("069")
_pair = DRAW.format(key="session || '|' || aid", seed=0)
add(
    "sampled_dataset",
    lambda s, d: built(s, d, "069")[1],
    _sql
    + f"""
    target AS (SELECT session, aid, click_label, cart_label, order_label FROM data WHERE split <> 'train'),
    pos AS (SELECT * FROM target WHERE greatest(click_label, cart_label, order_label) = 1),
    neg AS (SELECT * FROM target WHERE greatest(click_label, cart_label, order_label) = 0
            QUALIFY row_number() OVER (ORDER BY {_pair}, session, aid) <= 20 * (SELECT count(*) FROM pos)),
    out AS (SELECT *, CASE WHEN cart_label + order_label >= 1 THEN 1 ELSE 0 END AS cart_order_label, {DRAW.format(key='session::VARCHAR', seed=0)} % 5 AS fold
            FROM (SELECT * FROM pos UNION ALL SELECT * FROM neg))""",
    ints=["session", "aid", "click_label", "cart_label", "order_label", "cart_order_label", "fold"],
)

# --- the training frame of the dataframe half -------------------------------------------
def frame(s, d):
    log = small(s, d)
    train, test = log.where("split = 'train'"), log.where("split = 'valid'")
    return T.frame(train, test, {"m1": matrix(s, d), "m2": matrix(s, d, ["carts", "orders"])}, labels(s, d), {"w2v": item_vectors(s, d)}, ["carts", "orders"])


_FLAG = [f"{a}_gt" for a in ACTIONS]
add(
    "train_frame",
    frame,
    SMALL_SQL
    + LABELS_SQL
    + VECTORS_SQL
    + MATRIX_FEATURES_SQL.replace("own AS (SELECT DISTINCT session, aid FROM log WHERE split <> 'train')", "own AS (SELECT DISTINCT session, aid FROM log WHERE split <> 'train' AND session IN (SELECT session FROM labels WHERE type IN ('carts', 'orders')))")
    + SECOND_MATRIX_SQL
    + A2S_SQL
    + CLOCK_SQL
    + SUBSESSION_SQL
    + FLAGS_SQL.split("gt AS")[0]
    + f"grown0 AS (SELECT session, aid, {fills_sql(['m1', 'm2'])} FROM own FULL JOIN mf USING (session, aid) FULL JOIN mf2 USING (session, aid)), grown AS (SELECT *, {counts_sql(['m1', 'm2'])} FROM grown0),"
    + f"""
    last1 AS (SELECT session, aid AS last_aid FROM log QUALIFY row_number() OVER (PARTITION BY session ORDER BY us DESC, aid DESC) = 1),
    out AS (SELECT g.session, g.aid, {', '.join(MATRIX_COLS['ints'] + MATRIX_COLS['reals'])},
            coalesce(a2s_actions_num, 0) AS a2s_actions_num, coalesce(a2s_best_action_type, -1) AS a2s_best_action_type,
            coalesce(a2s_last_action_index, 999) AS a2s_last_action_index, session_click_diff_mean, session_carts_avg_hour, session_avg_real_length,
            list_distance(v.vector, u.vector) ** 2 AS emb_diff_w2v, list_cosine_similarity(v.vector, u.vector) AS emb_angle_w2v,
            coalesce(clicks_gt, 0) AS clicks_gt, coalesce(carts_gt, 0) AS carts_gt, coalesce(orders_gt, 0) AS orders_gt,
            max(coalesce(clicks_gt, 0)) OVER (PARTITION BY g.session) AS clicks_session, max(coalesce(carts_gt, 0)) OVER (PARTITION BY g.session) AS carts_session,
            max(coalesce(orders_gt, 0)) OVER (PARTITION BY g.session) AS orders_session
            FROM grown g LEFT JOIN a2s USING (session, aid) LEFT JOIN clock USING (session) LEFT JOIN subfeat USING (session) LEFT JOIN flags USING (session, aid)
            LEFT JOIN last1 USING (session) LEFT JOIN vec v ON v.aid = g.aid LEFT JOIN vec u ON u.aid = last_aid)""",
    ints=["session", "aid", *MATRIX_COLS["ints"], "a2s_actions_num", "a2s_best_action_type", "a2s_last_action_index", *_FLAG, *[f"{a}_session" for a in ACTIONS]],
    reals=[*MATRIX_COLS["reals"], "session_click_diff_mean", "session_carts_avg_hour", "session_avg_real_length", "emb_diff_w2v", "emb_angle_w2v"],
)


def blended(s, d):
    return R.blended_submission({"a": submission(s, d, 0), "b": submission(s, d, 1)}, it.item_features(small(s, d)))


_tops = " UNION ALL ".join(
    f"(SELECT '{t}' AS t, aid, row_number() OVER (ORDER BY count(DISTINCT session) DESC, aid) AS rn FROM log WHERE type = '{t}' GROUP BY aid ORDER BY rn LIMIT 20)" for t in ACTIONS
)
add(
    "blended_submission",
    blended,
    SMALL_SQL
    + scores_sql(0)
    + scores_sql(1)
    + submission_sql(0)
    + submission_sql(1)
    + f"""
    mix AS (SELECT session_type, aid, (coalesce(1 / a.rn, 1 / 50) * CASE WHEN contains(session_type, 'click') THEN 2 ELSE 1 END + coalesce(1 / b.rn, 1 / 50)) / 2 AS r
            FROM sub0 a FULL JOIN sub1 b USING (session_type, aid)),
    best AS (SELECT session_type, aid, row_number() OVER (PARTITION BY session_type ORDER BY round(r, 12) DESC, aid) AS rn FROM mix QUALIFY rn <= 20),
    len AS (SELECT session_type, count(*) AS n FROM best GROUP BY session_type),
    tops AS ({_tops}),
    filled AS (SELECT session_type, aid, rn FROM best UNION ALL
               SELECT session_type, aid, 100 + rn FROM len JOIN tops ON split_part(session_type, '_', 2) = t WHERE rn <= 20 - n),
    out AS (SELECT session_type, array_to_string(list(aid ORDER BY rn), ' ') AS labels FROM filled GROUP BY session_type)""",
    texts=["session_type", "labels"],
)


def learned_lists(s, d):
    data = train_set(s, d)
    models = {types: ml.cross_fit(data, MODEL_FEATURES, label)[0] for types, label in (("clicks", "clicks_gt"), ("carts,orders", "carts_gt"))}
    return R.predict_lists(models, data, MODEL_FEATURES).select("session_type", F.size(F.split("labels", " ")).alias("n"))


# what is determined of learned lists: whose they are, and how long
add(
    "predict_lists",
    learned_lists,
    SMALL_SQL
    + scores_sql(0)
    + """
    out AS (SELECT session || '_' || t AS session_type, least(count(*), 50) AS n FROM score0, (VALUES ('clicks'), ('carts'), ('orders')) x(t) GROUP BY session, t)""",
    ints=["n"],
    texts=["session_type"],
)
