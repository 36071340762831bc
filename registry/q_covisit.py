"""Pairs, co-visitation edges and candidate features."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import add
from registry.logs import BIG_SQL, SMALL_SQL, WEIGHT_SQL, big, small
from registry.q_sources import MATRIX_FEATURES_SQL, PAIR_WEIGHT_SQL, SECOND_MATRIX_SQL, matrix, own
from sessionrank.operators import covisit as cv
from sessionrank.operators import pairs as p
from sessionrank.operators.candidates import grow_outer
from sessionrank.plans import candidate_tables as C

HOUR_US = 3_600_000_000


def time_pairs(limit_us: int, types: str | None = None, keep_type: bool = True) -> str:
    """Plain form: numbered events of a session joined with each other."""
    where = f"WHERE type IN ({types})" if types else ""
    kind = ", b.type" if keep_type else ""
    return f"""
    numbered AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY us, aid, type) AS rn FROM log {where}),
    met AS (SELECT DISTINCT a.session, a.aid AS aid_x, b.aid AS aid_y{kind} FROM numbered a JOIN numbered b
            ON a.session = b.session AND a.rn <> b.rn AND abs(a.us - b.us) < {limit_us}),
    """


def place_pairs(fn: str, last_n: int | None = None) -> str:
    keep = f"WHERE back <= {last_n}" if last_n else ""
    order = "us, aid, type" if fn == "row_number" else "us"
    return f"""
    numbered AS (SELECT *, {fn}() OVER (PARTITION BY session ORDER BY {order}) AS rn,
                 dense_rank() OVER (PARTITION BY session ORDER BY us DESC) AS back FROM log),
    met AS (SELECT DISTINCT a.session, a.aid AS aid_x, b.aid AS aid_y, b.type
            FROM (SELECT * FROM numbered {keep}) a JOIN (SELECT * FROM numbered {keep}) b
            ON a.session = b.session AND a.rn <> b.rn AND abs(a.rn - b.rn) <= 2),
    """


PAIR_COLS = dict(ints=["session", "aid_x", "aid_y"])
TYPED = dict(ints=["session", "aid_x", "aid_y"], texts=["type"])
COUNTS_SQL = """
counts AS (SELECT aid_x, aid_y, count(*) FILTER (type = 'clicks') AS count_clicks, count(*) FILTER (type = 'carts') AS count_carts,
           count(*) FILTER (type = 'orders') AS count_orders, count(*) AS count_all,
           sum(CASE type WHEN 'clicks' THEN 1 WHEN 'carts' THEN 6 ELSE 3 END) AS weighted_count_all FROM met GROUP BY aid_x, aid_y),
"""
CVR_SQL = """
cvr AS (SELECT counts.*, (count_carts + count_orders) / (count_clicks + mc) AS cvr_click_to_cart_order,
        count_orders / (count_carts + mk) AS cvr_cart_to_order
        FROM counts, (SELECT avg(count_clicks) AS mc, avg(count_carts) AS mk FROM counts)),
"""


def best_sql(scores, k: int) -> str:
    """Union of the best lists per score, joined back to the counts."""
    lists = " UNION ".join(
        f"(SELECT aid_x, aid_y FROM cvr WHERE {s} > 1 QUALIFY row_number() OVER (PARTITION BY aid_x ORDER BY {s} DESC, "
        f"cvr_click_to_cart_order DESC NULLS LAST, cvr_cart_to_order DESC NULLS LAST, aid_y) <= {k})"
        for s in scores
    )
    return f"lists AS ({lists}), edges AS (SELECT cvr.* FROM lists JOIN cvr USING (aid_x, aid_y)),"


LATEST_SQL = f"""
latest AS (SELECT session, aid, {WEIGHT_SQL} AS w FROM log WHERE split <> 'train'),
"""


def agg(fn: str, expr: str) -> str:
    return f"{'stddev_samp' if fn == 'stddev' else fn}({expr})"


def features_sql(P: str, counts, k: int, stddev: bool, short: bool, by_events: bool):
    """SQL of a feature table, and its columns."""
    fns = ["sum", "avg"] + (["stddev"] if stddev else [])
    ints, reals, cols = ["session", "aid", f"covisit_{P}_type_count", f"covisit_{P}_count"], [], []
    for c in counts:
        for label, expr in ((f"type_{c}", f"{c} * w"), (c, c)):
            for fn in fns:
                name = f"{fn}_{P}_{label}"
                cols.append(f"{agg(fn, expr)} AS {name}")
                (ints if fn == "sum" else reals).append(name)
    for c in cv.CVRS:
        for fn in fns:
            cols.append(f"{agg(fn, c)} AS {fn}_{P}_{c}")
            reals.append(f"{fn}_{P}_{c}")

    def tag(c):
        return c.removeprefix("count_").removesuffix("s") if short else c

    ranks = {}
    for c in counts:
        ranks[f"rn_covisit_{P}_type_{tag(c)}"] = f"sum_{P}_type_{c}"
        ranks[f"rn_covisit_{P}_{tag(c)}"] = f"sum_{P}_{c}"
    ranks[f"rn_covisit_{P}_type_aid_count"] = f"covisit_{P}_type_count"
    ranks[f"rn_covisit_{P}_aid_count"] = f"covisit_{P}_count" if by_events else f"covisit_{P}_type_count"
    for c in cv.CVRS:
        ranks[f"rn_covisit_{P}_{c}"] = f"round(sum_{P}_{c}, 9)"
    rn = ", ".join(f"row_number() OVER (PARTITION BY session ORDER BY {s} DESC NULLS LAST, aid) AS {n}" for n, s in ranks.items())
    keep = " OR ".join(f"{n} <= {k}" for n in ranks)
    sql = f"""
    scored AS (SELECT session, aid_y AS aid, {', '.join(cols)}, sum(w) AS covisit_{P}_type_count, count(*) AS covisit_{P}_count
               FROM latest JOIN edges ON latest.aid = edges.aid_x GROUP BY session, aid_y),
    ranked AS (SELECT *, {rn} FROM scored),
    out AS (SELECT * FROM ranked WHERE {keep})
    """
    return sql, dict(ints=ints + list(ranks), reals=reals)


def weighted_sql(P: str, k: int):
    suffix = {"": ("weight", "1"), "type_": ("weight * w", "w"), "time_": ("weight * tw", "tw"), "type_time_": ("weight * w * tw", "w * tw")}
    cols, ints, reals = [], ["session", "aid"], []
    for s, (value, one) in suffix.items():
        cols += [f"sum({value}) AS sum_{P}_{s}weight", f"avg({value}) AS avg_{P}_{s}weight", f"sum({one}) AS covisit_{P}_{s}count"]
        reals += [f"sum_{P}_{s}weight", f"avg_{P}_{s}weight", f"covisit_{P}_{s}count"]
    ranks = {
        f"rn_{P}": f"sum_{P}_weight",
        f"rn_time_weight_{P}": f"round(sum_{P}_time_weight, 9)",
        f"rn_type_weight_{P}": f"sum_{P}_type_weight",
        f"rn_type_time_weight_{P}": f"round(sum_{P}_type_time_weight, 9)",
    }
    rn = ", ".join(f"row_number() OVER (PARTITION BY session ORDER BY {s} DESC, aid) AS {n}" for n, s in ranks.items())
    keep = " OR ".join(f"{n} <= {k}" for n in ranks)
    sql = f"""
    aged AS (SELECT session, aid, {WEIGHT_SQL} AS w,
             pow(2, percent_rank() OVER (PARTITION BY session ORDER BY us) + 0.1) - 1 AS tw FROM log WHERE split <> 'train'),
    scored AS (SELECT session, aid_y AS aid, {', '.join(cols)} FROM aged JOIN weights ON aged.aid = weights.aid_x GROUP BY session, aid_y),
    ranked AS (SELECT *, {rn} FROM scored),
    out AS (SELECT * FROM ranked WHERE {keep})
    """
    return sql, dict(ints=ints + list(ranks), reals=reals)


# --- pairs ------------------------------------------------------------------------------
add(
    "pairs_time",
    lambda s, d: p.pairs_time(big(s, d), 3600, "SECOND", True, ["clicks"]),
    BIG_SQL + time_pairs(HOUR_US, "'clicks'", False) + "out AS (SELECT * FROM met)",
    **PAIR_COLS,
)
add(
    "pairs_time_cart_order",
    lambda s, d: p.pairs_time(big(s, d), 3600, "SECOND", True, ["carts", "orders"]),
    BIG_SQL + time_pairs(HOUR_US, "'carts', 'orders'", False) + "out AS (SELECT * FROM met)",
    **PAIR_COLS,
)
add(
    "pairs_time_1hour_typed",
    lambda s, d: p.pairs_time(big(s, d), 1, "HOUR", False, keep_type=True),
    BIG_SQL + time_pairs(2 * HOUR_US) + "out AS (SELECT * FROM met)",
    **TYPED,
)
add(
    "pairs_time_1days_typed",
    lambda s, d: p.pairs_time(small(s, d), 24, "HOUR", False, keep_type=True),
    SMALL_SQL + time_pairs(25 * HOUR_US) + "out AS (SELECT * FROM met)",
    **TYPED,
)
add(
    "pairs_time_last_times",
    lambda s, d: p.pairs_time(big(s, d), 24, "HOUR", False, keep_type=True, last_n=30),
    BIG_SQL
    + time_pairs(25 * HOUR_US).replace(
        "FROM log", "FROM (SELECT * FROM log QUALIFY dense_rank() OVER (PARTITION BY session ORDER BY us DESC) <= 30)"
    )
    + "out AS (SELECT * FROM met)",
    **TYPED,
)
add(
    "pairs_window",
    lambda s, d: p.pairs_window(big(s, d), 2, "row_number"),
    BIG_SQL + place_pairs("row_number") + "out AS (SELECT * FROM met)",
    **TYPED,
)
add(
    "pairs_window_dense",
    lambda s, d: p.pairs_window(big(s, d), 2, "dense_rank", 30),
    BIG_SQL + place_pairs("dense_rank", 30) + "out AS (SELECT * FROM met)",
    **TYPED,
)

# --- edges ------------------------------------------------------------------------------
def day_flags(s, d):
    return p.pair_flags(small(s, d), 24, "HOUR", False)


DAY_SQL = SMALL_SQL + time_pairs(25 * HOUR_US) + COUNTS_SQL
COUNT_COLS = ["aid_x", "aid_y", *cv.COUNTS]
add(
    "cov_weight",
    lambda s, d: p.pair_weight(p.pair_flags(big(s, d), 3600, "SECOND", True, ["clicks"])),
    BIG_SQL + PAIR_WEIGHT_SQL.replace("86400000000", str(HOUR_US)) + "out AS (SELECT * FROM weights)",
    ints=["aid_x", "aid_y", "weight"],
)
add(
    "cov_type_counts",
    lambda s, d: p.pair_type_counts(day_flags(s, d)),
    DAY_SQL + "out AS (SELECT * FROM counts)",
    ints=COUNT_COLS,
)
add(
    "cov_type_counts_totals",
    lambda s, d: p.pair_type_counts(p.window_flags(big(s, d), 2, "dense_rank", 30), totals=True),
    BIG_SQL + place_pairs("dense_rank", 30) + COUNTS_SQL + "out AS (SELECT * FROM counts)",
    ints=[*COUNT_COLS, "count_all", "weighted_count_all"],
)
add(
    "cov_cvr",
    lambda s, d: cv.pair_cvr(p.pair_type_counts(day_flags(s, d))),
    DAY_SQL + CVR_SQL + "out AS (SELECT * FROM cvr)",
    ints=COUNT_COLS,
    reals=list(cv.CVRS),
)
add(
    "cov_topk",
    lambda s, d: cv.top_neighbours(cv.pair_cvr(p.pair_type_counts(day_flags(s, d))), cv.COUNTS, 300),
    DAY_SQL + CVR_SQL + best_sql(cv.COUNTS, 300) + "out AS (SELECT * FROM edges)",
    ints=COUNT_COLS,
    reals=list(cv.CVRS),
)
add(
    "join_expand",
    lambda s, d: cv.expand(
        cv.history(small(s, d)), p.pair_weight(p.pair_flags(small(s, d), 24 * 3600, "SECOND", True, ["clicks"]))
    )
    .groupBy("session", "aid_y")
    .agg(F.sum(F.col("weight") * F.col("n")).alias("total"), F.sum("n").alias("hits")),
    SMALL_SQL
    + PAIR_WEIGHT_SQL
    + LATEST_SQL
    + "out AS (SELECT session, aid_y, sum(weight) AS total, count(*) AS hits FROM latest JOIN weights ON latest.aid = weights.aid_x GROUP BY session, aid_y)",
    ints=["session", "aid_y", "total", "hits"],
)

# --- session scores ---------------------------------------------------------------------
_sql, _cols = features_sql("cs", cv.COUNTS, 1000, False, True, False)
add(
    "cov_session_agg",
    lambda s, d: cv.covisit_features(
        small(s, d), cv.top_neighbours(cv.pair_cvr(p.pair_type_counts(day_flags(s, d))), cv.COUNTS, 300), "cs", k=1000
    ),
    DAY_SQL + CVR_SQL + best_sql(cv.COUNTS, 300) + LATEST_SQL + _sql,
    **_cols,
)
_sql, _cols = weighted_sql("cw", 1000)
add(
    "cov_session_agg_w",
    lambda s, d: cv.weighted_covisit_features(
        small(s, d), p.pair_weight(p.pair_flags(small(s, d), 24 * 3600, "SECOND", True, ["clicks"])), "cw", k=1000
    ),
    SMALL_SQL + PAIR_WEIGHT_SQL + _sql,
    **_cols,
)
BIGRAM_SQL = """
steps AS (SELECT session, aid AS aid_x, lead(aid) OVER (PARTITION BY session ORDER BY us, aid, type) AS aid_y FROM log),
tr AS (SELECT aid_x, aid_y, count(*) AS n, count(DISTINCT session) AS n_sessions FROM steps WHERE aid_y IS NOT NULL GROUP BY ALL),
"""
NORM_SQL = BIGRAM_SQL + """
outgoing AS (SELECT aid_x AS aid, sum(n) AS n, sum(n_sessions) AS s FROM tr GROUP BY aid_x),
norm AS (SELECT tr.aid_x, tr.aid_y, tr.n / sqrt(coalesce(x.n, 1) * coalesce(y.n, 1)) AS norm_transition_count,
         tr.n_sessions / sqrt(coalesce(x.s, 1) * coalesce(y.s, 1)) AS norm_transition_user_count
         FROM tr LEFT JOIN outgoing x ON tr.aid_x = x.aid LEFT JOIN outgoing y ON tr.aid_y = y.aid),
"""
add(
    "bigram_counts",
    lambda s, d: p.transitions(big(s, d)),
    BIG_SQL + BIGRAM_SQL + "out AS (SELECT * FROM tr)",
    ints=["aid_x", "aid_y", "n", "n_sessions"],
)
add(
    "bigram_norm",
    lambda s, d: p.normalise_transitions(p.transitions(big(s, d))),
    BIG_SQL + NORM_SQL + "out AS (SELECT * FROM norm)",
    ints=["aid_x", "aid_y"],
    reals=["norm_transition_count", "norm_transition_user_count"],
)


def bigram_sql(P: str, k_item: int, k: int):
    names = ("norm_transition_count", "norm_transition_user_count")
    cols, reals = [], []
    for c in names:
        for label, expr in ((f"type_weight_{c}", f"{c} * w"), (c, c)):
            for fn in ("sum", "avg", "stddev"):
                cols.append(f"{agg(fn, expr)} AS {fn}_{P}_{label}")
                reals.append(f"{fn}_{P}_{label}")
    ranks = {}
    for c in names:
        ranks[f"rn_{P}_type_weight_{c}"] = f"round(sum_{P}_type_weight_{c}, 9)"
        ranks[f"rn_{P}_{c}"] = f"round(sum_{P}_{c}, 9)"
    ranks[f"rn_{P}_type_weight_aid_count"] = f"{P}_type_weight_count"
    ranks[f"rn_{P}_aid_count"] = f"{P}_count"
    rn = ", ".join(f"row_number() OVER (PARTITION BY session ORDER BY {s} DESC, aid) AS {n}" for n, s in ranks.items())
    keep = " OR ".join(f"{n} <= {k}" for n in ranks)
    sql = f"""
    edges AS (SELECT * FROM norm QUALIFY row_number() OVER (PARTITION BY aid_x ORDER BY norm_transition_count DESC, aid_y) <= {k_item}
              OR row_number() OVER (PARTITION BY aid_x ORDER BY norm_transition_user_count DESC, aid_y) <= {k_item}),
    scored AS (SELECT session, aid_y AS aid, {', '.join(cols)}, sum(w) AS {P}_type_weight_count, count(*) AS {P}_count
               FROM latest JOIN edges ON latest.aid = edges.aid_x GROUP BY session, aid_y),
    ranked AS (SELECT *, {rn} FROM scored),
    out AS (SELECT * FROM ranked WHERE {keep})
    """
    return sql, dict(ints=["session", "aid", f"{P}_type_weight_count", f"{P}_count", *ranks], reals=reals)


_sql, _cols = bigram_sql("bg", 500, 1000)
add(
    "bigram_candidates",
    lambda s, d: cv.bigram_features(small(s, d), p.normalise_transitions(p.transitions(small(s, d))), "bg", 500, 1000),
    SMALL_SQL + NORM_SQL + LATEST_SQL + _sql,
    **_cols,
)

# --- the six tables with their own parameters -------------------------------------------
def table_query(name: str, log, log_sql: str, pairs_sql: str, counts, stddev, totals, k_item=300, k=1000):
    keep = C.CANDIDATE_LIMITS[name]
    sql, cols = features_sql(name, counts, k, stddev, not totals, totals)
    ranks = [c for c in cols["ints"] if c.startswith("rn_")]
    cut = " OR ".join(f"{r} <= {keep}" for r in ranks)
    sql = sql.replace("out AS (", "feat AS (") + f", out AS (SELECT * FROM feat WHERE {cut})"
    add(
        name,
        lambda s, d: C.candidates(C.TABLES[name](log(s, d)), name),
        log_sql + pairs_sql + COUNTS_SQL + CVR_SQL + best_sql(counts, k_item) + LATEST_SQL + sql,
        **cols,
    )


table_query("covisit_items_1hour", big, BIG_SQL, time_pairs(2 * HOUR_US), cv.COUNTS, False, False)
table_query("covisit_items_1days", small, SMALL_SQL, time_pairs(25 * HOUR_US), cv.COUNTS, False, False)
table_query("covisit_items_window_size5_v3", big, BIG_SQL, place_pairs("row_number"), cv.COUNTS, True, False)
table_query("covisit_items_window_size5_v4", small, SMALL_SQL, place_pairs("dense_rank", 30), cv.ALL_COUNTS, True, True)

for _name, _types in (("click2click_covisit_1hour", "'clicks'"), ("cart_order2cart_order_covisit_1hour", "'carts', 'orders'")):
    _sql, _cols = weighted_sql(_name, 1000)
    _cut = " OR ".join(f"{r} <= 30" for r in _cols["ints"] if r.startswith("rn_"))
    _weights = "weights AS (SELECT aid_x, aid_y, count(*) AS weight FROM met GROUP BY ALL HAVING count(*) > 1),"
    add(
        _name,
        lambda s, d, n=_name: C.candidates(C.TABLES[n](big(s, d)), n),
        BIG_SQL + time_pairs(HOUR_US, _types, False) + _weights + _sql.replace("out AS (", "feat AS (") + f", out AS (SELECT * FROM feat WHERE {_cut})",
        **_cols,
    )
_sql, _cols = bigram_sql("covisit_bigram_v2", 500, 1000)
_cut = " OR ".join(f"{r} <= 50" for r in _cols["ints"] if r.startswith("rn_"))
add(
    "covisit_bigram_v2",
    lambda s, d: C.candidates(C.covisit_bigram_v2(big(s, d)), "covisit_bigram_v2"),
    BIG_SQL + NORM_SQL + LATEST_SQL + _sql.replace("out AS (", "feat AS (") + f", out AS (SELECT * FROM feat WHERE {_cut})",
    **_cols,
)
add(
    "w_multi_rank_filter",
    lambda s, d: cv.keep_any_rank(
        big(s, d).groupBy("session", "aid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("aid") % 7).alias("m")),
        "session",
        {"rn_n": F.col("n"), "rn_m": F.col("m")},
        5,
    ),
    BIG_SQL
    + """
    g AS (SELECT session, aid, count(*) AS n, sum(aid % 7) AS m FROM log GROUP BY ALL),
    out AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, aid) AS rn_n,
            row_number() OVER (PARTITION BY session ORDER BY m DESC, aid) AS rn_m FROM g QUALIFY rn_n <= 5 OR rn_m <= 5)
    """,
    ints=["session", "aid", "n", "m", "rn_n", "rn_m"],
)
def fills_sql(versions) -> str:
    one = "coalesce({v}_num, 0) AS {v}_num, " + ", ".join(f"coalesce({c}, -1) AS {c}" for c in ("{v}_indmin", "wgt_{v}_sum", "wgt_{v}_mean", "wgt_rel_{v}_sum", "wgt_rel_{v}_mean"))
    return ", ".join(one.format(v=v) for v in versions)


def counts_sql(versions) -> str:
    has = " + ".join(f"CASE WHEN {v}_num > 0 THEN 1 ELSE 0 END" for v in versions)
    return f"{has} AS matrices_num, {' + '.join(f'{v}_num' for v in versions)} AS matrices_numsum, {' + '.join(f'wgt_{v}_mean' for v in versions)} AS matrices_wgt_rel_mean"


MATRIX_COLS = dict(
    ints=[x for v in ("m1", "m2") for x in (f"{v}_num", f"{v}_indmin")] + ["matrices_num", "matrices_numsum"],
    reals=[f"wgt_{r}{v}_{f}" for v in ("m1", "m2") for r in ("", "rel_") for f in ("sum", "mean")] + ["matrices_wgt_rel_mean"],
)
add(
    "mat_counts",
    lambda s, d: cv.matrix_counts(
        grow_outer(own(s, d), [cv.matrix_features(own(s, d), matrix(s, d), "m1"), cv.matrix_features(own(s, d), matrix(s, d, ["carts", "orders"]), "m2")]), ["m1", "m2"]
    ),
    SMALL_SQL
    + MATRIX_FEATURES_SQL
    + SECOND_MATRIX_SQL
    + f"""
    grown AS (SELECT session, aid, {fills_sql(["m1", "m2"])} FROM own FULL JOIN mf USING (session, aid) FULL JOIN mf2 USING (session, aid)),
    out AS (SELECT *, {counts_sql(["m1", "m2"])} FROM grown)
    """,
    ints=["session", "aid", *MATRIX_COLS["ints"]],
    reals=MATRIX_COLS["reals"],
)
