"""Session, item and session-item features, window functions and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from registry.core import add, joined
from registry.logs import BIG_SQL, SMALL_ALL_SQL, SMALL_SQL, big, labels, small, small_all
from registry.q_sources import us
from sessionrank.functions import hashing, numbers, times
from sessionrank.operators import items as it
from sessionrank.operators import ranks as r
from sessionrank.operators import session_items as si
from sessionrank.operators import sessions as se
from sessionrank.operators import vector_features as vf
from sessionrank.operators.filters import with_scalars
from sessionrank.operators.order import in_order
from sessionrank.schema import ACTIONS

TYPES = {"clicks": "CL", "carts": "CA", "orders": "OR"}


def per_type(expr: str, name: str) -> str:
    """One aggregate per action."""
    return ", ".join(f"{expr} FILTER (type = '{t}') AS {name.format(t=t, one=t[:-1])}" for t in ACTIONS)


# --- sessions ---------------------------------------------------------------------------
add(
    "sess_basic",
    lambda s, d: se.session_features(big(s, d)),
    BIG_SQL
    + f"""out AS (SELECT session, (max(us) - min(us)) // 1000000 AS search_seconds, count(*) AS session_size,
          {per_type('count(DISTINCT aid)', '{one}_aid_session_count')} FROM log GROUP BY session)""",
    ints=["session", "search_seconds", "session_size", *[f"{t[:-1]}_aid_session_count" for t in ACTIONS]],
)
add(
    "sess_counts",
    lambda s, d: se.session_counts(big(s, d)),
    BIG_SQL
    + f"""out AS (SELECT session, count(*) AS session_actions, count(DISTINCT aid) AS session_items,
          {per_type('count(*)', 'session_{t}')}, {per_type('count(DISTINCT aid)', 'session_items_{one}ed')} FROM log GROUP BY session)""",
    ints=["session", "session_actions", "session_items", *[f"session_{t}" for t in ACTIONS], *[f"session_items_{t[:-1]}ed" for t in ACTIONS]],
)
add(
    "sess_span",
    lambda s, d: se.session_span(small(s, d)),
    SMALL_SQL
    + """out AS (SELECT session, max(us // 1000000) - min(us // 1000000) AS session_full_length,
         min(us // 1000000) AS session_first_ts, max(us // 1000000) AS session_last_ts FROM log GROUP BY session)""",
    ints=["session", "session_full_length", "session_first_ts", "session_last_ts"],
)
SUB_SQL = """
stepped AS (SELECT *, us // 1000000 AS sec, us // 1000000 - lag(us // 1000000) OVER (PARTITION BY session ORDER BY us // 1000000, aid, type) AS step FROM log),
subs AS (SELECT *, sum(CASE WHEN step > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY sec, aid, type ROWS UNBOUNDED PRECEDING) AS sub,
         CASE WHEN step <= 7200 THEN step END AS gap FROM stepped),
"""
SUBSESSION_SQL = SUB_SQL + f"""
parts AS (SELECT session, sub, max(sec) - min(sec) AS length, count(DISTINCT aid) AS items FROM subs GROUP BY ALL),
real AS (SELECT session, count(*) AS session_real_num, avg(length) AS session_avg_real_length, avg(items) AS session_avg_real_items_num FROM parts GROUP BY session),
tot AS (SELECT session, count(*) AS actions, {per_type('count(*)', '{t}')}, coalesce(avg(gap), -1) AS session_click_diff_mean,
        coalesce(quantile_cont(gap, 0.5), -1) AS session_click_diff_median FROM subs GROUP BY session),
subfeat AS (SELECT *, actions / session_real_num AS session_actions_avg_real, clicks / session_real_num AS session_clicks_avg_real,
        carts / session_real_num AS session_carts_avg_real, orders / session_real_num AS session_orders_avg_real FROM real JOIN tot USING (session)),
"""
add(
    "sess_real",
    lambda s, d: se.subsession_features(small(s, d)),
    SMALL_SQL + SUBSESSION_SQL + "out AS (SELECT * FROM subfeat)",
    ints=["session", "session_real_num"],
    reals=["session_avg_real_length", "session_avg_real_items_num", *[f"session_{t}_avg_real" for t in ("actions", *ACTIONS)]],
)
add(
    "sess_gaps",
    lambda s, d: se.subsession_features(big(s, d)),
    BIG_SQL + SUBSESSION_SQL + "out AS (SELECT * FROM subfeat)",
    ints=["session"],
    reals=["session_click_diff_mean", "session_click_diff_median"],
)
CLOCK_SQL = f"""
clock AS (SELECT session, {', '.join(f"coalesce(avg((us // 1000000) % 86400 / 3600) FILTER (type = '{t}'), -1) AS session_{t}_avg_hour" for t in ACTIONS)},
         min(us // 1000000) % 604800 // 86400 AS session_start_dow, max(us // 1000000) % 604800 // 86400 AS session_end_dow FROM log GROUP BY session),
"""
add(
    "sess_hours",
    lambda s, d: se.session_clock(small(s, d)),
    SMALL_SQL + CLOCK_SQL + "out AS (SELECT * FROM clock)",
    ints=["session", "session_start_dow", "session_end_dow"],
    reals=[f"session_{t}_avg_hour" for t in ACTIONS],
)

# --- items ------------------------------------------------------------------------------
ITEM_SQL = f"""
item_base AS (SELECT aid, {', '.join(f"nullif(count(DISTINCT session) FILTER (type = '{t}'), 0) AS n_session_{t}" for t in ACTIONS)},
              {', '.join(f"nullif(count(*) FILTER (type = '{t}'), 0) AS action_count_{t}" for t in ACTIONS)},
              min(us) AS min_us, max(us) AS max_us FROM log GROUP BY aid),
item AS (SELECT *, {', '.join(
    f"({k}_carts + {k}_orders) / ({k}_clicks + avg({k}_clicks) OVER ()) AS {k}_cvr_click_to_cart_order, "
    f"{k}_carts / ({k}_clicks + avg({k}_clicks) OVER ()) AS {k}_cvr_click_to_cart, "
    f"{k}_orders / ({k}_clicks + avg({k}_clicks) OVER ()) AS {k}_cvr_click_to_order, "
    f"{k}_orders / ({k}_carts + avg({k}_carts) OVER ()) AS {k}_cvr_cart_to_order"
    for k in ('n_session', 'action_count'))} FROM item_base),
"""
RATES = [f"{k}_cvr_{x}" for k in ("n_session", "action_count") for x in ("click_to_cart_order", "click_to_cart", "click_to_order", "cart_to_order")]
ITEM_COUNTS = [f"{k}_{t}" for k in ("n_session", "action_count") for t in ACTIONS]


def items_us(df):
    return df.withColumns({"min_us": F.unix_micros("action_min_ts"), "max_us": F.unix_micros("action_max_ts")})


add(
    "item_sessions",
    lambda s, d: items_us(it.item_features(big(s, d))),
    BIG_SQL + ITEM_SQL + "out AS (SELECT * FROM item)",
    ints=["aid", *ITEM_COUNTS, "min_us", "max_us"],
    reals=RATES,
)


def train_test(s, d):
    log = big(s, d)
    return log.where("split = 'train'"), log.where("split = 'valid'")


def one_ratio_sql(split: str, x: str) -> str:
    nums = ", ".join(f"count(DISTINCT session) FILTER (type = '{t}') AS num_{c}" for t, c in TYPES.items())
    ratios = ", ".join(
        f"CASE WHEN num_{a} > 0 THEN num_{b} / num_{a} WHEN num_{b} > 0 THEN 'Infinity'::DOUBLE END AS aid_{a}2{b}_{x}"
        for a, b in (("CL", "CA"), ("CA", "OR"), ("CL", "OR"))
    )
    ranks = ", ".join(
        f"num_{c} / nullif(avg(num_{c}) OVER (), 0) AS aid_{c}_vs_mean_{x}, "
        f"rank() OVER (ORDER BY num_{c} DESC) + (count(*) OVER (PARTITION BY num_{c}) - 1) / 2 AS aid_{c}_rank_int_{x}, "
        f"(rank() OVER (ORDER BY num_{c} DESC) + (count(*) OVER (PARTITION BY num_{c}) - 1) / 2) / count(*) OVER () AS aid_{c}_rank_pct_{x}"
        for c in TYPES.values()
    )
    return f"""
    num_{x} AS (SELECT aid, {nums} FROM log WHERE split = '{split}' GROUP BY aid),
    {x} AS (SELECT aid, {ratios}, {ranks} FROM num_{x}),
    """


RATIO_STEMS = ["aid_CL2CA", "aid_CA2OR", "aid_CL2OR", *[f"aid_{c}_{k}" for c in TYPES.values() for k in ("vs_mean", "rank_int", "rank_pct")]]


def _default(stem):
    return "2000000" if "rank_int" in stem else "2" if "rank_pct" in stem else "-1"


_change = ", ".join(
    f"CASE WHEN {st}_trn <> 0 THEN CASE WHEN NOT isnan({st}_tst / {st}_trn) THEN {st}_tst / {st}_trn END WHEN {st}_tst > 0 THEN 'Infinity'::DOUBLE END AS {st}_tst_vs_trn"
    for st in RATIO_STEMS
)
_filled = ", ".join(f"coalesce({st}_{x}, {_default(st)}) AS {st}_{x}" for st in RATIO_STEMS for x in ("trn", "tst", "tst_vs_trn"))
RATIO_SQL = one_ratio_sql("train", "trn") + one_ratio_sql("valid", "tst") + f"""
both_logs AS (SELECT *, {_change} FROM trn FULL JOIN tst USING (aid)),
ratios AS (SELECT aid, {_filled} FROM both_logs),
"""
RATIO_COLS = [f"{st}_{x}" for st in RATIO_STEMS for x in ("trn", "tst", "tst_vs_trn")]
add(
    "item_ratios",
    lambda s, d: it.item_ratios(*train_test(s, d)),
    BIG_SQL + RATIO_SQL + "out AS (SELECT * FROM ratios)",
    ints=["aid"],
    reals=RATIO_COLS,
)
RATING_SQL = f"""
popular AS (SELECT aid, type, row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, aid) - 1 AS place FROM log GROUP BY aid, type),
rating AS (SELECT aid, {', '.join(f"coalesce(max(place) FILTER (type = '{t}'), 2000000) AS {t}_rating_full" for t in ACTIONS)} FROM popular GROUP BY aid),
"""
add(
    "item_rating",
    lambda s, d: it.item_positions(big(s, d), "full"),
    BIG_SQL + RATING_SQL + "out AS (SELECT * FROM rating)",
    ints=["aid", *[f"{t}_rating_full" for t in ACTIONS]],
)
MULTI_SQL = f"""
repeated AS (SELECT aid, session, type, count(*) AS n FROM log GROUP BY ALL),
multi AS (SELECT aid, {', '.join(f"coalesce(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END) FILTER (type = '{t}'), -1) AS aid_multi_{t}_percent_full" for t in ACTIONS)} FROM repeated GROUP BY aid),
"""
add(
    "item_multi",
    lambda s, d: it.item_multi_share(small(s, d), "full"),
    SMALL_SQL + MULTI_SQL + "out AS (SELECT * FROM multi)",
    ints=["aid"],
    reals=[f"aid_multi_{t}_percent_full" for t in ACTIONS],
)
DOW_SQL = f"""
dows AS (SELECT aid, type, us // 1000000 % 604800 // 86400 AS dow, count(*) AS n FROM log GROUP BY ALL),
dow1 AS (SELECT * FROM dows QUALIFY row_number() OVER (PARTITION BY aid, type ORDER BY n DESC, dow) = 1),
fav AS (SELECT aid, {', '.join(f"max(dow) FILTER (type = '{t}') AS aid_{t}_favourite_dow_full" for t in ACTIONS)} FROM dow1 GROUP BY aid),
"""
add(
    "item_fav_dow",
    lambda s, d: it.item_favourite_dow(big(s, d), "full"),
    BIG_SQL + DOW_SQL + "out AS (SELECT * FROM fav)",
    ints=["aid", *[f"aid_{t}_favourite_dow_full" for t in ACTIONS]],
)
REPEAT_SQL = """
visits AS (SELECT session, aid, count(*) AS n FROM log GROUP BY ALL),
rep AS (SELECT aid, avg(n) AS avg_repeat_count, stddev_samp(n) AS stddev_repeat_count, min(n) AS min_repeat_count, max(n) AS max_repeat_count FROM visits GROUP BY aid),
"""
REPEAT_COLS = dict(ints=["aid", "min_repeat_count", "max_repeat_count"], reals=["avg_repeat_count", "stddev_repeat_count"])
add("item_repeat", lambda s, d: it.item_repeat(small(s, d)), SMALL_SQL + REPEAT_SQL + "out AS (SELECT * FROM rep)", **REPEAT_COLS)
TRANSITION_COLS = [f"transition_prob_{a}_{b}" for a in ACTIONS for b in ACTIONS]
TRANSITION_SQL = f"""
lagged AS (SELECT aid, type, lag(type) OVER (PARTITION BY session, aid ORDER BY us, type) AS before FROM log),
moves AS (SELECT aid, before, type, count(*) AS n FROM lagged GROUP BY ALL),
probs AS (SELECT aid, before || '_' || type AS move, n / (sum(n) OVER (PARTITION BY aid, before) + avg(n) OVER ()) AS p FROM moves),
trans AS (SELECT aid, {', '.join(f"sum(p) FILTER (move = '{a}_{b}') AS transition_prob_{a}_{b}" for a in ACTIONS for b in ACTIONS)} FROM probs GROUP BY aid),
"""
add(
    "item_transition",
    lambda s, d: it.item_type_transitions(small(s, d)),
    SMALL_SQL + TRANSITION_SQL + "out AS (SELECT * FROM trans)",
    ints=["aid"],
    reals=TRANSITION_COLS,
)
HOURS_SQL = f"""
hours AS (SELECT aid, us // 3600000000 * 3600 AS ts_hour, {per_type('count(*)', 'hour_visit_count_{t}')} FROM log GROUP BY ALL),
"""
HOUR_COUNTS = ["aid", "ts_hour", *[f"hour_visit_count_{t}" for t in ACTIONS]]
add("item_hour_counts", lambda s, d: it.item_hour_counts(small(s, d)), SMALL_SQL + HOURS_SQL + "out AS (SELECT * FROM hours)", ints=HOUR_COUNTS)
_frames = ", ".join(
    f"{fn}(hour_visit_count_{t}) OVER (PARTITION BY aid ORDER BY ts_hour RANGE BETWEEN {h * 3600} PRECEDING AND CURRENT ROW) AS {n}_{h}hour_visit_count_{t}"
    for h in it.HOURS
    for fn, n in (("avg", "avg"), ("stddev_samp", "std"))
    for t in ACTIONS
)
HOURLY_SQL = HOURS_SQL + f"hourly AS (SELECT *, {_frames} FROM hours),"
HOURLY_REALS = [f"{n}_{h}hour_visit_count_{t}" for h in it.HOURS for n in ("avg", "std") for t in ACTIONS]
add(
    "w_range_frame",
    lambda s, d: it.item_hourly(small(s, d), 1704153600, 1705968000),
    SMALL_SQL
    + HOURLY_SQL.replace("hourly AS (SELECT *", "clipped AS (SELECT * FROM hours WHERE ts_hour BETWEEN 1704153600 AND 1705968000), hourly AS (SELECT *").replace(
        " FROM hours),", " FROM clipped),"
    )
    + "out AS (SELECT * FROM hourly)",
    ints=HOUR_COUNTS,
    reals=HOURLY_REALS,
)

# --- session items ----------------------------------------------------------------------
SI_SQL = f"""
placed AS (SELECT *, (max(us) OVER (PARTITION BY session) - us) // 1000000 AS ago, dense_rank() OVER (PARTITION BY session ORDER BY us DESC) AS dr FROM log),
si_base AS (SELECT session, aid, {per_type('count(*)', 'visit_count_{t}')}, {per_type('sum(1 / (ln(ago + 1) + 1))', 'time_weighted_visit_count_{t}')},
            min(ago) AS min_seconds_to_latest, max(ago) AS max_seconds_to_latest, avg(dr) AS avg_session_dense_rank, stddev_samp(dr) AS std_session_dense_rank
            FROM placed GROUP BY session, aid),
si AS (SELECT *, visit_count_clicks + visit_count_carts * 6 + visit_count_orders * 3 AS type_weighted_visit_counts,
       row_number() OVER (PARTITION BY session ORDER BY visit_count_clicks + visit_count_carts * 6 + visit_count_orders * 3 DESC, aid) AS rn_type_weighted_visit_counts FROM si_base),
"""
SI_INTS = ["session", "aid", *[f"visit_count_{t}" for t in ACTIONS], "min_seconds_to_latest", "max_seconds_to_latest", "type_weighted_visit_counts", "rn_type_weighted_visit_counts"]
SI_REALS = [*[f"time_weighted_visit_count_{t}" for t in ACTIONS], "avg_session_dense_rank", "std_session_dense_rank"]
add("si_counts", lambda s, d: si.session_item_features(small(s, d)), SMALL_SQL + SI_SQL + "out AS (SELECT * FROM si)", ints=SI_INTS, reals=SI_REALS[:3])
add("si_time", lambda s, d: si.session_item_features(big(s, d)), BIG_SQL + SI_SQL + "out AS (SELECT * FROM si)", ints=["session", "aid", "min_seconds_to_latest", "max_seconds_to_latest"], reals=SI_REALS[3:])
_c, _k, _o = (f"visit_count_{t}" for t in ACTIONS)
CVR_PAIR_SQL = f"""
si_mean AS (SELECT avg({_c}) AS mc, avg({_k}) AS mk FROM si),
si_rate AS (SELECT session, aid, {_c}, {_k}, {_k} / ({_c} + mc) AS cvr_visit_count_clicks2carts, {_o} / ({_c} + mc) AS cvr_visit_count_clicks2orders,
            ({_k} + {_o}) / ({_c} + mc) AS cvr_visit_count_clicks2cart_orders, {_o} / ({_k} + mk) AS cvr_visit_count_carts2orders FROM si, si_mean),
si_cvr AS (SELECT session, aid, {', '.join(f'cvr_visit_count_{n}' for n in si.RATE_NAMES)},
           {', '.join(f'{b} * cvr_visit_count_{n} AS visit_count_{n}_exp_value_per_session, {b} * {r_} AS visit_count_{n}_exp_value_per_all' for n, (b, r_) in si.RATE_NAMES.items())}
           FROM si_rate LEFT JOIN item USING (aid)),
"""
CVR_PAIR_REALS = [f"cvr_visit_count_{n}" for n in si.RATE_NAMES] + [f"visit_count_{n}_exp_value_per_{x}" for n in si.RATE_NAMES for x in ("session", "all")]
add(
    "si_cvr",
    lambda s, d: si.session_item_cvr(si.session_item_features(small(s, d)), it.item_features(small(s, d))),
    SMALL_SQL + SI_SQL + ITEM_SQL + CVR_PAIR_SQL + "out AS (SELECT * FROM si_cvr)",
    ints=["session", "aid"],
    reals=CVR_PAIR_REALS,
)
LATEST_SQL = f"""
places AS (SELECT *, (max(us) OVER (PARTITION BY session) - us) // 1000000 AS ago,
           row_number() OVER (PARTITION BY session, type ORDER BY us DESC, aid DESC) AS place FROM log),
recency AS (SELECT session, aid, {per_type('min(place)', 'latest_rank_{t}')}, {per_type('min(ago)', 'seconds_to_latest_{t}')} FROM places GROUP BY session, aid),
"""
RECENCY_COLS = [*[f"latest_rank_{t}" for t in ACTIONS], *[f"seconds_to_latest_{t}" for t in ACTIONS]]
add("si_latest", lambda s, d: si.session_item_recency(big(s, d)), BIG_SQL + LATEST_SQL + "out AS (SELECT * FROM recency)", ints=["session", "aid", *RECENCY_COLS])
A2S_SQL = f"""
backs AS (SELECT *, us // 1000000 AS sec, row_number() OVER (PARTITION BY session ORDER BY us DESC, aid DESC, type DESC) - 1 AS place FROM log),
a2s_base AS (SELECT session, aid, {per_type('count(*)', 'a2s_{t}_num')},
             {', '.join(f"coalesce(max(sec) FILTER (type = '{t}'), -1) AS a2s_last_{t[:-1]}_ts, coalesce(min(place) FILTER (type = '{t}'), 999) AS a2s_last_{t[:-1]}_index" for t in ACTIONS)}
             FROM backs GROUP BY session, aid),
a2s AS (SELECT *, a2s_clicks_num + a2s_carts_num + a2s_orders_num AS a2s_actions_num,
        least(a2s_last_click_index, a2s_last_cart_index, a2s_last_order_index) AS a2s_last_action_index,
        greatest(a2s_last_click_ts, a2s_last_cart_ts, a2s_last_order_ts) AS a2s_last_action_ts,
        CASE WHEN a2s_orders_num > 0 THEN 2 WHEN a2s_carts_num > 0 THEN 1 ELSE 0 END AS a2s_best_action_type FROM a2s_base),
"""
A2S_COLS = [
    *[f"a2s_{t}_num" for t in ("actions", *ACTIONS)],
    *[f"a2s_last_{t}_{x}" for t in ("action", "click", "cart", "order") for x in ("ts", "index")],
    "a2s_best_action_type",
]
add("si_a2s", lambda s, d: si.session_item_actions(big(s, d)), BIG_SQL + A2S_SQL + "out AS (SELECT * FROM a2s)", ints=["session", "aid", *A2S_COLS])


def relative(s, d):
    log = big(s, d)
    pairs = log.select("session", (F.col("aid") + F.col("session") % 2).alias("aid")).distinct()
    trn, tst = train_test(s, d)
    ratios = it.item_ratios(trn, tst).select("aid", "aid_CL2CA_trn", "aid_CL2OR_trn", "aid_CA2OR_trn", "aid_CL2CA_tst")
    fav = it.item_favourite_dow(tst, "test").select("aid", "aid_clicks_favourite_dow_test")
    out = (
        pairs.join(se.session_counts(log).join(se.session_span(log), "session"), "session", "left")
        .join(ratios.join(fav, "aid", "left"), "aid", "left")
        .join(si.session_item_actions(log), ["session", "aid"], "left")
    )
    return si.relative_features(out)


_rel = ", ".join(
    f"CASE WHEN session_{t} > 0 THEN coalesce(a2s_{t}_num, 0) / session_{t} WHEN coalesce(a2s_{t}_num, 0) > 0 THEN 'Infinity'::DOUBLE ELSE -1 END AS a2s_{t}_rel"
    for t in ("actions", *ACTIONS)
)
_diffs = ", ".join(
    f"session_last_ts - coalesce(a2s_last_{one}_ts, -1) AS ts_diff{sfx}, (session_last_ts - coalesce(a2s_last_{one}_ts, -1)) / (session_full_length + 1) AS ts_diff{sfx}_rel"
    for sfx, one in (("", "action"), ("_clicks", "click"), ("_carts", "cart"), ("_orders", "order"))
)


def product(count: str, rate: str) -> str:
    return f"CASE WHEN isinf({rate}) AND coalesce({count}, 0) = 0 THEN NULL ELSE coalesce({count}, 0) * {rate} END"


REL_SQL = f"""
sess AS (SELECT session, count(*) AS session_actions, {per_type('count(*)', 'session_{t}')}, max(us // 1000000) - min(us // 1000000) AS session_full_length,
         max(us // 1000000) AS session_last_ts FROM log GROUP BY session),
test_dow AS (SELECT aid, us // 1000000 % 604800 // 86400 AS dow FROM log WHERE split = 'valid' AND type = 'clicks' GROUP BY aid, us // 1000000 % 604800 // 86400
             QUALIFY row_number() OVER (PARTITION BY aid ORDER BY count(*) DESC, us // 1000000 % 604800 // 86400) = 1),
pairs AS (SELECT DISTINCT session, aid + session % 2 AS aid FROM log),
rel AS (SELECT session, aid, {_rel}, {_diffs},
        coalesce(least(abs(session_last_ts % 604800 // 86400 - dow), 7 - abs(session_last_ts % 604800 // 86400 - dow)), 14) AS aid_clicks_favourite_dow_diff_test,
        {product('a2s_clicks_num', 'aid_CL2CA_trn')} AS CA_estimation_frCL_trn, {product('a2s_clicks_num', 'aid_CL2OR_trn')} AS OR_estimation_frCL_trn,
        {product('a2s_carts_num', 'aid_CA2OR_trn')} AS OR_estimation_frCA_trn, {product('a2s_clicks_num', 'aid_CL2CA_tst')} AS CA_estimation_frCL_tst
        FROM pairs LEFT JOIN sess USING (session) LEFT JOIN ratios USING (aid) LEFT JOIN test_dow USING (aid) LEFT JOIN a2s USING (session, aid)),
"""
add(
    "si_rel",
    relative,
    BIG_SQL + RATIO_SQL + A2S_SQL + REL_SQL + "out AS (SELECT * FROM rel)",
    ints=["session", "aid", *[f"ts_diff{x}" for x in ("", "_clicks", "_carts", "_orders")], "aid_clicks_favourite_dow_diff_test"],
    reals=[
        *[f"a2s_{t}_rel" for t in ("actions", *ACTIONS)],
        *[f"ts_diff{x}_rel" for x in ("", "_clicks", "_carts", "_orders")],
        "CA_estimation_frCL_trn",
        "OR_estimation_frCL_trn",
        "OR_estimation_frCA_trn",
        "CA_estimation_frCL_tst",
    ],
)

# --- window functions -------------------------------------------------------------------
RANK_INTS = ["session", "aid", "us"]
add(
    "w_row_number",
    lambda s, d: us(r.event_ranks(big(s, d))),
    BIG_SQL
    + """n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY us, aid, type) AS rn FROM log),
    out AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY rn DESC) AS rn_last FROM n)""",
    ints=[*RANK_INTS, "rn", "rn_last"],
    texts=["type"],
)
add(
    "w_dense_rank",
    lambda s, d: us(r.event_ranks(big(s, d))),
    BIG_SQL
    + """out AS (SELECT *, dense_rank() OVER (PARTITION BY session ORDER BY us) AS dense_ts,
         dense_rank() OVER (PARTITION BY session ORDER BY us DESC) AS dense_ts_last FROM log)""",
    ints=[*RANK_INTS, "dense_ts", "dense_ts_last"],
    texts=["type"],
)
add(
    "w_percent_rank",
    lambda s, d: us(r.event_ranks(big(s, d))),
    BIG_SQL + "out AS (SELECT *, percent_rank() OVER (PARTITION BY session ORDER BY us) AS pct FROM log)",
    ints=RANK_INTS,
    reals=["pct"],
    texts=["type"],
)


def lag_lead(s, d):
    out = in_order(us(big(s, d)), ["session"], "us", ["aid", "type"], want={"p": "prev", "n": "next"}, carry=["aid", "type"])
    return out.select("session", "aid", "us", "type", F.col("p.aid").alias("prev_aid"), F.col("p.type").alias("prev_type"), F.col("n.aid").alias("next_aid"), F.col("n.type").alias("next_type"))


add(
    "w_lag_lead",
    lag_lead,
    BIG_SQL
    + """out AS (SELECT *, lag(aid) OVER w AS prev_aid, lag(type) OVER w AS prev_type, lead(aid) OVER w AS next_aid, lead(type) OVER w AS next_type
         FROM log WINDOW w AS (PARTITION BY session ORDER BY us, aid, type))""",
    ints=[*RANK_INTS, "prev_aid", "next_aid"],
    texts=["type", "prev_type", "next_type"],
)
add(
    "w_running_sum",
    lambda s, d: se.subsessions(big(s, d)),
    BIG_SQL + SUB_SQL + "out AS (SELECT * FROM subs)",
    ints=["session", "aid", "sec", "sub", "gap"],
    texts=["type"],
)
add(
    "w_partition_agg",
    lambda s, d: us(in_order(us(big(s, d)), ["session"], "us", ["aid", "type"], want={"size": "size", "last_us": "last", "first_us": "first"})),
    BIG_SQL
    + """out AS (SELECT *, count(*) OVER (PARTITION BY session) AS size, max(us) OVER (PARTITION BY session) AS last_us,
         min(us) OVER (PARTITION BY session) AS first_us FROM log)""",
    ints=[*RANK_INTS, "size", "last_us", "first_us"],
    texts=["type"],
)


def global_agg(s, d):
    n = big(s, d).groupBy("aid").agg(F.count(F.lit(1)).alias("n"))
    return with_scalars(n, n.agg(F.avg("n").alias("mean_n"))).withColumn("vs_mean", F.col("n") / F.col("mean_n"))


add(
    "w_global_agg",
    global_agg,
    BIG_SQL + "out AS (SELECT aid, count(*) AS n, avg(count(*)) OVER () AS mean_n, count(*) / avg(count(*)) OVER () AS vs_mean FROM log GROUP BY aid)",
    ints=["aid", "n"],
    reals=["mean_n", "vs_mean"],
)


def last_items(s, d):
    log = big(s, d)
    out = r.last_item(log)
    for t in ACTIONS:
        out = out.join(r.last_item(log, t, f"last_{t}"), "session", "left")
    return out


_last = ", ".join(
    f"(SELECT aid FROM log l WHERE l.session = s.session {c} ORDER BY us DESC, aid DESC LIMIT 1) AS {n}"
    for n, c in [("last_aid", ""), *[(f"last_{t}", f"AND type = '{t}'") for t in ACTIONS]]
)
add(
    "w_last_item",
    last_items,
    BIG_SQL + f"out AS (SELECT session, {_last} FROM (SELECT DISTINCT session FROM log) s)",
    ints=["session", "last_aid", *[f"last_{t}" for t in ACTIONS]],
)


def avg_rank(s, d):
    n = big(s, d).groupBy("aid").agg(F.count(F.lit(1)).alias("n"))
    return r.average_rank(r.average_rank(n, "n", "rank_avg"), "n", "rank_pct", pct=True)


add(
    "w_avg_rank",
    avg_rank,
    BIG_SQL
    + """c AS (SELECT aid, count(*) AS n FROM log GROUP BY aid),
    out AS (SELECT *, rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS rank_avg,
            (rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2) / count(*) OVER () AS rank_pct FROM c)""",
    ints=["aid", "n"],
    reals=["rank_avg", "rank_pct"],
)
add(
    "topk_popular",
    lambda s, d: it.popular(it.item_features(big(s, d)), "orders"),
    BIG_SQL + "out AS (SELECT aid, row_number() OVER (ORDER BY count(DISTINCT session) DESC, aid) AS rn FROM log WHERE type = 'orders' GROUP BY aid ORDER BY rn LIMIT 20)",
    ints=["aid", "rn"],
)
add(
    "sort_global",
    lambda s, d: us(big(s, d)).orderBy("session", "aid", "us", "type"),
    BIG_SQL + "out AS (SELECT * FROM log ORDER BY session, aid, us, type)",
    ints=RANK_INTS,
    texts=["type"],
)


def group_stats(s, d):
    n = big(s, d).groupBy("session", "aid").agg(F.sum(F.unix_seconds("ts") % 97).cast("double").alias("x"))
    return vf.diff_to_session(n, ["x"])


add(
    "vec_group_stats",
    group_stats,
    BIG_SQL
    + """g AS (SELECT session, aid, sum(us // 1000000 % 97) AS x FROM log GROUP BY ALL),
    st AS (SELECT session, avg(x) AS a, min(x) AS mi, max(x) AS ma FROM g GROUP BY session),
    out AS (SELECT session, aid, x, x - a AS diff_avg_x, x - mi AS diff_min_x, x - ma AS diff_max_x FROM g JOIN st USING (session))""",
    ints=["session", "aid"],
    reals=["x", "diff_avg_x", "diff_min_x", "diff_max_x"],
)

# --- scalar functions -------------------------------------------------------------------
def fn_time(s, d):
    log = us(small(s, d))
    ref = times.micros(F.lit("2024-01-15 12:30:00+00:00").cast("timestamp"))
    sec = times.seconds()
    return log.select(
        "session",
        "aid",
        "us",
        times.whole_units(F.col("us"), ref).alias("diff_s"),
        times.whole_units(F.col("us"), ref, 3600).alias("diff_h"),
        times.hour_start(sec).alias("hour"),
        sec.alias("sec"),
        times.epoch_dow(sec).alias("dow"),
        times.hour_of_day(sec).alias("hod"),
    )


add(
    "fn_time",
    fn_time,
    SMALL_SQL
    + """
    k AS (SELECT *, us - epoch_us(TIMESTAMP '2024-01-15 12:30:00') AS g FROM log),
    out AS (SELECT session, aid, us, sign(g) * (abs(g) // 1000000) AS diff_s, sign(g) * (abs(g) // 3600000000) AS diff_h,
            us // 3600000000 * 3600 AS hour, us // 1000000 AS sec, us // 1000000 % 604800 // 86400 AS dow, us // 1000000 % 86400 / 3600 AS hod FROM k)""",
    ints=["session", "aid", "us", "diff_s", "diff_h", "hour", "sec", "dow"],
    reals=["hod"],
)


def fn_spine(s, d):
    span = small(s, d).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return times.hour_spine(span, "a", "b").select(F.unix_micros("ts_hour").alias("us"))


add(
    "fn_hour_spine",
    fn_spine,
    SMALL_SQL + "e AS (SELECT min(us) AS a, max(us) AS b FROM log), out AS (SELECT a + i * 3600000000 AS us FROM e, range(0, 2000) AS r(i) WHERE a + i * 3600000000 <= b)",
    ints=["us"],
)


def fn_numbers(s, d):
    n = big(s, d).groupBy("aid").agg(*[F.count_if(F.col("type") == t).alias(t) for t in ACTIONS])
    x = F.col("clicks")
    return n.select(
        "aid",
        numbers.ratio(F.col("carts"), x - 3).alias("safe"),
        numbers.open_ratio(F.col("carts"), F.col("orders")).alias("open"),
        F.pow(F.lit(2.0), F.least(x, F.lit(20)) / 10.0).alias("p"),
        F.ln(x + 1).alias("l"),
        F.sqrt(F.abs(x - 9)).alias("q"),
        F.pmod(F.col("aid"), F.lit(7)).alias("m"),
        numbers.or_else(F.when(x > 5, x), -1).alias("c"),
    )


add(
    "fn_numbers",
    fn_numbers,
    BIG_SQL
    + f"""n AS (SELECT aid, {', '.join(f"count(*) FILTER (type = '{t}') AS {t}" for t in ACTIONS)} FROM log GROUP BY aid),
    out AS (SELECT aid, carts / nullif(clicks - 3, 0) AS safe, CASE WHEN orders > 0 THEN carts / orders WHEN carts > 0 THEN 'Infinity'::DOUBLE END AS open,
            pow(2, least(clicks, 20) / 10) AS p, ln(clicks + 1) AS l, sqrt(abs(clicks - 9)) AS q, aid % 7 AS m, CASE WHEN clicks > 5 THEN clicks ELSE -1 END AS c FROM n)""",
    ints=["aid", "m", "c"],
    reals=["safe", "open", "p", "l", "q"],
)


def fn_arrays(s, d):
    lists = big(s, d).groupBy("session").agg(F.sort_array(F.collect_set("aid")).alias("aids"))
    rows = lists.select("session", "aids", F.posexplode("aids").alias("place", "aid"))
    return rows.select("session", "aid", "place", F.array_contains("aids", F.col("aid") + 1).cast("long").alias("next_in"), F.get("aids", F.lit(0)).alias("head"), F.size("aids").alias("n"))


add(
    "fn_arrays",
    fn_arrays,
    BIG_SQL
    + """l AS (SELECT session, list(DISTINCT aid ORDER BY aid) AS aids FROM log GROUP BY session),
    u AS (SELECT session, unnest(aids) AS aid, unnest(range(len(aids))) AS place, aids AS aids_ FROM l),
    """
    + "out AS (SELECT session, aid, place, CASE WHEN list_contains(aids_, aid + 1) THEN 1 ELSE 0 END AS next_in, aids_[1] AS head, len(aids_) AS n FROM u)",
    ints=["session", "aid", "place", "next_in", "head", "n"],
)


def fn_strings(s, d):
    log = small(s, d).select(F.concat_ws("_", "session", "type").alias("key"), "aid").distinct()
    lists = log.groupBy("key").agg(F.sort_array(F.collect_list("aid")).alias("aids")).withColumn("labels", joined("aids"))
    parts = F.split("key", "_")
    return lists.select("key", "labels", parts.getItem(0).cast("long").alias("session"), F.lower("key").contains("cart").cast("long").alias("is_cart"), F.size(F.split("labels", " ")).alias("n"))


add(
    "fn_strings",
    fn_strings,
    SMALL_SQL
    + """k AS (SELECT DISTINCT session || '_' || type AS key, aid FROM log),
    out AS (SELECT key, array_to_string(list(aid ORDER BY aid), ' ') AS labels, split_part(key, '_', 1)::BIGINT AS session,
            CASE WHEN contains(lower(key), 'cart') THEN 1 ELSE 0 END AS is_cart, count(*) AS n FROM k GROUP BY key)""",
    ints=["session", "is_cart", "n"],
    texts=["key", "labels"],
)
DRAW = "('0x' || substr(md5({key} || '|{seed}'), 1, 8))::BIGINT"
add(
    "fn_draw",
    lambda s, d: big(s, d)
    .select("session", "aid")
    .distinct()
    .select("session", "aid", hashing.draw("session", "aid", seed=7).alias("draw"), hashing.bucket("session", n=5, seed=7).alias("fold")),
    BIG_SQL
    + f"""k AS (SELECT DISTINCT session, aid FROM log),
    out AS (SELECT session, aid, {DRAW.format(key="session || '|' || aid", seed=7)} AS draw, {DRAW.format(key='session::VARCHAR', seed=7)} % 5 AS fold FROM k)""",
    ints=["session", "aid", "draw", "fold"],
)
