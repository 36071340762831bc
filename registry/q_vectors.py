"""Vectors, neighbours, embeddings and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import add, joined
from registry.logs import BIG_SQL, SESSION_VECTORS_SQL, SMALL_SQL, VECTORS_SQL, big, item_vectors, labels, session_vectors, small
from registry.q_features import DRAW
from registry.q_lists import scores, scores_sql
from sessionrank.functions import vectors as V
from sessionrank.operators import candidates as cd
from sessionrank.operators import dataset as ds
from sessionrank.operators import embeddings as em
from sessionrank.operators import factorise as fa
from sessionrank.operators import learn as ml
from sessionrank.operators import neighbours as nb
from sessionrank.operators import session_items as si
from sessionrank.operators import sessions as se
from sessionrank.operators import vector_features as vf
from sessionrank.settings import stage


def item_pairs(s, d):
    """Distinct item steps of the small log with both vectors."""
    v = item_vectors(s, d)
    e = em.edges(small(s, d))
    return e.join(v.select(F.col("aid").alias("lag_aid"), F.col("vector").alias("a")), "lag_aid").join(v.select("aid", F.col("vector").alias("b")), "aid")


EDGES_SQL = """
steps AS (SELECT lag(aid) OVER (PARTITION BY session ORDER BY us, aid, type) AS lag_aid, aid FROM log),
edges AS (SELECT DISTINCT lag_aid, aid FROM steps WHERE lag_aid IS NOT NULL),
"""
STEP_VEC_SQL = SMALL_SQL + VECTORS_SQL + EDGES_SQL + "ab AS (SELECT lag_aid, edges.aid, x.vector AS a, y.vector AS b FROM edges JOIN vec x ON x.aid = lag_aid JOIN vec y ON y.aid = edges.aid),"
add(
    "vec_dot",
    lambda s, d: item_pairs(s, d).select("lag_aid", "aid", V.dot("a", "b").alias("x")),
    STEP_VEC_SQL + "out AS (SELECT lag_aid, aid, list_dot_product(a, b) AS x FROM ab)",
    ints=["lag_aid", "aid"],
    reals=["x"],
)
add(
    "vec_l2",
    lambda s, d: item_pairs(s, d).select("lag_aid", "aid", V.l2("a", "b").alias("x")),
    STEP_VEC_SQL + "out AS (SELECT lag_aid, aid, list_distance(a, b) AS x FROM ab)",
    ints=["lag_aid", "aid"],
    reals=["x"],
)


def target_pairs(s, d):
    return small(s, d).where("split <> 'train'").select("session", "aid").distinct()


LAST_SQL = """
pairs AS (SELECT DISTINCT session, aid FROM log WHERE split <> 'train'),
last AS (SELECT session, aid AS last_aid FROM log {where} QUALIFY row_number() OVER (PARTITION BY session ORDER BY us DESC, aid DESC) = 1),
uv AS (SELECT pairs.session, pairs.aid, v.vector AS v, u.vector AS u FROM pairs LEFT JOIN last USING (session)
       LEFT JOIN vec v ON v.aid = pairs.aid LEFT JOIN vec u ON u.aid = last_aid),
"""
add(
    "vec_cos_diff",
    lambda s, d: vf.last_item_angle(target_pairs(s, d), small(s, d), item_vectors(s, d), "m"),
    SMALL_SQL
    + VECTORS_SQL
    + LAST_SQL.format(where="")
    + "out AS (SELECT session, aid, pow(list_distance(v, u), 2) AS emb_diff_m, list_cosine_similarity(v, u) AS emb_angle_m FROM uv)",
    ints=["session", "aid"],
    reals=["emb_diff_m", "emb_angle_m"],
)
for _name, _type, _head in (("vec_last_feature", None, "w2v"), ("vec_last_cart_feature", "carts", "last_cart_w2v"), ("vec_last_order_feature", "orders", "last_order_w2v")):
    _c, _l = f"{_head}_cosine_similarity", f"{_head}_l2_distance"
    _stats = ", ".join(f"{x} - {fn}({x}) OVER (PARTITION BY session) AS diff_{fn}_{x}" for x in (_c, _l) for fn in ("avg", "min", "max"))
    add(
        _name,
        lambda s, d, t=_type: vf.last_item_distance(target_pairs(s, d), small(s, d), item_vectors(s, d), "w2v", t),
        SMALL_SQL
        + VECTORS_SQL
        + LAST_SQL.format(where=f"WHERE type = '{_type}'" if _type else "")
        + f"x AS (SELECT session, aid, list_dot_product(v, u) AS {_c}, list_distance(v, u) AS {_l} FROM uv), out AS (SELECT *, {_stats} FROM x)",
        ints=["session", "aid"],
        reals=[_c, _l, *[f"diff_{fn}_{x}" for x in (_c, _l) for fn in ("avg", "min", "max")]],
    )


def bpr(s, d):
    users = session_vectors(s, d)
    items = item_vectors(s, d).withColumnRenamed("vector", "aid_vector")
    return vf.user_item_dot(target_pairs(s, d), users, items, zero_missing=True)


add(
    "vec_user_item",
    bpr,
    SMALL_SQL
    + VECTORS_SQL
    + SESSION_VECTORS_SQL
    + """
    x AS (SELECT p.session, p.aid, coalesce(list_dot_product(session_vector, vector), 0) AS b FROM (SELECT DISTINCT session, aid FROM log WHERE split <> 'train') p
          LEFT JOIN svec USING (session) LEFT JOIN vec USING (aid)),
    out AS (SELECT session, aid, b AS bpr_distance, b - avg(b) OVER w AS diff_avg_bpr_distance, b - min(b) OVER w AS diff_min_bpr_distance,
            b - max(b) OVER w AS diff_max_bpr_distance FROM x WINDOW w AS (PARTITION BY session))""",
    ints=["session", "aid"],
    reals=["bpr_distance", "diff_avg_bpr_distance", "diff_min_bpr_distance", "diff_max_bpr_distance"],
)

# --- neighbours -------------------------------------------------------------------------
def neighbour_rows(df, key):
    return cd.explode_neighbours(df, key)


def knn_sql(queries: str, key: str, k: int, items: str = "vec") -> str:
    """Neighbours by brute force; similarities below the last kept digit are equal."""
    return f"""
    sims AS (SELECT q.k, i.aid, round(list_dot_product(q.v, i.vector), 12) AS similarity FROM ({queries}) q, {items} i),
    near AS (SELECT k AS {key}, aid, similarity, row_number() OVER (PARTITION BY k ORDER BY similarity DESC, aid) - 1 AS place FROM sims QUALIFY place < {k}),
    """


add(
    "knn_items",
    lambda s, d: neighbour_rows(nb.knn(item_vectors(s, d).withColumnRenamed("aid", "q"), item_vectors(s, d), 50, key="q"), "q"),
    VECTORS_SQL + knn_sql("SELECT aid AS k, vector AS v FROM vec", "q", 50) + "out AS (SELECT * FROM near)",
    ints=["q", "aid", "place"],
    reals=["similarity"],
)
add(
    "knn_users",
    lambda s, d: neighbour_rows(nb.knn(session_vectors(s, d), item_vectors(s, d), 50, key="session", query_vec="session_vector"), "session"),
    SMALL_SQL
    + VECTORS_SQL
    + SESSION_VECTORS_SQL
    + knn_sql("SELECT session AS k, list_transform(session_vector, lambda x: x / sqrt(list_dot_product(session_vector, session_vector))) AS v FROM svec", "session", 50)
    + "out AS (SELECT * FROM near)",
    ints=["session", "aid", "place"],
    reals=["similarity"],
)

def found_by_lists(s, d):
    """How many neighbours each item gets, and whether its own are what the exact way says in nine of ten places over all."""
    v = item_vectors(s, d)
    q = v.withColumnRenamed("aid", "q")
    found, exact = nb.knn(q, v, 50, key="q", method="ivf"), nb.knn(q, v, 50, key="q")
    good = int(nb.recall_of(found, exact, "q") >= 0.9)
    return found.select("q", F.size("neighbor_aids").alias("n"), F.get("neighbor_aids", F.lit(0)).alias("nearest"), F.lit(good).alias("good"))


# what is determined of approximate neighbours: their number, the item itself, and the recall
add(
    "knn_items_ivf",
    found_by_lists,
    VECTORS_SQL
    + knn_sql("SELECT aid AS k, vector AS v FROM vec", "q", 50)
    + "out AS (SELECT q, count(*) AS n, any_value(aid) FILTER (place = 0) AS nearest, 1 AS good FROM near GROUP BY q)",
    ints=["q", "n", "nearest", "good"],
)


def item_neighbours(s, d):
    return nb.knn(item_vectors(s, d), item_vectors(s, d), 50)


# at the method's limit, and at one that many pairs of the given vectors reach
for _name, _least in (("cand_w2v", 0.85), ("cand_w2v_wide", 0.3)):
    add(
        _name,
        lambda s, d, x=_least: cd.neighbour_candidates(small(s, d), item_neighbours(s, d), x),
        SMALL_SQL
        + VECTORS_SQL
        + knn_sql("SELECT aid AS k, vector AS v FROM vec", "start", 50)
        + f"""
        ends AS (SELECT session, type, aid AS start FROM log QUALIFY row_number() OVER (PARTITION BY session, type ORDER BY us DESC, aid DESC) = 1),
        found AS (SELECT session, type, near.aid, similarity FROM ends JOIN near USING (start) WHERE near.aid <> start),
        wide AS (SELECT session, aid, max(similarity) FILTER (type = 'clicks') AS last_click_cosine_similarity, max(similarity) FILTER (type = 'carts') AS last_cart_cosine_similarity,
                 max(similarity) FILTER (type = 'orders') AS last_order_cosine_similarity FROM found GROUP BY session, aid),
        out AS (SELECT * FROM wide WHERE last_click_cosine_similarity >= {_least} OR last_cart_cosine_similarity >= {_least} OR last_order_cosine_similarity >= {_least})""",
        ints=["session", "aid"],
        reals=["last_click_cosine_similarity", "last_cart_cosine_similarity", "last_order_cosine_similarity"],
    )
add(
    "cand_mf",
    lambda s, d: cd.explode_neighbours(nb.knn(session_vectors(s, d), item_vectors(s, d), 50, key="session", query_vec="session_vector")).select("session", "aid"),
    SMALL_SQL
    + VECTORS_SQL
    + SESSION_VECTORS_SQL
    + knn_sql("SELECT session AS k, list_transform(session_vector, lambda x: x / sqrt(list_dot_product(session_vector, session_vector))) AS v FROM svec", "session", 50)
    + "out AS (SELECT * FROM near)",
    ints=["session", "aid"],
)

# --- embeddings -------------------------------------------------------------------------
add(
    "emb_sentences",
    lambda s, d: em.sentences(big(s, d), max_len=20).select("session", "part", joined("items").alias("items")),
    BIG_SQL
    + """
    sized AS (SELECT * FROM log WHERE session IN (SELECT session FROM log GROUP BY session HAVING count(*) > 1)),
    seen AS (SELECT *, lag(aid) OVER (PARTITION BY session ORDER BY us, aid, type) AS before FROM sized),
    kept AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY us, aid, type) - 1 AS p FROM seen WHERE before IS DISTINCT FROM aid),
    out AS (SELECT session, p // 20 AS part, array_to_string(list(aid ORDER BY p), ' ') AS items FROM kept GROUP BY session, p // 20)""",
    ints=["session", "part"],
    texts=["items"],
)
add("emb_edges", lambda s, d: em.edges(big(s, d)), BIG_SQL + EDGES_SQL + "out AS (SELECT * FROM edges)", ints=["lag_aid", "aid"])
_walk_draw = DRAW.format(key="start || '|' || walk || '|' || step", seed=11)
WALKS_SQL = f"""
    num AS (SELECT lag_aid AS node, aid AS next, row_number() OVER (PARTITION BY lag_aid ORDER BY aid) - 1 AS number FROM edges),
    deg AS (SELECT node, count(*) AS degree FROM num GROUP BY node),
    paths AS (
      WITH RECURSIVE go AS (
        SELECT node AS start, walk, 1 AS step, node, [node] AS items FROM deg, range(0, 10) AS r(walk)
        UNION ALL
        SELECT start, walk, step + 1, num.next, list_append(items, num.next) FROM go JOIN deg USING (node)
        JOIN num ON num.node = go.node AND num.number = {_walk_draw} % degree WHERE step < 20
      ) SELECT * FROM go),
"""
add(
    "emb_walks",
    lambda s, d: em.random_walks(em.edges(small(s, d)), 20, 10, 11).select("start", "walk", joined("items").alias("items")),
    SMALL_SQL
    + EDGES_SQL
    + WALKS_SQL
    + "out AS (SELECT start, walk, array_to_string(arg_max(items, step), ' ') AS items FROM paths GROUP BY start, walk)",
    ints=["start", "walk"],
    texts=["items"],
)
KEPT_SQL = """
sized AS (SELECT * FROM log WHERE session IN (SELECT session FROM log GROUP BY session HAVING count(*) > 1)),
seen AS (SELECT *, lag(aid) OVER (PARTITION BY session ORDER BY us, aid, type) AS before FROM sized),
kept AS (SELECT * FROM seen WHERE before IS DISTINCT FROM aid),
often AS (SELECT aid FROM kept GROUP BY aid HAVING count(*) >= 5),
"""
for _name, _method in (("emb_word2vec", "skipgram"), ("emb_factors", "factors")):
    # what is determined: which items have a vector, of length 1
    add(
        _name,
        lambda s, d, m=_method: em.item2vec(em.sentences(small(s, d), overlap=5), 64, 5, 5, seed=1, iterations=em.SESSION_PASSES, all_items=small(s, d), method=m).select(
            "aid", V.norm("vector").alias("norm")
        ),
        SMALL_SQL + KEPT_SQL + "out AS (SELECT DISTINCT aid, CASE WHEN aid IN (SELECT aid FROM often) THEN 1 ELSE 0 END AS norm FROM log)",
        ints=["aid"],
        reals=["norm"],
    )


def node2vec(s, d):
    walks = em.random_walks(em.edges(small(s, d)), 20, 10, 11)
    # a node and the nine that follow it, one uniform noise node each
    v = em.item2vec(walks, 128, 9, 1, seed=1, iterations=em.WALK_PASSES, negatives=1, exponent=em.WALK_NOISE, sample=0, shrink=False)
    return v.select("aid", V.norm("vector").alias("norm"))


add(
    "emb_node2vec",
    node2vec,
    SMALL_SQL + EDGES_SQL + WALKS_SQL + "out AS (SELECT DISTINCT node AS aid, 1 AS norm FROM paths)",
    ints=["aid"],
    reals=["norm"],
)


def sents_of(s, d):
    return stage(em.sentences(small(s, d), overlap=5).select("items", F.monotonically_increasing_id().alias("sent")))


PAIRS_SQL = (
    SMALL_SQL
    + KEPT_SQL
    + f"""
    many AS (SELECT aid, count(*) AS n, {em.SAMPLE} * (SELECT count(*) FROM kept WHERE aid IN (SELECT aid FROM often)) / count(*) AS q
             FROM kept WHERE aid IN (SELECT aid FROM often) GROUP BY aid),
    many2 AS (SELECT *, least(1.0, sqrt(q) + q) AS keep, CAST(greatest(1, round(1e6 * pow(n, {em.SESSION_NOISE}))) AS BIGINT) AS noise FROM many),
    pos AS (SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY us, aid, type) AS p FROM kept WHERE aid IN (SELECT aid FROM often)),
    near AS (SELECT a.aid AS x, b.aid AS y, (6 - (b.p - a.p)) / 5.0 AS w FROM pos a JOIN pos b ON a.session = b.session AND b.p BETWEEN a.p + 1 AND a.p + 5),
    both_ways AS (SELECT x AS aid_x, y AS aid_y, w FROM near UNION ALL SELECT y, x, w FROM near),
    pairs AS (SELECT aid_x, aid_y, sum(w) * any_value(a.keep) * any_value(b.keep) AS w FROM both_ways JOIN many2 a ON a.aid = aid_x JOIN many2 b ON b.aid = aid_y GROUP BY ALL),
    """
)
add("emb_skipgram_pairs", lambda s, d: em.skipgram_pairs(sents_of(s, d)), PAIRS_SQL + "out AS (SELECT * FROM pairs)", ints=["aid_x", "aid_y"], reals=["w"])


def noise_sql(pairs: str, left: str, right: str, weights: str, turn: int, seed: int) -> str:
    """The noise item of each pair, from the running sum of the weights of the right ids."""
    return f"""
    ln AS (SELECT {left}, row_number() OVER (ORDER BY {DRAW.format(key=left + '::VARCHAR', seed=0)}, {left}) - 1 AS l FROM (SELECT DISTINCT {left} FROM {pairs})),
    rn AS (SELECT {right}, row_number() OVER (ORDER BY {DRAW.format(key=right + '::VARCHAR', seed=0)}, {right}) - 1 AS r FROM (SELECT DISTINCT {right} FROM {pairs})),
    upto AS (SELECT {right} AS other, r AS o, coalesce(sum(w) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
                    sum(w) OVER (ORDER BY r) AS hi, sum(w) OVER () AS total FROM rn JOIN ({weights}) w USING ({right})),
    fell AS (SELECT {left}, {right}, floor(CAST({fa.mixed_sql('l', 'r', str(turn), seed)} AS DOUBLE) / CAST(4294967296 AS DOUBLE) * CAST((SELECT max(total) FROM upto) AS DOUBLE)) AS u
           FROM {pairs} JOIN ln USING ({left}) JOIN rn USING ({right})),
    noise AS (SELECT {left}, {right}, other FROM fell JOIN upto ON u >= lo AND u < hi),
    """


def skipgram_noise(s, d):
    sents = sents_of(s, d)
    return fa.drawn_noise(em.skipgram_pairs(sents), "aid_x", "aid_y", em.noise_weights(sents).withColumnRenamed("aid", "aid_y"), 3, 1)


add(
    "emb_skipgram_noise",
    skipgram_noise,
    PAIRS_SQL + noise_sql("pairs", "aid_x", "aid_y", "SELECT aid AS aid_y, noise AS w FROM many2", 3, 1) + "out AS (SELECT * FROM noise)",
    ints=["aid_x", "aid_y", "other"],
)
CONTACTS_SQL = SMALL_SQL + "contacts AS (SELECT DISTINCT session, aid FROM log),"
add(
    "emb_bpr_triples",
    lambda s, d: fa.drawn_noise(stage(em.contacts(small(s, d))), "session", "aid", em.popularity(small(s, d)), 0, 1, unseen=True),
    CONTACTS_SQL
    + noise_sql("contacts", "session", "aid", "SELECT aid, count(*) AS w FROM contacts GROUP BY aid", 0, 1)
    + "out AS (SELECT n.* FROM noise n ANTI JOIN contacts c ON c.session = n.session AND c.aid = n.other)",
    ints=["session", "aid", "other"],
)


def factors(learn):
    def run(s, d):
        users, items = learn(small(s, d), seed=1)
        out = vf.user_item_dot(target_pairs(s, d), users, items)
        return out.withColumn("known", F.col("bpr_distance").isNotNull().cast("long"))

    return run


# which pairs have both vectors; the draws they are learned from are in emb_bpr_triples
for _name, _learn in (("emb_mf", em.ranking_factors), ("emb_als", em.implicit_factors)):
    add(_name, factors(_learn), SMALL_SQL + "out AS (SELECT DISTINCT session, aid, 1 AS known FROM log WHERE split <> 'train')", ints=["session", "aid", "known"])

# --- learning ---------------------------------------------------------------------------
FEATURES = ["visit_count_clicks", "visit_count_carts", "visit_count_orders", "max_seconds_to_latest", "pred_clicks", "pred_carts", "session_size"]


def train_set(s, d):
    log = small(s, d)
    base = ds.add_label_flags(scores(s, d), labels(s, d))
    x = si.session_item_features(log)
    return stage(ds.add_fold(base.join(x, ["session", "aid"]).join(se.session_features(log), "session"), 5, 3))


def cross(s, d, label="carts_gt"):
    data = train_set(s, d)
    return data, *ml.cross_fit(data, FEATURES, label)


# What is determined of a learned score: its rows and folds, and that it is a probability.
def is_share():
    return F.col("pred").between(0, 1).cast("long").alias("valid")


FOLD_SQL = SMALL_SQL + scores_sql() + f"out AS (SELECT session, aid, {DRAW.format(key='session::VARCHAR', seed=3)} % 5 AS fold, 1 AS valid FROM score0)"
LEARNED = dict(ints=["session", "aid", "fold", "valid"])


def with_fold(data, scored):
    return scored.join(data.select("session", "aid", "fold"), ["session", "aid"]).select("session", "aid", "fold", is_share())


def cv(s, d):
    data, _, oof = cross(s, d)
    return with_fold(data, oof)


add("ml_cv_gbt", cv, FOLD_SQL, **LEARNED)


def full_fit(s, d):
    data = train_set(s, d)
    return ml.predict_mean([ml.fit_all(data, FEATURES, "clicks_gt")], data, FEATURES).select("session", "aid", "fold", is_share())


add("ml_full_fit", full_fit, FOLD_SQL, **LEARNED)


def chain(s, d):
    data, _, oof = cross(s, d)
    more = ml.add_oof(data, oof, "carts_pred")
    _, second = ml.cross_fit(more, [*FEATURES, "carts_pred"], "orders_gt")
    return with_fold(data, second)


add("ml_chain", chain, FOLD_SQL, **LEARNED)


def mean_of_folds(s, d):
    data, models, _ = cross(s, d)
    return ml.predict_mean(models, data, FEATURES).select("session", "aid", "fold", is_share())


add("ml_predict_mean", mean_of_folds, FOLD_SQL, **LEARNED)


def importance(s, d):
    _, models, _ = cross(s, d)
    table = ml.importances(s, models, FEATURES)
    total = table.agg(F.sum("mean").alias("total")).scalar().alias("total")
    return table.select("feature", total, ((F.col("mean") >= 0) & (F.col("std") >= 0)).cast("long").alias("valid"))


_rows = ", ".join(f"('{f}')" for f in FEATURES)
add("ml_importance", importance, f"out AS (SELECT feature, 1.0 AS total, 1 AS valid FROM (VALUES {_rows}) t(feature))", ints=["valid"], reals=["total"], texts=["feature"])
