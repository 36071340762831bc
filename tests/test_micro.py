"""Hand-made rows for the edge cases: gaps, ties, single events, absent actions, missing vectors."""

import math

import pytest
from pyspark.sql import functions as F

from sessionrank.operators import candidates as cd
from sessionrank.operators import covisit as cv
from sessionrank.operators import dataset as ds
from sessionrank.operators import evaluate as ev
from sessionrank.operators import filters as f
from sessionrank.operators import items as it
from sessionrank.operators import lists as ls
from sessionrank.operators import neighbours as nb
from sessionrank.operators import pairs as p
from sessionrank.operators import ranks as r
from sessionrank.operators import sessions as se
from sessionrank.operators import stacking as st
from sessionrank.operators import vector_features as vf
from sessionrank.sources.labels import wide_ground_truth


def log(spark, rows):
    """Rows of (session, aid, second, type[, split])."""
    full = [(r + ("valid",))[:5] for r in rows]
    df = spark.createDataFrame(full, "session long, aid long, s long, type string, split string")
    return df.select("session", "aid", F.timestamp_seconds("s").alias("ts"), "type", "split")


def pairs_of(df):
    return {(r["aid_x"], r["aid_y"]) for r in df.collect()}


@pytest.mark.parametrize("gap,met", [(3599, True), (3600, False)])
def test_second_gap_is_strict(spark, gap, met):
    e = log(spark, [(1, 10, 100, "clicks"), (1, 20, 100 + gap, "clicks")])
    assert pairs_of(p.pairs_time(e, 3600, "SECOND", True)) == ({(10, 20), (20, 10)} if met else set())


@pytest.mark.parametrize("gap,met", [(24 * 3600 + 3599, True), (25 * 3600, False)])
def test_hour_gap_counts_whole_hours(spark, gap, met):
    e = log(spark, [(1, 10, 50, "clicks"), (1, 20, 50 + gap, "carts")])
    got = p.pairs_time(e, 24, "HOUR", False, keep_type=True).collect()
    assert {(r["aid_x"], r["aid_y"], r["type"]) for r in got} == ({(10, 20, "carts"), (20, 10, "clicks")} if met else set())


def test_pairs_need_two_events_not_two_items(spark):
    once = log(spark, [(1, 10, 0, "clicks"), (1, 20, 9, "clicks")])
    twice = log(spark, [(1, 10, 0, "clicks"), (1, 10, 9, "carts")])
    assert (10, 10) not in pairs_of(p.pairs_time(once))
    got = {(r["aid_x"], r["aid_y"], r["type"]) for r in p.pairs_time(twice, keep_type=True).collect()}
    assert got == {(10, 10, "clicks"), (10, 10, "carts")}


def test_single_event_session(spark):
    e = log(spark, [(1, 10, 5, "clicks")])
    assert p.pair_flags(e).isEmpty() and p.window_flags(e).isEmpty() and p.transitions(e).isEmpty()
    row = r.event_ranks(e).first()
    assert (row["rn"], row["rn_last"], row["pct"]) == (1, 1, 0.0)
    assert it.item_repeat(e).first()["stddev_repeat_count"] is None
    assert se.subsession_features(e).first()["session_click_diff_mean"] == -1.0


@pytest.mark.parametrize("gap,parts", [(7199, 1), (7200, 1), (7201, 2)])
def test_subsession_gap(spark, gap, parts):
    e = log(spark, [(1, 10, 0, "clicks"), (1, 20, gap, "clicks")])
    assert se.subsession_features(e).first()["session_real_num"] == parts


def test_equal_times_do_not_pair_by_dense_rank(spark):
    e = log(spark, [(1, 10, 0, "clicks"), (1, 20, 0, "clicks"), (1, 30, 5, "clicks")])
    assert (10, 20) not in pairs_of(p.window_flags(e, 2, "dense_rank"))
    assert (10, 20) in pairs_of(p.window_flags(e, 2, "row_number"))


def test_absent_actions(spark):
    e = log(spark, [(1, 10, 0, "clicks"), (2, 10, 0, "clicks"), (1, 20, 1, "orders"), (2, 20, 1, "orders")])
    counts = {(r["aid_x"], r["aid_y"]): r for r in p.pair_type_counts(p.pair_flags(e)).collect()}
    assert counts[(10, 20)]["count_clicks"] == 0 and counts[(10, 20)]["count_orders"] == 2
    items = {r["aid"]: r for r in it.item_features(e).collect()}
    assert items[10]["n_session_carts"] is None and items[10]["n_session_cvr_click_to_cart"] is None
    ratios = {r["aid"]: r for r in it.item_ratios(e, e).collect()}
    assert ratios[20]["aid_CL2OR_trn"] == math.inf and ratios[10]["aid_CA2OR_trn"] == -1.0


def test_dedup_and_repeat(spark):
    e = log(spark, [(1, 5, 0, "clicks"), (1, 5, 1, "clicks"), (1, 5, 2, "carts"), (1, 6, 3, "clicks"), (1, 5, 4, "orders")])
    kept = [r["aid"] for r in f.dedup_consecutive(e).orderBy("ts").collect()]
    assert kept == [5, 6, 5]
    probs = {r["aid"]: r for r in it.item_type_transitions(e).collect()}
    # groups of item 5: none->clicks 1, clicks->clicks 1, clicks->carts 1, carts->orders 1; item 6: none->clicks 1
    assert probs[5]["transition_prob_clicks_carts"] == pytest.approx(1 / (2 + 1))
    assert probs[5]["transition_prob_orders_clicks"] is None


def test_labels_null_empty_and_long(spark):
    labels = spark.createDataFrame(
        [(1, "clicks", [7]), (1, "carts", []), (2, "carts", list(range(30)))], "session long, type string, ground_truth array<long>"
    )
    truth = wide_ground_truth(labels)
    pred = spark.createDataFrame(
        [(1, [7], [7], None), (2, [1], list(range(25)), [1])],
        "session long, click_pred array<long>, cart_pred array<long>, order_pred array<long>",
    )
    got = ev.recall_lists(pred, truth).first()
    assert (got["click_hits"], got["click_labels"]) == (1, 1)
    assert (got["cart_hits"], got["cart_labels"]) == (20, 20)
    assert (got["order_hits"], got["order_labels"]) == (0, 0)
    rows = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "session long, aid long")
    flags = {r["session"]: r for r in ds.add_labels(rows, truth).collect()}
    assert flags[1]["click_label"] == 1 and flags[1]["cart_label"] == 0 and flags[3]["order_label"] == 0
    assert flags[2]["cart_label"] == 1


def test_missing_and_zero_vectors(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "aid long, vector array<double>")
    e = log(spark, [(9, 1, 0, "clicks")])
    pairs = spark.createDataFrame([(9, 1), (9, 2), (9, 3), (9, 4)], "session long, aid long")
    got = {r["aid"]: r for r in vf.last_item_angle(pairs, e, vec, "m").collect()}
    assert got[1]["emb_angle_m"] == 1.0 and got[2]["emb_diff_m"] == 2.0
    assert got[3]["emb_angle_m"] is None and got[4]["emb_diff_m"] is None
    users = spark.createDataFrame([(9, [1.0, 1.0])], "session long, session_vector array<double>")
    dots = {
        r["aid"]: r["bpr_distance"]
        for r in vf.user_item_dot(pairs, users, vec.withColumnRenamed("vector", "aid_vector"), zero_missing=True).collect()
    }
    assert dots == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0}
    near = nb.knn(vec, vec, 5).collect()
    assert {r["aid"] for r in near} == {1, 2} and all(len(r["neighbor_aids"]) == 2 for r in near)


def test_knn_grid_equals_one_cell(spark, sf_dir):
    from registry.logs import item_vectors

    v = item_vectors(spark, sf_dir)
    one, grid = nb.knn(v, v, 7), nb.knn(v, v, 7, cell_rows=60)
    assert one.exceptAll(grid).isEmpty() and one.count() == grid.count() == v.count()


def test_blend_defaults_and_padding(spark):
    a = spark.createDataFrame([("1_clicks", "5 6")], "session_type string, labels string")
    b = spark.createDataFrame([("1_clicks", "6 7")], "session_type string, labels string")
    row = st.blend({"a": a, "b": b}, {"a": 2, "b": 1}).first()
    assert row["aids"] == [5, 6, 7]
    assert row["scores"] == pytest.approx([(2 + 1 / 50) / 2, (2 / 2 + 1) / 2, (2 / 50 + 1 / 2) / 2])
    top = spark.createDataFrame([(6, 1), (8, 2), (9, 3)], "aid long, rn int")
    lists = spark.createDataFrame([(1, [5, 6])], "session long, aids array<long>")
    assert ls.pad_lists(lists, top, 4).first()["aids"] == [5, 6, 6, 8]
    assert ls.pad_lists(lists, top, 4, dedupe=True).first()["aids"] == [5, 6, 8, 9]


def test_history_is_always_a_candidate(spark):
    e = log(spark, [(1, 10, 0, "clicks"), (2, 11, 0, "clicks", "train")])
    got = cd.union_candidates(e, [spark.createDataFrame([(1, 12), (2, 13)], "session long, aid long")]).collect()
    assert {(r["session"], r["aid"], r["split"]) for r in got} == {(1, 10, "valid"), (1, 12, "valid")}


def test_top_neighbours_needs_support_and_place(spark):
    counts = spark.createDataFrame(
        [(1, i, 10 - i, 0, 1 if i == 9 else 0) for i in range(2, 10)], "aid_x long, aid_y long, count_clicks long, count_carts long, count_orders long"
    )
    best = cv.top_neighbours(cv.pair_cvr(counts), cv.COUNTS, 3)
    assert {r["aid_y"] for r in best.collect()} == {2, 3, 4}


def test_scores_beyond_the_cut_are_kept(spark):
    """An item first in one list and third in another keeps both scores at k = 2."""
    rows = [(1, [10, 20, 30], [3.0, 2.0, 1.0], [40, 50, 10], [6.0, 5.0, 4.0], None, None)]
    kind = "session long, click_pred array<long>, click_pred_score array<double>, cart_pred array<long>, cart_pred_score array<double>, order_pred array<long>, order_pred_score array<double>"
    got = {r["aid"]: r for r in st.unpack_lists(spark.createDataFrame(rows, kind), "m", 2).collect()}
    assert set(got) == {10, 20, 40, 50}
    assert (got[10]["pred_carts"], got[10]["carts_rank"], got[10]["clicks_rank"]) == (4.0, 3, 1)


def test_missing_session_vectors_count_as_zeros(spark):
    pairs = spark.createDataFrame([(1, 10), (2, 10)], "session long, aid long")
    users = spark.createDataFrame([(1, [1.0, 0.0])], "session long, session_vector array<double>")
    items = spark.createDataFrame([(10, [0.5, 0.5])], "aid long, aid_vector array<double>")
    got = {r["session"]: r["bpr_distance"] for r in vf.user_item_dot(pairs, users, items, zero_missing=True).collect()}
    assert got == {1: 0.5, 2: 0.0}


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    from sessionrank.settings import shared_dir

    none = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(applicationId="a", master="spark://host:7077", getConf=lambda: none)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=none, sparkContext=context))


def test_parts_of_a_long_session_overlap(spark):
    from sessionrank.operators import embeddings as em

    e = log(spark, [(1, i, i, "clicks") for i in range(25)])
    parts = {r["part"]: r["items"] for r in em.sentences(e, max_len=10, overlap=3).collect()}
    assert parts == {0: list(range(13)), 1: list(range(10, 23)), 2: list(range(20, 25))}
    counts = em.context_counts(em.sentences(e, max_len=10, overlap=3), 3, 10).collect()
    assert {(r["aid_x"], r["aid_y"]): r["n"] for r in counts} == {(a, b): 1 for a in range(25) for b in range(25) if 0 < abs(a - b) <= 3}


@pytest.mark.parametrize("method", ["skipgram", "factors"])
def test_item_vectors_tell_groups_apart(spark, method):
    import random

    from sessionrank.operators import embeddings as em

    random.seed(3)
    rows = [(s, [random.randrange(10) + 100 * (s % 2) for _ in range(12)]) for s in range(400)]
    sents = spark.createDataFrame(rows, "session long, items array<long>")
    v = {r["aid"]: r["vector"] for r in em.item2vec(sents, 8, 5, 1, seed=2, iterations=5, method=method).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
    same = [dot(a, b) for a in range(10) for b in range(10) if a != b]
    other = [dot(a, 100 + b) for a in range(10) for b in range(10)]
    assert sum(same) / len(same) > sum(other) / len(other) + 0.3
