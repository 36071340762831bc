"""What must stay bounded on larger tables: broadcasts, cells, tasks, samples."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from sessionrank.operators import neighbours as nb
from sessionrank.operators import pairs as p


def events(spark, sessions=30, items=12):
    rows = [(s, a, 1_700_000_000 + 60 * a + s, "clicks", "valid") for s in range(sessions) for a in range(items)]
    df = spark.createDataFrame(rows, "session long, aid long, sec long, type string, split string")
    return df.selectExpr("session", "aid", "timestamp_seconds(sec) AS ts", "type", "split")


@pytest.mark.parametrize("make", [p.pair_flags, p.window_flags, lambda e: p.window_flags(e, 2, "dense_rank")])
def test_pairs_of_small_files_are_not_broadcast(spark, make):
    met = make(events(spark))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[session#\d+L, (cell|at)#", plan)
    assert met.count()


def test_neighbours_of_many_equal_and_near_vectors(monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 24))
    v[100:400] = v[7]  # more copies than neighbours, over several chunks
    v[500:600] = v[8] + 1e-9 * rng.normal(size=(100, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = rng.permutation(900)
    monkeypatch.setattr(nb, "CHUNK_ITEMS", 130)
    monkeypatch.setattr(nb, "CHUNK_QUERIES", 70)
    monkeypatch.setattr(nb, "CHUNK_PAIRS", 50)
    table = pa.table({"k": ids, "v": pa.ListArray.from_arrays(np.arange(0, v.size + 1, 24, dtype=np.int32), v.ravel())})
    found = nb.best_matches(20)(table, table).to_pandas()
    sims = np.round(v @ v.T, 12)
    for n, key in enumerate(ids):
        own = found[found["key"] == key]
        best = np.lexsort((ids, -sims[n]))[:20]
        assert abs(np.sort(own["similarity"])[::-1] - sims[n][best]).max() < 3e-12
        sure = {ids[i] for i in best if sims[n][i] > sims[n][best[-1]] + 1e-11}
        assert sure <= set(own["aid"]) and len(set(own["aid"])) == 20


def test_a_hundred_thousand_vectors_are_several_cells():
    assert nb.CELL_ROWS <= 100_000


def test_a_task_orders_a_bounded_number_of_rows(spark, monkeypatch):
    from sessionrank.operators import order

    ev = events(spark, sessions=100)
    want = {"n": "pos", "back": "rdense", "last": "last"}
    plain = order.in_order(order.with_micros(ev), ["session"], "us", order.EVENT_TIES, want=want)
    monkeypatch.setattr(order, "TASK_ROWS", 50)
    dealt = order.in_order(order.with_micros(ev), ["session"], "us", order.EVENT_TIES, want=want)
    assert dealt.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, 1200 // 50)
    assert sorted(plain.collect()) == sorted(dealt.collect())


def test_two_items_travel_as_one_row(spark):
    met = p.window_flags(events(spark), 2, "row_number")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(session#\d+L, _lo#\d+L, _hi#\d+L", plan)
    rows = {(r["session"], r["aid_x"], r["aid_y"]) for r in met.collect()}
    assert rows == {(s, a, b) for s in range(30) for a in range(12) for b in range(12) if 0 < abs(a - b) <= 2}


def test_quality_learns_from_all_labels(spark):
    from pyspark.sql import functions as F

    from sessionrank.llm import common, quality

    ids = spark.range(10_300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = ids.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert common.labelled(ids, labels, "quality").count() == 10_300
    seen = []
    whole = quality.labelled
    quality.labelled = lambda *a: seen.append(whole(*a)) or seen[0]
    try:
        quality.scored(ids.limit(1), ids, labels)
    finally:
        quality.labelled = whole
    assert seen[0].count() == 10_300


def test_lists_of_neighbours_meet_sessions_and_no_neighbour_is_shuffled(spark, monkeypatch):
    from sessionrank.operators import covisit as cv

    ev = events(spark)
    rows = [(x, y, 1 + (x * y) % 7) for x in range(10) for y in range(x + 2)] + [(3, None, 4), (None, 3, 9)]
    weights = spark.createDataFrame(rows, "aid_x long, aid_y long, weight long")

    def found():
        return cv.weighted_covisit_features(ev, weights, "w", k=4)

    plan = found()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate inline")]
    sums = {}
    for s in range(30):
        for x, y, w in rows:
            if x is not None:
                sums[s, y] = sums.get((s, y), 0) + w
    first = sorted(found().collect(), key=str)
    assert first and all(r["sum_w_weight"] == sums[r.session, r.aid] for r in first)
    monkeypatch.setattr(cv, "LIST_ROWS", 3)
    monkeypatch.setattr(cv, "EXPANDED_ROWS", 100)
    assert cv.neighbour_lists(weights).count() > weights.select("aid_x").distinct().count()

    def plain(rows):
        return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)

    assert plain(found().collect()) == plain(first)
    norm = weights.selectExpr("aid_x", "aid_y", "weight / 3D AS norm_transition_count", "weight / 2D AS norm_transition_user_count")
    cut = cv.bigram_features(ev, norm, "b", 4, 5).collect()
    monkeypatch.undo()
    assert cut and plain(cut) == plain(cv.bigram_features(ev, norm, "b", 4, 5).collect())


def folder_of(df):
    return Path(df.inputFiles()[0].removeprefix("file:")).parent


def test_vectors_are_not_copied_for_lists_and_nothing_but_the_neighbours_stays(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sessionrank.functions import vectors as V
    from sessionrank.settings import stage

    rng = np.random.default_rng(3)
    v = rng.standard_normal((1500, 8))
    v[40:60] = v[3]
    items = stage(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "aid long, vector array<double>"))
    rows = items.select(F.col("aid").alias("k"), V.unit("vector").alias("v"))
    q, own = nb._listed(rows, rows, 10, 0.9, None)
    bits = [sum(bin(b).count("1") for b in r.asked) for r in q.collect()]
    assert len(bits) == own.count() == 1500 and 1 <= min(bits) and sum(bits) < 0.8 * 1500 * 39
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 12)
    best = [np.lexsort((np.arange(1500), -s))[:10].tolist() for s in sims]
    before = set(folder_of(items).parent.iterdir())
    monkeypatch.setattr(nb, "BLOCK_ROWS", 100)
    for method, least in (("exact", 1), ("ivf", 0.85)):  # four parts of the items
        near = nb.knn(items.withColumnRenamed("aid", "q"), items, 10, key="q", cell_rows=150, method=method, recall=0.9)
        got = {r.q: r for r in near.collect()}
        assert len(got) == 1500 and all(len(r.neighbor_aids) == 10 for r in got.values())
        same = [len(set(got[n].neighbor_aids) & set(b)) for n, b in enumerate(best)]
        assert sum(same) >= least * 15_000
        assert abs(np.array([got[n].cosine_similarity for n in range(1500)]) - [[sims[n][a] for a in got[n].neighbor_aids] for n in range(1500)]).max() < 1e-11
        assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
        # of all tables written on the way only the result is left (and the sample that centroids are learned from)
        after = set(folder_of(items).parent.iterdir())
        assert after - before == {folder_of(near)}
        before = after


def test_tables_written_on_the_way_are_deleted(spark):
    from sessionrank.settings import apart, stage, stage_by

    inner = []

    def made():
        a, b = stage(spark.range(1000)), stage_by(spark.range(0, 1000, 2), ["id"])
        c = apart(lambda: a.join(stage(spark.range(500)), "id"))
        inner.extend(map(folder_of, (a, b, c)))
        assert all(f.exists() for f in inner)
        return c.join(b, "id")

    outside = stage(spark.range(3))
    out = apart(made)
    assert out.count() == 250 and outside.count() == 3
    assert not [f for f in inner if f.exists()]


def test_of_all_tables_only_the_dataset_stays(spark):
    from sessionrank.plans import training_set as T
    from sessionrank.settings import stage

    truth = spark.createDataFrame([(1, 2, [1], [3])], "session long, click_label long, cart_label array<long>, order_label array<long>")
    first = stage(spark.range(1))
    before = set(folder_of(first).parent.iterdir())
    full, sampled = T.build(events(spark, sessions=6, items=4), truth)
    assert set(folder_of(first).parent.iterdir()) - before == {folder_of(full)}
    rows = full.select("session", "aid", "click_label", "cart_label", "order_label").collect()
    assert len(rows) == 24 and {(r.session, r.aid) for r in rows if r.click_label + r.cart_label + r.order_label} == {(1, 1), (1, 2), (1, 3)}
    assert sampled.count() == 24


def test_neighbours_become_rows_where_an_item_was_last(spark):
    from sessionrank.operators import candidates as cd

    near = spark.createDataFrame([(a, [a, (a + 1) % 12, (a + 2) % 12], [1.0, 0.9, 0.8]) for a in range(12)], "aid long, neighbor_aids array<long>, cosine_similarity array<double>")
    found = cd.neighbour_candidates(events(spark), near, 0.85)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(arrays_zip") < plan.index("Join [start#")
    assert {(r.session, r.aid, r.last_click_cosine_similarity, r.last_cart_cosine_similarity) for r in found.collect()} == {(s, 0, 0.9, None) for s in range(30)}
