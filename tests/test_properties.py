"""Properties that hold on any log, and of the learned operators."""

import pytest
from pyspark.sql import functions as F

from registry.catalogue import QUERIES
from registry.check import compare
from registry.logs import big, labels, small
from registry.q_lists import pred_lists
from registry.q_vectors import FEATURES, train_set
from sessionrank.operators import candidates as cd
from sessionrank.operators import covisit as cv
from sessionrank.operators import dataset as ds
from sessionrank.operators import embeddings as em
from sessionrank.operators import evaluate as ev
from sessionrank.operators import learn as ml
from sessionrank.operators import neighbours as nb
from sessionrank.operators import pairs as p
from sessionrank.sources import sinks
from sessionrank.sources.labels import wide_ground_truth


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_pairs_without_type_are_symmetric(spark, sf_dir):
    flags = p.long_pairs(p.pair_flags(big(spark, sf_dir), 24, "HOUR", False), False)
    assert same(flags, flags.select("session", F.col("aid_y").alias("aid_x"), F.col("aid_x").alias("aid_y")))


def test_best_lists_are_bounded(spark, sf_dir):
    edges = cv.top_neighbours(cv.pair_cvr(p.pair_type_counts(p.pair_flags(small(spark, sf_dir), 24, "HOUR", False))), cv.COUNTS, 4)
    most = edges.groupBy("aid_x").count().agg(F.max("count")).first()[0]
    assert 0 < most <= 4 * 3


def test_result_does_not_depend_on_partitions_or_order(spark, sf_dir):
    log = big(spark, sf_dir)
    shuffled = log.repartition(7, "aid").orderBy(F.md5(F.concat_ws("|", "aid", "session", "type")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = cv.history(log, time_weight=True).select("session", "aid", "n", "w", F.round("tw", 9))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        two = cv.history(shuffled, time_weight=True).select("session", "aid", "n", "w", F.round("tw", 9))
        assert same(one, two)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["src_events", "fn_time", "fn_hour_spine", "item_hour_counts", "sess_hours", "ds_labels"])
def test_time_zone_does_not_matter(spark, duck, sf_dir, name):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        message, _, _ = compare(spark, duck, QUERIES[name], sf_dir)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert message is None, message


def test_recall_grows_with_k(spark, sf_dir):
    truth, pred = wide_ground_truth(labels(spark, sf_dir)), pred_lists(spark, sf_dir)
    values = [ev.recall_lists(pred, truth, k).first()["cart_recall"] for k in (1, 5, 20)]
    assert 0 <= values[0] <= values[1] <= values[2] <= 1


def test_word2vec_vectors_are_unit(spark, sf_dir):
    v = em.item2vec(em.sentences(small(spark, sf_dir)), 8, 3, 1, seed=1)
    norms = v.select(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x).alias("n")).agg(F.min("n"), F.max("n")).first()
    assert abs(norms[0] - 1) < 1e-6 and abs(norms[1] - 1) < 1e-6


def test_learned_neighbours_are_those_that_occur_together(spark):
    # 20 groups of 6 items, each in a few short sessions with items of its own group only
    rows = [(g * 10 + s, g * 100 + (s + i * (1 + s % 5)) % 6, i) for g in range(20) for s in range(5) for i in range(6)]
    log = spark.createDataFrame(rows, "session long, aid long, i long").select("session", "aid", F.timestamp_seconds(1_700_000_000 + F.col("i")).alias("ts"), F.lit("clicks").alias("type"))
    sents = em.stage(em.sentences(log))
    v = em.stage(em.item2vec(sents, 64, 5, 1, seed=1))
    near = nb.knn(v.withColumnRenamed("aid", "q"), v, 4, key="q")
    found = cd.explode_neighbours(near, "q").where("q <> aid").select(F.col("q").alias("aid_x"), F.col("aid").alias("aid_y"))
    together = em.context_counts(sents, 5).select("aid_x", "aid_y")
    assert found.join(together, ["aid_x", "aid_y"], "left_semi").count() > 0.9 * found.count() > 0


def test_factors_of_ids_beyond_32_bits(spark, sf_dir):
    log = small(spark, sf_dir).withColumn("session", F.col("session") + 10**12)
    numbers = em.dense_ids(log, "session", "n").agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()
    sessions = log.select("session").distinct().count()
    assert tuple(numbers) == (0, sessions - 1, sessions)
    users, items = em.implicit_factors(log, rank=4, iters=2)
    assert users.count() == sessions and items.count() == log.select("aid").distinct().count()
    assert users.join(log, "session", "left_anti").isEmpty()


def test_walks_follow_edges(spark, sf_dir):
    edges = em.edges(small(spark, sf_dir))
    walks = em.random_walks(edges, 5, 2, 3)
    steps = walks.select(F.explode(F.arrays_zip(F.slice("items", 1, F.size("items") - 1).alias("a"), F.slice("items", 2, F.size("items")).alias("b"))).alias("e"))
    steps = steps.select(F.col("e.a").alias("lag_aid"), F.col("e.b").alias("aid")).where(F.col("aid").isNotNull())
    assert steps.count() > 0 and steps.join(edges, ["lag_aid", "aid"], "left_anti").isEmpty()


def test_folds_keep_sessions_together_and_models_learn(spark, sf_dir):
    data = train_set(spark, sf_dir).withColumn("carts_gt", (F.col("visit_count_clicks") > 1).cast("long"))
    assert data.select("session", "fold").distinct().count() == data.select("session").distinct().count()
    models, oof = ml.cross_fit(data, FEATURES, "carts_gt", 3, {"maxDepth": 3}, n_iter=3)
    assert len(models) == 3 and oof.count() == data.count()
    scored = oof.join(data.select("session", "aid", "carts_gt"), ["session", "aid"])
    assert ev.auc(scored, "pred", "carts_gt") > 0.9
    best = ml.best_features(ml.importances(spark, models, FEATURES), 1)
    assert best == ["visit_count_clicks"]


def test_auc_table_equals_evaluator(spark, sf_dir):
    data = train_set(spark, sf_dir).withColumn("hit", ((F.col("session") + F.col("aid")) % 3 == 0).cast("long"))
    a = ev.auc(data, "pred_carts", "hit")
    b = ev.auc_table(data, "pred_carts", "hit").first()["auc"]
    assert abs(a - b) < 1e-9


def test_sampling_keeps_positives_and_the_ratio(spark, sf_dir):
    data = train_set(spark, sf_dir)
    got = ds.sample_negatives(data, ["orders_gt"], 2, 1)
    positives = data.where("orders_gt = 1").count()
    assert got.where("orders_gt = 1").count() == positives
    assert got.where("orders_gt = 0").count() == min(2 * positives, data.where("orders_gt = 0").count())
    assert same(got, ds.sample_negatives(data, ["orders_gt"], 2, 1))


def test_bucketed_table_joins_without_shuffle(spark, sf_dir, tmp_path):
    log = small(spark, sf_dir)
    sinks.save(log, "log_bucketed", ["session"], buckets=4, path=str(tmp_path / "log"))
    sinks.save(log.select("session").distinct(), "sessions_bucketed", ["session"], buckets=4, path=str(tmp_path / "s"))
    joined = spark.table("log_bucketed").hint("merge").join(spark.table("sessions_bucketed").hint("merge"), "session")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and joined.count() == log.count()
    spark.sql("DROP TABLE log_bucketed")
    spark.sql("DROP TABLE sessions_bucketed")
