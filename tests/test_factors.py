"""Factors by negative sampling, and approximate neighbours."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionrank.operators import embeddings as em
from sessionrank.operators import factorise as fa
from sessionrank.operators import neighbours as nb
from sessionrank.settings import stage


def plain_step(loss, u, r, i, j, z, w, seen):
    """Gradients of one pair by differences of its loss, for each vector that it has."""
    def value(x):
        left, right = x[: u.size].reshape(u.shape), x[u.size :].reshape(r.shape)
        if loss == "bpr":
            return 0.0 if seen else w * np.logaddexp(0, -(left[i] @ (right[j] - right[z[0]])))
        return w * (np.logaddexp(0, -(left[i] @ right[j])) + sum(np.logaddexp(0, left[i] @ right[k]) for k in z if k != j))

    x, e = np.concatenate([u.ravel(), r.ravel()]), 1e-6
    g = np.array([(value(x + e * d) - value(x - e * d)) / (2 * e) for d in np.eye(len(x))])
    return g[: u.size].reshape(u.shape), g[u.size :].reshape(r.shape)


@pytest.mark.parametrize("loss", ["skipgram", "bpr"])
def test_a_pair_moves_vectors_down_its_gradient(loss):
    rng = np.random.default_rng(4)
    settings = fa.Settings(loss=loss, dim=3, step=0.1, negatives=2, decay=0.0, seed=5)
    u, r = rng.standard_normal((2, settings.width)), rng.standard_normal((6, settings.width))
    if loss == "bpr":
        u[:, -1] = 1
    upto = np.cumsum([3, 1, 0, 4, 2, 5])
    one = np.array([1])
    turns = range(2) if loss == "skipgram" else range(1)
    draws = [int(fa.noise_draws(one, np.array([4]), k, 5, upto)[0]) for k in turns]
    sides = [fa._Side(np.stack([x, np.zeros_like(x)]).astype(np.float32).tobytes(), len(x), settings.width, loss == "bpr" and x is u) for x in (u, r)]
    fa._train_cell(*sides, one.astype(np.int32), np.array([4], np.int32), np.array([1.5], np.float32), (np.arange(2), np.arange(6)), upto, range(1), settings)
    gu, gr = plain_step(loss, u, r, 1, 4, draws, 1.5, draws[0] == 4)
    if loss == "bpr":
        gu[:, -1] = 0
    for side, x, g in zip(sides, (u, r), (gu, gr), strict=True):
        want = x - settings.step * g / np.sqrt(g * g + fa.EPSILON)
        assert np.abs(side.v - want).max() < 1e-3


def test_noise_follows_its_weights():
    upto = np.cumsum([100, 0, 300, 600])
    left, right = np.arange(40_000), np.arange(40_000) % 97
    got = np.bincount(fa.noise_draws(left, right, 2, 9, upto), minlength=4) / 40_000
    assert got[1] == 0 and np.abs(got - np.array([0.1, 0, 0.3, 0.6])).max() < 0.01


def grouped(spark):
    """400 sessions with items of one of 8 groups, and some of any; two items of each session are held out."""
    rng = np.random.default_rng(0)
    seen, held = [], []
    for u in range(400):
        pick = rng.choice(np.arange(u % 8, 160, 8), 8, replace=False)
        seen += [(u, int(i)) for i in [*pick[:6], *rng.choice(160, 2)]]
        held += [(u, int(i)) for i in pick[6:]]
    return spark.createDataFrame(seen, "session long, aid long"), seen, held


def pair_auc(users, items, seen, held):
    u, v = ({r[0]: np.array(r[1]) for r in x.collect()} for x in (users, items))
    own, out = {}, []
    for s, i in seen + held:
        own.setdefault(s, set()).add(i)
    for s, i in held:
        d = np.array([u[s] @ v[i] - u[s] @ v[j] for j in v if j not in own[s]]) if i in v else np.zeros(0)
        out += ((d > 0) + 0.5 * (d == 0)).tolist()
    return float(np.mean(out))


def test_ranking_factors_rank_held_out_items_above_others(spark):
    log, seen, held = grouped(spark)
    bpr = pair_auc(*em.ranking_factors(log, 16, seed=1), seen, held)
    als = pair_auc(*em.implicit_factors(log, 16, seed=1), seen, held)
    assert bpr > als and bpr > 0.94
    cells = fa.Settings(cell_pairs=800, block_ids=100)
    split = pair_auc(*em.ranking_factors(log, 16, seed=1, settings=cells), seen, held)
    assert split > 0.9


def test_blocks_hold_hot_ids(spark):
    rows = [(0, i, 1.0) for i in range(90)] + [(i, 0, 1.0) for i in range(1, 10)]
    pairs = spark.createDataFrame(rows, "l long, r long, w double")
    assert fa.blocks_of(pairs, 10, 90, replace(fa.Settings(), cell_pairs=30)) == 3
    assert fa.blocks_of(pairs, 10, 90, replace(fa.Settings(), cell_pairs=1000, block_ids=20)) == 5
    assert fa.blocks_of(pairs, 10, 90, fa.Settings()) == 1 == fa.blocks_of(pairs.limit(0), 0, 0, fa.Settings())


def test_odd_pairs(spark):
    rows = [(10**12, 5, 1.0), (10**12, 5, 1.0), (None, 5, 1.0), (3, None, 1.0), (4, 6, 2.0)]
    pairs = spark.createDataFrame(rows, "session long, aid long, w double").withColumn("vector", F.lit("x"))
    noise = spark.createDataFrame([(5, 3), (5, 1), (99, 7)], "aid long, w long")
    for settings in (fa.Settings(dim=4, passes=3), fa.Settings(loss="bpr", dim=4, passes=3, block_ids=1)):
        users, items = fa.learned(pairs, "session", "aid", noise, settings)
        assert {r.session for r in users.collect()} == {10**12, 4} and {r.aid for r in items.collect()} == {5, 6}
        assert all(np.isfinite(r.vector).all() and len(r.vector) == settings.width for r in [*users.collect(), *items.collect()])
        again = {r.session: r.vector for r in fa.learned(pairs.repartition(3), "session", "aid", noise, settings)[0].collect()}
        assert again == {r.session: r.vector for r in users.collect()}
        assert [x.count() for x in fa.learned(pairs.limit(0), "session", "aid", noise, settings)] == [0, 0]


def test_long_sentences_and_rare_items_in_pairs(spark):
    rows = [(1, [1, 9, 2, 1, 2]), (2, [1, 2]), (3, [2]), (4, [])]
    sents = stage(spark.createDataFrame(rows, "sent long, items array<long>"))
    got = {(r.aid_x, r.aid_y): r.w for r in em.skipgram_pairs(sents, 2, 2, sample=0).collect()}
    # 9 is rare: 1 2 1 2 and 1 2 remain; distance 1 weighs 1, distance 2 a half
    assert got == {(1, 2): 4.0, (2, 1): 4.0, (1, 1): 1.0, (2, 2): 1.0}
    split = stage(spark.createDataFrame([(1, [1, 2, 1]), (2, [1, 2])], "sent long, items array<long>"))  # 1 2 1 2, parted after two, one item of overlap
    parted = {(r.aid_x, r.aid_y): r.w for r in em.skipgram_pairs(split, 1, 1, sample=0, max_len=2).collect()}
    assert parted == {(1, 2): 3.0, (2, 1): 3.0}


def vectors(spark, n, dim, clusters, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((clusters, dim)) * 2
    x = centre[rng.integers(0, clusters, n)] + rng.standard_normal((n, dim))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "aid long, vector array<double>")


def test_inverted_file_reaches_its_recall(spark):
    items = stage(vectors(spark, 3000, 16, 12))
    queries = vectors(spark, 300, 16, 12, 1).withColumnRenamed("aid", "q")
    exact = stage(nb.knn(queries, items, 50, key="q"))
    for cell in (nb.CELL_ROWS, 70):  # lists of some 50 to 300 items, split or not
        found = stage(nb.knn(queries, items, 50, key="q", method="ivf", cell_rows=cell, recall=0.93))
        assert found.count() == 300 and found.where("size(neighbor_aids) <> 50").count() == 0
        assert nb.recall_of(found, exact, "q") >= 0.9
    probes = stage(nb._listed(queries.select(F.col("q").alias("k"), nb.V.unit("vector").alias("v")), items.select(F.col("aid").alias("k"), nb.V.unit("vector").alias("v")), 50, 0.93, None)[0])
    assert probes.count() < 0.6 * 300 * 55  # it does not look everywhere
    # similarities are exact, whatever was found
    both = found.join(items.withColumnRenamed("vector", "i"), F.expr("neighbor_aids[0] = aid")).join(queries, "q")
    row = both.first()
    assert row.cosine_similarity[0] == pytest.approx(np.dot(row.i, row.vector) / np.linalg.norm(row.i) / np.linalg.norm(row.vector))


def test_inverted_file_of_few_and_odd_vectors(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None)], "aid long, vector array<double>")
    got = nb.knn(items.withColumnRenamed("aid", "q"), items, 3, key="q", method="ivf").collect()
    assert sorted((r.q, r.neighbor_aids) for r in got) == [(1, [1, 3]), (3, [3, 1])]
    copies = spark.createDataFrame([(i, [1.0, 2.0, 0.5]) for i in range(200)], "aid long, vector array<double>")
    got = nb.knn(copies.withColumnRenamed("aid", "q"), copies, 10, key="q", method="ivf", cell_rows=60)
    assert got.where("neighbor_aids = array(0,1,2,3,4,5,6,7,8,9)").count() == 200
    assert nb.knn(items.limit(0).withColumnRenamed("aid", "q"), items, 3, key="q", method="ivf").count() == 0
    with pytest.raises(ValueError, match="method"):
        nb.knn(items, items, 3, method="tree")


def test_each_cell_of_a_step_has_a_task(spark, monkeypatch):
    """A task that trains cells writes one file, so a step of b cells leaves b files."""
    import glob

    tasks, remove = [], fa.remove

    def counted(spark, path):
        tasks.append(len(glob.glob(f"{path.removeprefix('file:')}/part-*")))
        remove(spark, path)

    monkeypatch.setattr(fa, "remove", counted)
    rows = [(s, i, 1.0) for s in range(24) for i in range(24) if (s + i) % 3]
    pairs = spark.createDataFrame(rows, "session long, aid long, w double")
    noise = spark.createDataFrame([(i, 1) for i in range(24)], "aid long, w long")
    users, items = fa.learned(pairs, "session", "aid", noise, fa.Settings(loss="bpr", dim=4, passes=2, block_ids=4))
    assert tasks[1:] == [6] * 5
    assert users.count() == items.count() == 24
