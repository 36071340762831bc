"""Ranking objectives, early stopping, balanced folds and ordered codes."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionrank.operators import boosting as bo
from sessionrank.operators import dataset as ds
from sessionrank.operators import learn as ml

SMALL = replace(bo.Settings(), rounds=10, depth=3, patience=3, min_rows=5, max_bin=32)


def plain_gradients(objective, s, y, cut, top):
    g, h = np.zeros(len(s)), np.zeros(len(s))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        order = sorted(range(a, b), key=lambda i: (-s[i], i))
        d = {i: 1 / np.log2(p + 2) if p < top else 0 for p, i in enumerate(order)}
        best = sum((2.0**v - 1) / np.log2(p + 2) for p, v in enumerate(sorted(y[a:b], reverse=True)[:top]))
        for i in range(a, b):
            for j in range(a, b):
                if y[i] > y[j]:
                    w = abs((2.0 ** y[i] - 2.0 ** y[j]) * (d[i] - d[j])) / best if objective == "lambdarank" else 1
                    p = 1 / (1 + np.exp(s[i] - s[j]))
                    g[i] -= p * w
                    g[j] += p * w
                    h[i] += p * (1 - p) * w
                    h[j] += p * (1 - p) * w
    return g, h


@pytest.mark.parametrize("objective", ["lambdarank", "pairwise"])
@pytest.mark.parametrize("at_once", [2_000_000, 7])
def test_gradients_equal_a_plain_form(objective, at_once, monkeypatch):
    monkeypatch.setattr(bo, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    cut = np.array([0, 1, 9, 9, 20, 26])
    y = rng.integers(0, 4, 26).astype(float)
    y[20:] = 2.0  # no pair in this session
    s = np.round(rng.standard_normal(26), 1)
    settings = replace(bo.Settings(), objective=objective, top=4)
    got, want = bo.gradients(settings, s, y, cut), plain_gradients(objective, s, y, cut, 4)
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])


def test_logistic_gradients_are_derivatives():
    s, y = np.array([-2.0, 0.3, 4.0]), np.array([0.0, 1.0, 0.0])
    settings = replace(bo.Settings(), objective="binary")
    g, h = bo.gradients(settings, s, y, np.array([0, 3]))
    loss = lambda x: np.logaddexp(0, x) - y * x
    e = 1e-5
    assert np.allclose(g, (loss(s + e) - loss(s - e)) / (2 * e), atol=1e-8)
    assert np.allclose(h, (loss(s + e) + loss(s - e) - 2 * loss(s)) / e**2, atol=1e-4)


def test_ndcg_of_ties_and_sessions_without_positive_rows():
    y = np.array([0.0, 1, 0, 0, 0, 2, 1])
    got = bo.ndcg(np.array([1.0, 1, 0, 5, 5, 0, 1]), y, np.array([0, 3, 5, 7]), 20)
    assert got[0] == pytest.approx(1 / np.log2(3)) and np.isnan(got[1])
    assert got[2] == pytest.approx((1 + 3 / np.log2(3)) / (3 + 1 / np.log2(3)))


def planted(spark, sessions=240, seed=0):
    """The better of a session's items have the greater x, but x begins anywhere for each session."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(sessions):
        base, rel = 30 * rng.standard_normal(), rng.standard_normal(12)
        top = set(np.argsort(-rel)[:2].tolist())
        for a in range(12):
            noise = None if rng.random() < 0.1 else float(rng.standard_normal())
            rows.append((s, int(a * 7 % 12), s % 3, int(a in top), float(base + rel[a]), noise, float(rel[a] + rng.standard_normal() * 2)))
    return spark.createDataFrame(rows, "session long, aid long, fold long, hit long, x double, noise double, weak double")


def mean_ndcg(df, name):
    rows = df.orderBy("session", "aid").select("session", "hit", name).toPandas()
    cut = np.concatenate([[0], np.flatnonzero(np.diff(rows.session)) + 1, [len(rows)]])
    return float(np.nanmean(bo.ndcg(rows[name].to_numpy(), rows.hit.to_numpy().astype(float), cut, 20)))


FEATURES = ["x", "noise", "weak"]


def test_ranking_beats_pointwise_trees_on_held_out_sessions(spark):
    data = planted(spark).cache()
    settings = replace(SMALL, rounds=12, patience=12)
    forests, oof = bo.cross_rank(data, FEATURES, "hit", settings=settings)
    got = mean_ndcg(data.join(oof, ["session", "aid"]), "pred")
    _, point = ml.cross_fit(data, FEATURES, "hit", 3, {"maxDepth": 3, "stepSize": 0.1}, n_iter=12)
    assert len(forests) == 3 and oof.count() == data.count()
    assert got > mean_ndcg(data.join(point, ["session", "aid"]), "pred") + 0.01
    for f in forests:  # trees up to the round of the best held-out value
        assert len(f.trees) == int(np.argmax(f.watched)) and len(f.watched) <= settings.rounds + 1
        own = data.where(F.col("fold") == f.fold)
        assert mean_ndcg(bo.score(own, [f], "p"), "p") == pytest.approx(max(f.watched), abs=1e-9)
    table = bo.gains(spark, forests).collect()
    assert {r.feature for r in table} == set(FEATURES) and table[0].feature in ("x", "weak")
    whole = bo.second_fit(data, FEATURES, "hit", forests, settings)
    assert len(whole.trees) == max(1, round(np.mean([len(f.trees) for f in forests])))


def test_training_stops_when_held_out_sessions_do_not_gain(spark):
    rng = np.random.default_rng(5)
    rows = [(s, a, s % 2, int(rng.random() < 0.3), float(rng.standard_normal())) for s in range(60) for a in range(8)]
    data = spark.createDataFrame(rows, "session long, aid long, fold long, hit long, x double")
    for objective in ("pairwise", "binary"):
        forests = bo.boost(data, ["x"], "hit", settings=replace(SMALL, objective=objective, rounds=9, patience=2, step=0.5))
        assert any(len(f.watched) < 10 for f in forests)
        for f in forests:
            best = int(np.argmax(f.watched))
            assert len(f.trees) == best and (len(f.watched) == 10 or len(f.watched) == best + 3)


def test_odd_rows_of_rankers(spark):
    rows = [(None, 1, None, 1, None), (None, None, None, 0, float("nan")), (5, 1, 0, None, float("inf")), (5, 1, 0, 1, 0.5), (5, 1, 0, 1, 0.5)]
    rows += [(7, a, 1, a % 2, float(a)) for a in range(300)]  # most rows in one session
    data = spark.createDataFrame(rows, "session long, aid long, fold long, hit long, x double").withColumns({"_x": F.lit(1), "pred2": F.lit("p")})
    forests = bo.boost(data, ["x"], "hit", settings=replace(SMALL, rounds=2), block_rows=50)
    assert [f.fold for f in forests] == [-1, 0, 1]
    out = bo.score(data.drop("_x"), forests, "pred", "fold")
    assert out.count() == len(rows) and out.where("pred is null or isnan(pred)").count() == 0
    empty = bo.boost(data.limit(0), ["x"], "hit", settings=SMALL)
    assert empty == [] and bo.boost(data.limit(0), ["x"], "hit", None, settings=replace(SMALL, rounds=1))[0].limits[0].size == 0
    with pytest.raises(ValueError, match="folds"):
        bo.boost(data.withColumn("fold", F.col("aid")), ["x"], "hit", settings=SMALL)


def test_blocks_do_not_change_the_trees(spark):
    data = planted(spark, 60).cache()
    settings = replace(SMALL, rounds=2)
    a, b = (bo.boost(data.repartition(n), FEATURES, "hit", settings=settings, block_rows=size) for n, size in ((1, 50_000), (5, 30)))
    for x, y in zip(a, b, strict=True):
        assert [t.feature.tolist() for t in x.trees] == [t.feature.tolist() for t in y.trees]
        assert x.watched == pytest.approx(y.watched)


def test_pointwise_folds_cover_every_row(spark):
    data = planted(spark, 30).withColumn("fold", F.when(F.col("session") % 7 == 0, None).otherwise(F.col("session") % 5))
    models, oof = ml.cross_fit(data, FEATURES, "hit", 3, {"maxDepth": 2}, n_iter=1)
    assert len(models) == 3 and oof.count() == data.count()


@pytest.mark.parametrize("hot", [None, "4"])
def test_dealt_folds_are_even(spark, hot):
    from sessionrank.settings import HOT_ROWS_KEY

    rng = np.random.default_rng(2)
    sizes = [200, 90, *rng.integers(1, 12, 60).tolist()]
    rows = [(None if s == 3 else s, a) for s, n in enumerate(sizes) for a in range(n)]
    df = spark.createDataFrame(rows, "session long, aid long")
    if hot:
        spark.conf.set(HOT_ROWS_KEY, hot)
    try:
        got = ds.deal_folds(df, 4, 1).collect()
    finally:
        spark.conf.unset(HOT_ROWS_KEY)
    assert len(got) == len(rows) and all(r.fold is not None for r in got)
    assert len({(r.session, r.fold) for r in got}) == len(sizes)
    counts = np.bincount([r.fold for r in got], minlength=4)
    assert counts.max() - counts.min() <= max(sizes) and (counts > 0).all()
    even = spark.createDataFrame([(s, a) for s in range(40) for a in range(3)], "session long, aid long")
    assert np.bincount([r.fold for r in ds.deal_folds(even, 4).collect()]).tolist() == [30] * 4
    assert ds.deal_folds(df.limit(0)).count() == 0


def test_codes_are_alphabetical_beyond_a_part(spark, monkeypatch):
    values = [f"{i * 7919 % 1000:03d}" for i in range(1000)]
    df = spark.createDataFrame([(v, 1.0) for v in [*values, *values[:10], None]], "kind string, n double")
    for part, few in ((1_000_000, 100_000), (90, 100_000), (90, 10)):
        monkeypatch.setattr(ds, "FEW_VALUES", few)
        ids = {r.kind: r.i for r in ds.ordered_ids(df.where("kind is not null"), "kind", "i", part).collect()}
        assert ids == {v: i for i, v in enumerate(sorted(set(values)))}
        got = {r.kind: r.code for r in ds.encode(df.withColumn("code", F.col("kind")), ["code"], ["n"]).collect()}
        assert got == {v: float(i) for i, v in enumerate(sorted(set(values)))} | {None: 1000.0}
