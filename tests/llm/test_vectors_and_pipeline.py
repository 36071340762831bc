"""Embeddings, components, queries with SQL, and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from registry.check import _key
from sessionrank.llm import decontaminate, entries, mixing, simhash, tokenfile, toxicity, vectors
from sessionrank.llm.common import read
from sessionrank.llm.components import components
from sessionrank.settings import shared_dir


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    df = entries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(_key(r) for r in df.select(*cols).collect())
    assert got == sorted(_key(r) for r in duck.execute(f"SELECT {', '.join(cols)} FROM ({entries.SQL[name]})").fetchall())


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1200)] + [(5, 5), (None, 3), (9, 8), (9, 8), (8, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(101, 161)} | {i: 7 for i in [8, 9, *range(1000, 1200)]}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("cell", [2048, 7])
def test_vectors_in_hot_buckets(spark, cell):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((20, 16))
    x = np.concatenate([base, base, base + 0.02 * rng.standard_normal((20, 16)), base[:1] + 0.05 * rng.standard_normal((60, 16))])
    labels = rng.integers(0, 2, len(x))
    rows = [(i, [float(v) for v in x[i]], int(labels[i])) for i in range(len(x))]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, rows[0][1], None), (503, [float("nan")] * 16, 0), (504, [1.0, None], 0), (505, [], 0), (506, [1.0, 2.0], 0), (506, [1.0, 2.0], 0), (None, [2.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    got = sorted(map(tuple, vectors.near_vectors(df, cell_rows=cell).collect()), key=str)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    low = np.arange(len(x))
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], len(x)).min(axis=1))
        if (new == low).all():
            break
        low = new
    want = [(i, int(linked[i].sum()), int(low[i]), bool(low[i] == i)) for i in range(len(x))]
    want += [(i, 0, i, True) for i in (500, 501, 502, 503, 504, 505)] + [(506, 1, 506, True)] * 2 + [(None, 0, None, False)]
    assert got == sorted(want, key=str)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_stages_work_on_what_is_left(spark, sf_dir):
    """Each stage against the operators' own findings on its input, and run() against the stages in turn."""
    docs = read(spark, sf_dir, "documents")
    steps = [f for _, f in corpus_pipeline.STAGES]
    labels = read(spark, sf_dir, "labels").where(~entries.dealt(5, 0))
    a = steps[0](spark, docs, sf_dir).cache()
    bad = {r.doc_id for r in toxicity.scored(docs, docs, labels).where("toxicity >= 0.5").collect()}
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in a.collect()} == ids - bad and a.columns == docs.columns
    b = steps[1](spark, a, sf_dir).cache()
    assert {r.doc_id for r in b.collect()} == {r.component_id for r in simhash.near_duplicates(a).collect()}
    c = steps[2](spark, b, sf_dir).cache()
    leaks = decontaminate.contamination(b, read(spark, sf_dir, "benchmark")).where("size(leak.starts) > 0")
    assert {r.doc_id for r in c.collect()} == {r.doc_id for r in b.collect()} - {r.doc_id for r in leaks.collect()}
    d = steps[3](spark, c, sf_dir).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(c).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in d.groupBy("doc_id").count().collect()} == copies and d.columns == docs.columns
    path = shared_dir(spark)
    tokenfile.write(d, path)
    want = sorted(map(tuple, tokenfile.read_back(spark, path).collect()))
    assert sorted(map(tuple, steps[4](spark, d, sf_dir).collect())) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == want
