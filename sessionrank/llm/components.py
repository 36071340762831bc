"""Connected components of a graph given by its edges, as joins and aggregates."""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sessionrank.llm.common import stage


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable number for each of the nodes 0..n-1, from edges a - b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) that is not its component's smallest.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the
    smallest node that it knows. The number of rounds grows with the logarithm of the longest
    path; edges never become more. Minima are partial aggregates, and each join meets two
    written tables directly above their shuffles, so a node with very many edges is split by
    the adaptive skew join. Each round is written to the shared folder.
    Edges with null, loops and repeated edges change nothing; no edges give no rows.
    """
    cur = stage(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = _state(cur)
    while state[0]:
        both = cur.select("b", F.col("a").alias("o")).union(cur.select(F.col("a").alias("b"), F.col("b").alias("o")))
        low = stage(both.groupBy("b").agg(F.min("o").alias("m")).select("b", F.least("b", "m").alias("m")))
        large = stage(cur.join(low, "b").select("a", F.col("m").alias("b")).where("a <> b").distinct())
        low = stage(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        cur = stage(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        last, state = state, _state(cur)
        if state == last:
            break
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
