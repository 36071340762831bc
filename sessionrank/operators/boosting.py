"""Boosted histogram trees with ranking objectives and early stopping, all folds side by side.

Candidates are dealt by session, binned, and written once as blocks of whole sessions. A level of the trees of
all folds is one pass over the blocks: a task scores its rows with the trees so far, ranks each session,
takes the objective's gradients and adds them up by (fold, node, feature, bin); the partial histograms are merged per
feature in Spark, and the driver learns the best split of each node. It holds trees, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from sessionrank.operators.dataset import encode
from sessionrank.settings import remove, shared_dir, stage

BLOCK_ROWS = 50_000
PAIRS_AT_ONCE = 2_000_000
SNAPSHOT = 8
MAX_FOLDS = 64
BLOCKS = "block long, sessions array<long>, sizes array<int>, folds array<int>, aids array<long>, labels binary, bins binary, scores binary"
_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


@dataclass(frozen=True)
class Settings:
    """Of the trees. ``objective``: lambdarank, pairwise or binary; ``top``: places that NDCG looks at in training, ``metric_top`` when watched."""

    objective: str = "lambdarank"
    rounds: int = 100
    patience: int = 20
    depth: int = 5
    step: float = 0.1
    max_bin: int = 64
    l1: float = 0.1
    l2: float = 0.1
    min_rows: int = 10
    row_share: float = 0.8
    feature_share: float = 0.8
    top: int = 30
    metric_top: int = 20
    seed: int = 777


@dataclass
class Tree:
    """Node i has the children 2 i + 1 and 2 i + 2; ``feature`` is -1 where it ends."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node of each column of bins (features, rows)."""
        at, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            at = np.where(inner, 2 * at + 1 + (bins[np.maximum(f, 0), rows] > self.bin[at]), at)


@dataclass
class Forest:
    """Trees of a fold's model, the limits of their bins, and what the held-out fold said after each round."""

    features: list[str]
    limits: list[np.ndarray]
    fold: int | None = None
    trees: list[Tree] = field(default_factory=list)
    watched: list[float] = field(default_factory=list)

    @property
    def best(self) -> int:
        """The number of trees with the best held-out value, the fewest of equals; all trees where nothing was watched."""
        seen = [(-v, i) for i, v in enumerate(self.watched) if v == v]
        return min(seen)[1] if seen else len(self.trees)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(bins.shape[1])
        for tree in self.trees:
            out += tree.value[tree.leaves(bins)]
        return out

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins (features, rows) of cleaned feature rows."""
        return np.stack([np.searchsorted(limits, x[:, i]) for i, limits in enumerate(self.limits)]) if len(self.limits) else np.zeros((0, len(x)), np.int64)


# ---- gradients


def ranks(scores: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Place of each row in its session by falling score; equal scores in the order of the rows."""
    owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    order = np.lexsort((np.arange(len(scores)), -np.round(scores, 9), owner))
    place = np.empty(len(scores), np.int64)
    place[order] = np.arange(len(scores)) - np.repeat(cut[:-1], np.diff(cut))
    return place


def _discounts(place: np.ndarray, top: int) -> np.ndarray:
    return np.where(place < top, 1 / np.log2(place + 2.0), 0.0)


def ideal(labels: np.ndarray, cut: np.ndarray, top: int) -> np.ndarray:
    """The greatest DCG of each session."""
    owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    return np.bincount(owner, (2.0**labels - 1) * _discounts(ranks(labels, cut), top), len(cut) - 1)


def ndcg(scores: np.ndarray, labels: np.ndarray, cut: np.ndarray, top: int) -> np.ndarray:
    """NDCG of each session, NaN where no row has a positive label."""
    owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    got = np.bincount(owner, (2.0**labels - 1) * _discounts(ranks(scores, cut), top), len(cut) - 1)
    best = ideal(labels, cut, top)
    return np.where(best > 0, got / np.where(best > 0, best, 1), np.nan)


def _pairs(labels: np.ndarray, cut: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (better, worse) of one session, in parts of bounded size."""
    owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    least = np.full(len(cut) - 1, np.inf)
    np.minimum.at(least, owner, labels)
    better = np.flatnonzero(labels > least[owner])
    size = np.diff(cut)[owner[better]]
    at = 0
    while at < len(better):
        total = np.cumsum(size[at:])
        stop = at + max(1, int(np.searchsorted(total, PAIRS_AT_ONCE, side="right")))
        own, n = better[at:stop], size[at:stop]
        i = np.repeat(own, n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(cut[owner[own]], n)
        worse = labels[j] < labels[i]
        yield i[worse], j[worse]
        at = stop


def gradients(settings: Settings, scores: np.ndarray, labels: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by each row's score.

    ``binary`` is the logistic loss of a row. ``pairwise`` is that of the difference of a better and a worse row
    of a session, over all such pairs; ``lambdarank`` weighs each pair by what its exchange would change
    in the session's NDCG, so only pairs with a row among the ``top`` count.
    """
    n = len(scores)
    if settings.objective == "binary":
        p = 1 / (1 + np.exp(-scores))
        return p - labels, p * (1 - p)
    g, h = np.zeros(n), np.zeros(n)
    ranked = settings.objective == "lambdarank"
    if ranked:
        discount = _discounts(ranks(scores, cut), settings.top)
        best = ideal(labels, cut, settings.top)
        scale = np.repeat(np.where(best > 0, 1 / np.where(best > 0, best, 1), 0), np.diff(cut))
    for i, j in _pairs(labels, cut):
        p = 1 / (1 + np.exp(scores[i] - scores[j]))
        weight = np.ones(len(i))
        if ranked:
            weight = np.abs((2.0 ** labels[i] - 2.0 ** labels[j]) * (discount[i] - discount[j])) * scale[i]
        first, second = p * weight, p * (1 - p) * weight
        g += np.bincount(j, first, n) - np.bincount(i, first, n)
        h += np.bincount(i, second, n) + np.bincount(j, second, n)
    return g, h


# ---- blocks


def _clean(df: DataFrame, features: Sequence[str]) -> DataFrame:
    names = [f"_f{i}" for i in range(len(features))]
    copy = encode(df.withColumns({n: F.col(c) for n, c in zip(names, features)}), [], names)
    return copy.withColumn("_x", F.array(*names) if names else F.array().cast("array<double>")).drop(*names)


def bin_limits(rows: DataFrame, n_features: int, max_bin: int) -> list[np.ndarray]:
    """Upper limits of all bins but the last, of each feature: quantiles, each value once."""
    shares = F.array(*[F.lit(i / max_bin) for i in range(1, max_bin)])
    found = rows.agg(*[F.percentile_approx(F.col("_x")[i], shares, 20_000).alias(f"q{i}") for i in range(n_features)]).first() if n_features else ()
    return [np.unique(np.array(q if q is not None else [], float)) for q in found]


def _list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _blocks(rows: DataFrame, limits: list[np.ndarray], n_models: int, block_rows: int) -> DataFrame:
    """Whole sessions in blocks of ``block_rows`` rows or a little more, sorted by (session, aid).

    A session is held by one task; its candidates are no more than the catalogue has items.
    """
    binner = Forest([], limits)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 33, [], 0

        def block(part: pa.Table) -> pa.RecordBatch:
            session = part.column("session").combine_chunks()
            key = session.fill_null(-(2**63)).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            flat = part.column("_x").combine_chunks()
            x = flat.flatten().to_numpy().reshape(len(key), -1) if limits else np.zeros((len(key), 0))
            first = pa.array(cut[:-1])
            values = [
                pa.array([number]), _list(session.take(first)), _list(pa.array(np.diff(cut).astype(np.int32))),
                _list(part.column("_fold").combine_chunks().take(first)), _list(part.column("aid").combine_chunks()),
                pa.array([part.column("_y").to_numpy().astype(np.float64).tobytes()]), pa.array([binner.binned(x).astype(np.uint8).tobytes()]),
                pa.array([np.zeros((n_models, len(key))).tobytes()]),
            ]
            return pa.RecordBatch.from_arrays(values, _NAMES)

        def last_session(table: pa.Table) -> int:
            """Where the last session begins, which the next batch may go on with."""
            key = table.column("session").combine_chunks().fill_null(-(2**63)).to_numpy()
            return int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= block_rows:
                table = pa.Table.from_batches(held)
                at = last_session(table)
                if at:
                    yield block(table.slice(0, at))
                    number += 1
                held, size = table.slice(at).combine_chunks().to_batches(), table.num_rows - at
        if held:
            yield block(pa.Table.from_batches(held))

    dealt = rows.select("session", "aid", "_fold", "_y", "_x").repartition("session").sortWithinPartitions("session", "aid")
    return dealt.mapInArrow(packed, BLOCKS)


class _Open:
    """A block as arrays."""

    def __init__(self, row: dict, n_features: int, n_models: int):
        self.sizes = np.array(row["sizes"], np.int64)
        self.cut = np.concatenate([[0], np.cumsum(self.sizes)])
        n = int(self.cut[-1])
        self.fold = np.repeat(np.array(row["folds"], np.int64), self.sizes)
        self.labels = np.frombuffer(row["labels"], np.float64)
        self.bins = np.frombuffer(row["bins"], np.uint8).reshape(n_features, n)
        self.scores = np.frombuffer(row["scores"], np.float64).reshape(n_models, n)
        self.row = row

    def drawn(self, share: float, seed: int) -> np.ndarray:
        """Rows of a round's sample, by session and item alone."""
        if share >= 1:
            return np.ones(len(self.labels), bool)
        session = np.repeat(np.array([s or 0 for s in self.row["sessions"]], np.int64), self.sizes).astype(np.uint64)
        h = session * np.uint64(0x9E3779B97F4A7C15) + np.array([a or 0 for a in self.row["aids"]], np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed)
        for s in (30, 27, 31):
            h ^= h >> np.uint64(s)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(11)).astype(np.float64) < share * 2.0**53


# ---- training


_HISTOGRAM = "model int, node int, feature int, g array<double>, h array<double>, n array<double>"


def _pass(blocks: DataFrame, forests: list[Forest], since: list[int], growing: dict[int, Tree], active: list[int], folds: list, settings: Settings, round_: int, watch: bool) -> DataFrame:
    """Partial histograms of the nodes that are to be split, and the held-out measure under node -1.

    ``since`` is the number of trees that the written scores hold.
    """
    n_features, n_models = len(forests[0].limits), len(forests)
    recent = {m: Forest([], [], trees=forests[m].trees[since[m] :]) for m in active}
    width = max([len(limits) for limits in forests[0].limits], default=0) + 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                b = _Open(row, n_features, n_models)
                inside = b.drawn(settings.row_share, settings.seed * 1_000_003 + round_)
                for m in active:
                    scores = b.scores[m] + recent[m].scores(b.bins)
                    train = np.ones(len(scores), bool) if folds[m] is None else b.fold != folds[m]
                    if watch and not train.all():
                        value = _watched(settings, b, scores, ~train)
                        seen[m] = seen.get(m, 0) + np.array([np.nansum(value), np.isfinite(value).sum()])
                    g, h = gradients(settings, scores, b.labels, b.cut)
                    use = np.flatnonzero(train & inside)
                    node = growing[m].leaves(b.bins[:, use])
                    open_ = growing[m].value[node] != growing[m].value[node]  # NaN: still to be split
                    use, node = use[open_], node[open_]
                    for k in np.unique(node).tolist():
                        own = use[node == k]
                        sums = total.setdefault((m, k), np.zeros((3, n_features, width)))
                        for f in range(n_features):
                            at = b.bins[f, own]
                            sums[0, f] += np.bincount(at, g[own], width)
                            sums[1, f] += np.bincount(at, h[own], width)
                            sums[2, f] += np.bincount(at, minlength=width)
        rows = [(m, k, f, *(s[i, f] for i in range(3))) for (m, k), s in total.items() for f in range(n_features)]
        rows += [(m, -1, -1, v[:1], v[1:], np.zeros(1)) for m, v in seen.items()]
        if rows:
            kinds = [pa.int32()] * 3 + [pa.list_(pa.float64())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["model", "node", "feature", "g", "h", "n"])

    return blocks.mapInArrow(summed, _HISTOGRAM)


def _watched(settings: Settings, b: _Open, scores: np.ndarray, held: np.ndarray) -> np.ndarray:
    """What is better when greater, of each held-out session or row."""
    if settings.objective == "binary":
        s, y = scores[held], b.labels[held]
        return -(np.logaddexp(0, s) - y * s)
    own = held[np.minimum(b.cut[:-1], len(held) - 1)]
    return ndcg(scores, b.labels, b.cut, settings.metric_top)[own]


def _shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def _merged(settings: Settings, allowed: dict[int, list[int]]):
    """The best limit of a (model, node, feature) from its partial histograms; of node -1 the sums."""
    schema = pa.schema([("model", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64()), ("left", pa.list_(pa.float64())), ("all", pa.list_(pa.float64()))])

    def run(part: pa.Table) -> pa.Table:
        m, node, f = (part.column(c)[0].as_py() for c in ("model", "node", "feature"))
        g, h, n = (np.sum([np.array(v) for v in part.column(c).to_pylist()], axis=0) for c in "ghn")
        total = [float(g.sum()), float(h.sum()), float(n.sum())]
        row = (m, node, f, -1, float("-inf"), [0.0] * 3, total)
        if node >= 0 and f in allowed[m] and len(g) > 1:
            left = np.stack([np.cumsum(v)[:-1] for v in (g, h, n)])
            right = np.array(total)[:, None] - left

            def value(s):
                return _shrunk(s[0], settings.l1) ** 2 / np.maximum(s[1] + settings.l2, 1e-12)

            gain = value(left) + value(right) - value(np.array(total))
            fine = (left[2] >= settings.min_rows) & (right[2] >= settings.min_rows)
            gain = np.round(np.where(fine, gain, -np.inf), 10)
            b = int(gain.argmax())
            if gain[b] > 0:
                row = (m, node, f, b, float(gain[b]), left[:, b].tolist(), total)
        return pa.table([pa.array([v], k) for v, k in zip(row, schema.types, strict=True)], schema=schema)

    return run, "model int, node int, feature int, bin int, gain double, left array<double>, all array<double>"


def best_splits(histograms: DataFrame, settings: Settings, allowed: dict[int, list[int]]) -> list:
    """The best split of each (model, node): greatest gain, then first feature. A row for each open node."""
    run, schema = _merged(settings, allowed)
    found = histograms.groupBy("model", "node", "feature").applyInArrow(run, schema)
    best = F.max_by(F.struct("feature", "bin", "gain", "left", "all"), F.struct("gain", -F.col("feature"))).alias("b")
    return found.groupBy("model", "node").agg(best).select("model", "node", "b.*").collect()


def _allowed(settings: Settings, n_features: int, round_: int, models: Sequence[int]) -> dict[int, list[int]]:
    out = {}
    for m in models:
        keep = max(1, int(np.ceil(settings.feature_share * n_features)))
        out[m] = sorted(np.random.default_rng([settings.seed, round_, m]).permutation(n_features)[:keep].tolist())
    return out


def _grown(blocks, forests, since, active, folds, settings, round_, watch) -> dict[int, Tree]:
    """The next tree of each active model, level by level; the first pass also watches the held-out folds."""
    size = 2 ** (settings.depth + 1) - 1
    trees = {m: Tree(np.full(size, -1), np.zeros(size, np.int64), np.full(size, np.nan), np.zeros(size)) for m in active}
    allowed = _allowed(settings, len(forests[0].limits), round_, active)
    for level in range(settings.depth):
        open_ = [m for m in active if level == 0 or np.isnan(trees[m].value[2**level - 1 : 2 ** (level + 1) - 1]).any()]
        if not open_:
            break
        for r in best_splits(_pass(blocks, forests, since, trees, open_, folds, settings, round_, watch and level == 0), settings, allowed):
            m, node, tree = r["model"], r["node"], trees[r["model"]]
            if node < 0:
                forests[m].watched.append(r["all"][0] / r["all"][1] if r["all"][1] else float("nan"))
                continue

            def leaf(s):
                return float(-settings.step * _shrunk(s[0], settings.l1) / max(s[1] + settings.l2, 1e-12))

            if r["bin"] < 0:
                tree.value[node] = leaf(r["all"])
                continue
            tree.feature[node], tree.bin[node], tree.gain[node], tree.value[node] = r["feature"], r["bin"], r["gain"], 0.0
            for child, s in ((2 * node + 1, r["left"]), (2 * node + 2, [a - b for a, b in zip(r["all"], r["left"], strict=True)])):
                # the last level's nodes are leaves, the others are still to be split
                tree.value[child] = leaf(s) if level + 1 == settings.depth else np.nan
        for m in open_:  # nodes that no drawn row reached, and the children of leaves
            own = slice(2**level - 1, 2 ** (level + 1) - 1)
            tree = trees[m]
            tree.value[own] = np.where(np.isnan(tree.value[own]), 0.0, tree.value[own])
            below = np.arange(2 ** (level + 1) - 1, 2 ** (level + 2) - 1)
            unborn = below[tree.feature[(below - 1) // 2] < 0]
            tree.value[unborn] = 0.0
    return trees


def _rescored(blocks: DataFrame, forests: list[Forest], since: list[int]) -> DataFrame:
    """The blocks with the scores of all trees."""
    n_features, n_models = len(forests[0].limits), len(forests)
    recent = [Forest([], [], trees=f.trees[s:]) for f, s in zip(forests, since, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for row in batch.to_pylist():
                b = _Open(row, n_features, n_models)
                scores.append((b.scores + np.stack([f.scores(b.bins) for f in recent])).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.binary())], _NAMES)

    return blocks.mapInArrow(run, BLOCKS)


def prepared(df: DataFrame, features: Sequence[str], label: str, fold: str | None, settings: Settings, n_models: int = 1, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, list[np.ndarray]]:
    """The written blocks of all rows and the limits of their bins."""
    if settings.max_bin > 256:
        raise ValueError("a bin is one byte: max_bin is 256 at most")
    own = F.coalesce(F.col(fold).cast("int"), F.lit(-1)) if fold else F.lit(0)
    y = F.coalesce(F.col(label).cast("double"), F.lit(0.0))
    rows = stage(_clean(df, features).select(F.col("session").cast("long"), F.col("aid").cast("long"), own.alias("_fold"), y.alias("_y"), "_x"))
    limits = bin_limits(rows, len(features), settings.max_bin)
    return _blocks(rows, limits, n_models, block_rows), limits


def _folds(df: DataFrame, fold: str) -> list[int]:
    """The values of a fold column, sorted; NULL is -1."""
    found = df.select(F.coalesce(F.col(fold).cast("int"), F.lit(-1)).alias("f")).distinct().limit(MAX_FOLDS + 1).collect()
    if len(found) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} folds in {fold}")
    return sorted(r["f"] for r in found)


def boost(df: DataFrame, features: Sequence[str], label: str, fold: str | None = "fold", settings: Settings = Settings(), block_rows: int = BLOCK_ROWS) -> list[Forest]:
    """A forest for each value of ``fold``, trained on the other folds and watched on its own; without ``fold`` one on all rows.

    Training of a fold stops when its measure (mean NDCG at ``metric_top`` of held-out sessions with a positive row;
    for ``binary`` the mean log likelihood) has not grown for ``patience`` rounds, and the forest keeps the rounds up to the best.
    Without ``fold`` all ``rounds`` are made.

    NULL, NaN and infinite features are cleaned as for the other learners, NULL labels are 0, NULL folds a fold of their own.
    A session's rows must share a fold. Equal scores are ranked by item. No rows give forests without trees.
    """
    spark = df.sparkSession
    folds = _folds(df, fold) if fold else [None]
    if not folds or not features:
        return [Forest(list(features), [np.zeros(0)] * len(features), f) for f in folds]
    made, limits = prepared(df, features, label, fold, settings, len(folds), block_rows)
    blocks, path = written(made)
    forests = [Forest(list(features), limits, f) for f in folds]
    since, active = [0] * len(folds), list(range(len(folds)))
    for round_ in range(settings.rounds):
        trees = _grown(blocks, forests, since, active, folds, settings, round_, fold is not None)
        active = [m for m in active if fold is None or len(forests[m].watched) - 1 - forests[m].best < settings.patience]
        for m in active:
            forests[m].trees.append(trees[m])
        if not active:
            break
        if (round_ + 1) % SNAPSHOT == 0:
            old = path
            blocks, path = written(_rescored(blocks, forests, since))
            since = [len(f.trees) for f in forests]
            remove(spark, old)
    if fold and active:  # what the last trees are worth
        stop = {m: Tree(np.array([-1]), np.array([0]), np.array([0.0]), np.array([0.0])) for m in active}
        last = _pass(blocks, forests, since, stop, active, folds, settings, settings.rounds, True)
        for r in best_splits(last, settings, {m: [] for m in active}):
            if r["node"] < 0:
                forests[r["model"]].watched.append(r["all"][0] / r["all"][1] if r["all"][1] else float("nan"))
    remove(spark, path)
    for f in forests:
        f.trees = f.trees[: f.best] if fold else f.trees
    return forests


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """A written table and its folder, for the one who removes it."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def second_fit(df: DataFrame, features: Sequence[str], label: str, forests: Sequence[Forest], settings: Settings = Settings()) -> Forest:
    """One forest on all rows, with the mean of the folds' best numbers of rounds."""
    rounds = round(float(np.mean([len(f.trees) for f in forests]))) if forests else 0
    return boost(df, features, label, None, replace(settings, rounds=max(1, rounds)))[0]


# ---- use


def score(df: DataFrame, forests: Sequence[Forest], name: str = "pred", fold: str | None = None) -> DataFrame:
    """Adds the mean score of the forests or, with ``fold``, that of the forest whose fold a row is in."""
    forests = list(forests)
    features = forests[0].features

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, own in batches:
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if features else np.zeros((len(x), 0))
            bins = forests[0].binned(x)
            each = np.stack([f.scores(bins) for f in forests])
            if fold is None:
                out = each.mean(axis=0)
            else:
                place = {f.fold: i for i, f in enumerate(forests)}
                at = np.array([place.get(v, -1) for v in own.to_pylist()], np.int64)
                out = np.where(at >= 0, each[at, np.arange(len(x))], each.mean(axis=0))
            yield pa.array(out)

    own = F.coalesce(F.col(fold).cast("int"), F.lit(-1)) if fold else F.lit(-1)
    return _clean(df, features).withColumn("_own", own).withColumn(name, arrow_udf(run, "double")("_x", "_own")).drop("_x", "_own")


def cross_rank(df: DataFrame, features: Sequence[str], label: str, fold: str = "fold", settings: Settings = Settings()) -> tuple[list[Forest], DataFrame]:
    """The folds' forests, and (session, aid, pred) of every row by the forest that did not see its session."""
    forests = boost(df, features, label, fold, settings)
    return forests, score(df, forests, "pred", fold).select("session", "aid", "pred")


def first_gradients(df: DataFrame, label: str, settings: Settings = Settings()) -> DataFrame:
    """(session, aid, grad, hess) of every row at score 0."""
    blocks, _ = prepared(df, [], label, None, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Open(row, 0, 1)
                g, h = gradients(settings, b.scores[0], b.labels, b.cut)
                session = np.repeat(np.array(row["sessions"], object), b.sizes)
                yield pa.RecordBatch.from_arrays([pa.array(session, pa.int64()), pa.array(row["aids"], pa.int64()), pa.array(g), pa.array(h)], ["session", "aid", "grad", "hess"])

    return blocks.mapInArrow(run, "session long, aid long, grad double, hess double")


def first_splits(df: DataFrame, features: Sequence[str], label: str, fold: str = "fold", settings: Settings = Settings()) -> DataFrame:
    """(fold, feature, limit, gain) of the first split of each fold's first tree, from all rows and features; none where no split gains."""
    whole = replace(settings, depth=1, feature_share=1.0, row_share=1.0)
    folds = _folds(df, fold)
    made, limits = prepared(df, features, label, fold, whole, len(folds))
    blocks, path = written(made)
    forests = [Forest(list(features), limits, f) for f in folds]
    trees = _grown(blocks, forests, [0] * len(folds), list(range(len(folds))), folds, whole, 0, False) if folds else {}
    remove(df.sparkSession, path)
    rows = [(folds[m], features[t.feature[0]], float(limits[t.feature[0]][t.bin[0]]), float(t.gain[0])) for m, t in trees.items() if t.feature[0] >= 0]
    return df.sparkSession.createDataFrame(rows, "fold int, feature string, limit double, gain double")


def gains(spark: SparkSession, forests: Sequence[Forest]) -> DataFrame:
    """Mean and deviation over the folds of a feature's total gain, greatest first."""
    rows = []
    for f in forests:
        total = np.zeros(len(f.features))
        for t in f.trees:
            np.add.at(total, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        rows += list(zip(f.features, total.tolist(), strict=True))
    table = spark.createDataFrame(rows, "feature string, gain double").groupBy("feature")
    return table.agg(F.avg("gain").alias("mean"), F.stddev_pop("gain").alias("std")).orderBy(F.col("mean").desc(), "feature")
