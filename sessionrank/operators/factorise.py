"""Vectors learned from weighted pairs by negative sampling, in blocks: skip-gram and Bayesian personalised ranking.

Left and right ids are numbered and dealt to B blocks each; the pairs of a left and a right block are a cell, so no
cell has more than a bounded number of pairs or vectors. In a step, cells that share no block are trained side by
side, each by one task on its two blocks of vectors; B steps visit every cell once. Vectors travel as rows of a block;
neither the driver nor a task ever holds all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessionrank.functions.hashing import draw
from sessionrank.operators.dataset import ordered_ids
from sessionrank.settings import remove, shared_dir, stage

CELL_PAIRS = 1_000_000
BLOCK_IDS = 50_000
BATCH = 512
INNER = 10
EPSILON = 1e-8


@dataclass(frozen=True)
class Settings:
    """``loss``: ``skipgram`` (a pair against each of ``negatives`` noise items) or ``bpr`` (an item above a noise item, with item biases)."""

    loss: str = "skipgram"
    dim: int = 64
    passes: int = 100
    step: float = 0.05
    negatives: int = 5
    decay: float = 0.0
    seed: int = 0
    cell_pairs: int = CELL_PAIRS
    block_ids: int = BLOCK_IDS

    @property
    def width(self) -> int:
        """Of a row of vectors: with a bias where the loss has one."""
        return self.dim + (self.loss == "bpr")


def mixed(left: np.ndarray, right: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """A number of 32 bits from two ids and a turn, by products and shifts that SQL has as well."""
    m = np.uint64(0xFFFFFFFF)
    h = (left.astype(np.uint64) * np.uint64(73856093) + right.astype(np.uint64) * np.uint64(19349663) + np.uint64(turn) * np.uint64(83492791) + np.uint64(seed)) & m
    for factor in (2246822519, 3266489917):
        h ^= h >> np.uint64(15)
        h = (h * np.uint64(factor)) & m
    return h ^ (h >> np.uint64(16))


def mixed_sql(left: str, right: str, turn: str, seed: int) -> str:
    """``mixed`` as SQL over integers."""
    h = f"((({left}) * 73856093 + ({right}) * 19349663 + ({turn}) * 83492791 + {seed}) % 4294967296)"
    for factor in (2246822519, 3266489917):
        h = f"CAST((CAST(xor({h}, {h} >> 15) AS HUGEINT) * {factor}) % 4294967296 AS BIGINT)"
    return f"xor({h}, {h} >> 16)"


def noise_draws(left: np.ndarray, right: np.ndarray, turn: int, seed: int, upto: np.ndarray) -> np.ndarray:
    """Places of noise items: the one whose share of the running sum of noise weights the draw falls into."""
    u = mixed(left, right, turn, seed) / 4294967296.0 * upto[-1]
    return np.minimum(np.searchsorted(upto, np.floor(u), side="right"), len(upto) - 1)


def _start(ids: np.ndarray, settings: Settings, side: str) -> np.ndarray:
    """First vectors, by id alone: uniform in +-1/2 over the dimension; contexts of skip-gram at 0."""
    out = np.zeros((len(ids), settings.width), np.float32)
    if settings.loss == "bpr" or side == "l":
        for c in range(settings.dim):
            out[:, c] = (mixed(ids, np.full(len(ids), c), 7 if side == "l" else 11, settings.seed) / 4294967296.0 - 0.5) / settings.dim
    if settings.loss == "bpr" and side == "l":
        out[:, -1] = 1  # the other side's bias
    return out


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``rows`` once, and the sum of its ``values``."""
    order = np.argsort(rows, kind="stable")
    own = rows[order]
    first = np.concatenate([[True], own[1:] != own[:-1]])
    at = np.flatnonzero(first)
    if 4 * len(at) < 3 * len(own):
        return own[at], np.add.reduceat(values.take(order, axis=0), at, axis=0)
    total = values.take(order[at], axis=0)  # few repeats: they are added one by one
    again = np.flatnonzero(~first)
    np.add.at(total, np.cumsum(first)[again] - 1, values[order[again]])
    return own[at], total


class _Side:
    """A block's vectors with the sums of squared gradients by which its steps are scaled."""

    def __init__(self, row: bytes, n: int, width: int, fixed: bool):
        both = np.frombuffer(row, np.float32).reshape(2, n, width).copy()
        self.v, self.g2, self.fixed = both[0], both[1], fixed

    def step(self, rows: np.ndarray, grad: np.ndarray, settings: Settings) -> None:
        own, total = _summed(rows, grad)
        if self.fixed:
            total[:, -1] = 0
        squares = total * total
        squares += self.g2.take(own, axis=0)
        self.g2[own] = squares
        squares += EPSILON
        total *= settings.step
        total /= np.sqrt(squares, out=squares)
        self.v[own] = self.v.take(own, axis=0) - total

    def bytes(self) -> bytes:
        return np.stack([self.v, self.g2]).tobytes()


def _train_cell(left: _Side, right: _Side, l: np.ndarray, r: np.ndarray, w: np.ndarray, ids, upto: np.ndarray, passes: range, settings: Settings) -> None:
    """Some passes over the pairs of a cell, in an order and with noise drawn anew in each.

    What is drawn for a pass does not depend on the vectors, so it is drawn for all pairs at once, as they lie.
    """
    l_ids, r_ids = ids
    l, r = l.astype(np.int64), r.astype(np.int64)
    known = np.sort(l << 32 | r)
    per_pair = 1 if settings.loss == "bpr" else settings.negatives
    for turn in passes:
        noise = [noise_draws(l_ids[l], r_ids[r], turn * per_pair + k, settings.seed, upto) for k in range(per_pair)]
        order = np.argsort(mixed(l_ids[l], r_ids[r], turn, settings.seed + 1), kind="stable")
        if settings.loss == "bpr":
            key = l << 32 | noise[0]
            unseen = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] != key
        for a in range(0, len(order), BATCH):
            at = order[a : a + BATCH]
            if settings.loss == "bpr":
                at = at[unseen[at]]
                if not len(at):
                    continue
            i, j, weight = l[at], r[at], w[at][:, None]
            u, v = left.v.take(i, axis=0), right.v.take(j, axis=0)
            if settings.loss == "bpr":
                z = noise[0][at]
                other = right.v.take(z, axis=0)
                gap = v - other
                d = weight / (1 + np.exp(np.clip(np.einsum("ij,ij->i", u, gap)[:, None], -30, 30)))
                du = d * u
                grads = [(left, i, settings.decay * u - d * gap), (right, np.concatenate([j, z]), np.concatenate([settings.decay * v - du, settings.decay * other + du]))]
            else:
                d = -weight / (1 + np.exp(np.clip((u * v).sum(axis=1, keepdims=True), -30, 30)))
                gl, rows, gr = d * v, [j], [d * u]
                for k in range(settings.negatives):
                    z = noise[k][at]
                    other = right.v.take(z, axis=0)
                    d = weight * (z != j)[:, None] / (1 + np.exp(-np.clip((u * other).sum(axis=1, keepdims=True), -30, 30)))
                    gl = gl + d * other
                    rows.append(z)
                    gr.append(d * u)
                grads = [(left, i, gl), (right, np.concatenate(rows), np.concatenate(gr))]
            for side, rows_, grad in grads:
                side.step(rows_, grad.astype(np.float32, copy=False), settings)


def numbered(pairs: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ids of both sides as numbers in a random order, so that a block has ids of all kinds, and the pairs as (l, r, w)."""
    pairs = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull())

    def ids(c: str, name: str) -> DataFrame:
        placed = pairs.select(F.struct(draw(c).alias("at"), F.col(c).alias("id")).alias("_o"))
        return stage(ordered_ids(placed, "_o", name).select(F.col("_o.id").alias(c), name))

    l, r = ids(left, "l"), ids(right, "r")
    return l, r, stage(pairs.join(l, left).join(r, right).select("l", "r", F.col("w").cast("double").alias("w")))


def blocks_of(pairs: DataFrame, n_left: int, n_right: int, settings: Settings) -> int:
    """B, so that a block has ``block_ids`` ids at most and a cell about ``cell_pairs`` pairs, also with an id in very many pairs."""
    hot = [pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first() for c in ("l", "r")]
    n, most = hot[0][1] or 0, max(h[0] or 0 for h in hot)
    return max(1, -(-max(n_left, n_right) // settings.block_ids), int(np.ceil(np.sqrt(n / settings.cell_pairs))), -(-most // settings.cell_pairs))


def learned(pairs: DataFrame, left: str, right: str, noise: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(left id, vector) and (right id, vector) from ``pairs`` (left, right, w: weight) and ``noise`` (right id, w: integer weight).

    A pass goes once over all pairs; ``INNER`` passes over a cell are made in one visit, all of them where there
    is one cell. A pair's noise items come from the cell's right block, by their weights; for ``bpr``
    an item that the left id has is no noise. Steps are scaled by each number's sum of squared gradients.
    Pairs with a null id are left out; ids without noise weight have 0; no pairs give no vectors. Everything that is drawn depends on the
    ids' numbers and the seed alone.
    """
    spark = pairs.sparkSession
    l, r, rows = numbered(pairs, left, right)
    n_left, n_right = l.count(), r.count()
    b = blocks_of(rows, n_left, n_right, settings)
    mean = rows.agg(F.avg("w")).first()[0] or 1.0
    celled = rows.select(
        (F.col("l") % b).cast("int").alias("bl"), (F.col("r") % b).cast("int").alias("br"), F.floor(F.col("l") / F.lit(float(b))).cast("int").alias("l"),
        F.floor(F.col("r") / F.lit(float(b))).cast("int").alias("r"), (F.col("w") / mean).cast("float").alias("w"),
    )
    weights = noise.groupBy(right).agg(F.sum("w").cast("long").alias("w")).join(r, right, "right").select("r", F.coalesce("w", F.lit(0)).alias("w"))
    weighed = weights.select((F.col("r") % b).cast("int").alias("br"), F.floor(F.col("r") / F.lit(float(b))).cast("int").alias("r"), "w")

    def packed(key, part):
        part = part.sort_by([("l", "ascending"), ("r", "ascending")])
        return pa.table({"bl": pa.array([key[0].as_py()], pa.int32()), "br": pa.array([key[1].as_py()], pa.int32()), **{c: pa.array([part.column(c).to_numpy().tobytes()], pa.binary()) for c in "lrw"}})

    def sums(key, part):
        part = part.sort_by("r")
        return pa.table({"br": pa.array([key[0].as_py()], pa.int32()), "upto": pa.array([np.cumsum(part.column("w").to_numpy()).astype(np.int64).tobytes()], pa.binary())})

    cells = stage(celled.groupBy("bl", "br").applyInArrow(packed, "bl int, br int, l binary, r binary, w binary"))
    # a step reads the cells of its own folder only
    cells = cells.join(weighed.groupBy("br").applyInArrow(sums, "br int, upto binary"), "br").select("*", ((F.col("br") - F.col("bl") + b) % b).alias("step"))
    kept, cells_type = shared_dir(spark), cells.schema
    cells.write.partitionBy("step").parquet(kept)

    def started(side: str, n: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    v = _start(np.arange(k, n, b), settings, side)
                    yield pa.RecordBatch.from_arrays([pa.array([side]), pa.array([k], pa.int32()), pa.array([np.stack([v, np.zeros_like(v)]).tobytes()])], ["side", "block", "v"])

        return spark.range(b).select(F.col("id").cast("int")).mapInArrow(run, "side string, block int, v binary")

    def trained(turns: range):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ids = np.arange(row["bl"], n_left, b), np.arange(row["br"], n_right, b)
                    two = [_Side(row[c], len(k), settings.width, settings.loss == "bpr" and c == "vl") for c, k in zip(("vl", "vr"), ids, strict=True)]
                    if row["l"] is not None:
                        _train_cell(*two, *(np.frombuffer(row[c], k) for c, k in (("l", np.int32), ("r", np.int32), ("w", np.float32))), ids, np.frombuffer(row["upto"], np.int64), turns, settings)
                    for side, block, own in (("l", row["bl"], two[0]), ("r", row["br"], two[1])):
                        yield pa.RecordBatch.from_arrays([pa.array([side]), pa.array([block], pa.int32()), pa.array([own.bytes()], pa.binary())], ["side", "block", "v"])

        return run

    path = shared_dir(spark)
    started("l", n_left).union(started("r", n_right)).write.parquet(path)
    inner = settings.passes if b == 1 else INNER
    for first in range(0, settings.passes, inner):
        turns = range(first, min(settings.passes, first + inner))
        for s in range(b):
            state = spark.read.schema("side string, block int, v binary").parquet(path)
            vl = state.where("side = 'l'").select(F.col("block").alias("bl"), F.col("v").alias("vl"), ((F.col("block") + s) % b).alias("br"))
            vr = state.where("side = 'r'").select(F.col("block").alias("br"), F.col("v").alias("vr"))
            own = spark.read.schema(cells_type).parquet(kept).where(F.col("step") == s).drop("step")
            now = vl.join(vr, "br").join(own, ["bl", "br"], "left")
            new = shared_dir(spark)
            # a cell is a row: each goes to a task of its own
            now.repartitionById(b, F.col("bl")).mapInArrow(trained(turns), "side string, block int, v binary").write.parquet(new)
            remove(spark, path)
            path = new
    state = spark.read.schema("side string, block int, v binary").parquet(path)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for side, block, v in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.arange(block, n_left if side == "l" else n_right, b)
                v = np.frombuffer(v, np.float32).reshape(2, len(ids), settings.width)[0].astype(np.float64)
                for a in range(0, len(ids), 4096):
                    x = v[a : a + 4096]
                    lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, settings.width, dtype=np.int32), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 4096]), lists], ["_n", "vector"])

    out = [state.where(F.col("side") == s).mapInArrow(opened, "_n long, vector array<double>") for s in "lr"]
    return (
        out[0].join(l, F.col("_n") == F.col("l")).select(left, "vector"),
        out[1].join(r, F.col("_n") == F.col("r")).select(right, "vector"),
    )


def bounded_by(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def drawn_noise(pairs: DataFrame, left: str, right: str, noise: DataFrame, turn: int = 0, seed: int = 0, unseen: bool = False) -> DataFrame:
    """(left, right, other): the noise item of each pair in one turn, where all ids are one block; ``unseen`` leaves out those that the left id has."""
    l, r, rows = numbered(pairs, left, right)
    table = noise.groupBy(right).agg(F.sum("w").cast("long").alias("w")).join(r, right, "right").select("r", F.coalesce("w", F.lit(0)).alias("w"))
    if not bounded_by(r, BLOCK_IDS):
        raise ValueError(f"more than {BLOCK_IDS} ids are several blocks")
    upto = np.cumsum([x["w"] for x in table.orderBy("r").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(noise_draws(a, b, turn, seed, upto).astype(np.int64))], ["l", "r", "o"])

    found = rows.select(F.col("l").cast("long"), F.col("r").cast("long")).mapInArrow(run, "l long, r long, o long")
    if unseen:
        found = found.join(rows.select("l", F.col("r").alias("o")), ["l", "o"], "left_anti")
    other = r.select(F.col("r").alias("o"), F.col(right).alias("other"))
    return found.join(l, "l").join(r, "r").join(other, "o").select(left, right, "other")
