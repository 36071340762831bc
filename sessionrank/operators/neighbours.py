"""Nearest neighbours by cosine: all blocks of queries meet all blocks of items, or those that an inverted file names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from sessionrank.functions import vectors as V
from sessionrank.settings import apart, stage

CELL_ROWS = 100_000
#: Cells of items that a task goes through, and rows and bytes of a block, at most.
ITEM_CELLS, BLOCK_ROWS, BLOCK_BYTES = 3, 2_048, 2**20
#: Queries of a task, as long as there are some tasks for each core.
TASK_QUERIES, CORE_TASKS = 16_384, 4
CHUNK_QUERIES, CHUNK_ITEMS, CHUNK_PAIRS = 512, 16_384, 65_536
BLOCK = "no long, ks binary, vs binary, ls binary, lists array<int>"
SCORED = "key long, aids array<long>, far array<double>"
#: Rows that centroids are learned from and queries that the recall is measured on, at most.
SAMPLE_ROWS, SAMPLE_QUERIES, MAX_LISTS = 100_000, 256, 4_096
RECALL = 0.95


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


def _products(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The products of the given pairs of rows in double precision, to 12 digits."""
    if len(row) * 8 > len(q) * len(x):
        return np.round((q @ x.T)[row, col], 12)
    out = np.empty(len(row))
    for a in range(0, len(row), CHUNK_PAIRS):
        at = slice(a, a + CHUNK_PAIRS)
        out[at] = np.einsum("ij,ij->i", q[row[at]], x[col[at]])
    return np.round(out, 12)


class _Best:
    """The ``width`` best items of each row of ``q`` among those met so far, equal values by id.

    Single precision finds the pairs that may be among them, all whose product is not below the least kept one by
    more than rounding can make; these alone are multiplied in double precision, and ranked once there are many.
    """

    def __init__(self, q: np.ndarray, width: int) -> None:
        self.q, self.q32, self.width = q, q.astype(np.float32), width
        self.margin = np.float32((q.shape[1] + 8) * 2.0**-22)  # unit vectors: four times what single precision can err
        self.least = np.full(len(q), -np.inf, np.float32)
        self.kept = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def meet(self, x: np.ndarray, ids: np.ndarray, asked: np.ndarray | None = None, lists: np.ndarray | None = None) -> None:
        """Compare ``q`` with the items ``x``; with ``asked`` (row, list) only with those in lists that a row asks for."""
        x32 = x.astype(np.float32)
        rows = np.arange(len(self.q)) if asked is None else np.flatnonzero(asked[:, np.unique(lists)].any(axis=1))
        for start in range(0, len(rows), CHUNK_QUERIES):
            at = rows[start : start + CHUNK_QUERIES]
            near = self.q32[at] @ x32.T
            if len(x) > self.width and (unbound := self.least[at] == -np.inf).any():
                fresh = at[unbound]
                known = ~np.isnan(first := near[unbound])
                if asked is not None:
                    known &= asked[fresh][:, lists]
                self.least[fresh] = np.partition(np.where(known, first, -np.inf), -self.width, axis=1)[:, -self.width] - self.margin
            row, col = np.divmod(np.flatnonzero(near >= (self.least[at] - self.margin)[:, None]), len(x))
            if asked is not None:
                mine = asked[at[row], lists[col]]
                row, col = row[mine], col[mine]
            if len(row):
                self.new.append((at[row], _products(self.q[at], x, row, col), ids[col]))
                self.waiting += len(row)
            if 2 * self.waiting >= len(self.q) * self.width:
                self.rank()

    def rank(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, value, id), the best first in each row."""
        if self.new:
            rows, values, ids = (np.concatenate(c) for c in zip(self.kept, *self.new))
            order = np.lexsort((ids, -values, rows))
            rows, values, ids = rows[order], values[order], ids[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            last = place == self.width - 1
            self.least[rows[last]] = values[last]
            keep = place < self.width
            self.kept, self.new, self.waiting = (rows[keep], values[keep], ids[keep]), [], 0
        return self.kept


def best_matches(k: int):
    """The ``k`` best items per query of two tables (k, v), equal values by id."""

    def run(queries: pa.Table, items: pa.Table) -> pa.Table:
        keys, (row, value, item) = np.empty(0, np.int64), _Best(np.empty((0, 0)), k).kept
        if queries.num_rows and items.num_rows:
            keys, i_ids = queries.column("k").to_numpy(), items.column("k").to_numpy()
            q, x = _matrix(queries.column("v"), len(keys)), _matrix(items.column("v"), len(i_ids))
            best = _Best(q, k)
            for start in range(0, len(i_ids), CHUNK_ITEMS):
                best.meet(x[start : start + CHUNK_ITEMS], i_ids[start : start + CHUNK_ITEMS])
            row, value, item = best.rank()
        return pa.table({"key": keys[row], "aid": item, "similarity": value})

    return run


def knn(
    queries: DataFrame,
    items: DataFrame,
    k: int = 50,
    key: str = "aid",
    query_vec: str = "vector",
    item_vec: str = "vector",
    cell_rows: int = CELL_ROWS,
    method: str = "exact",
    recall: float = RECALL,
    lists: int | None = None,
) -> DataFrame:
    """The ``k`` most similar items per query as (key, neighbor_aids, cosine_similarity), written.

    Queries and items are packed into blocks. A task reads its share of the blocks of either side, each of which is
    written once however many tasks read it, and keeps the best per query of all items that it goes through (some
    cells of ``cell_rows``); these lists are then reduced per query. ``method='exact'``: all blocks meet.
    ``method='ivf'``: every item is in the list of its nearest centroid, a query looks
    into as many of its nearest lists as a sample of queries needs to find ``recall`` of their exact
    neighbours, and no fewer than hold ``k`` items; inside lists the same exact products. Queries or items without a usable vector are left out.
    """
    if method not in ("exact", "ivf"):
        raise ValueError(f"method is exact or ivf, not {method}")

    def found() -> DataFrame:
        # read for its size and for the blocks
        q = stage(queries.where(V.norm(query_vec) > 0).select(F.col(key).alias("k"), V.unit(query_vec).alias("v")))
        i = stage(items.where(V.norm(item_vec) > 0).select(F.col("aid").alias("k"), V.unit(item_vec).alias("v")))
        if method == "ivf":
            q, i = _listed(q, i, k, recall, lists)
        return _best_lists(q, i, k, key, cell_rows)

    return apart(found)


def _ids(column: pa.Array) -> np.ndarray:
    if column.null_count:
        raise ValueError("an id of a query or an item is NULL")
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _blocks(df: DataFrame) -> DataFrame:
    """Rows packed into blocks: a number, the ids, the vectors, and what ``asked`` or ``list`` say with the lists named there.

    ``asked`` is a bit for each list that a query looks into, ``list`` the number of an item's list.
    """
    extra = next((c for c in ("asked", "list") if c in df.columns), None)

    def block(no: int, parts: list[tuple[np.ndarray, ...]]) -> dict:
        ks, vs, ls = (np.concatenate(p) for p in zip(*parts))
        if extra == "asked":
            lists = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(ls, axis=0)))
        else:
            lists = np.unique(ls)
        return {"no": no, "ks": ks.tobytes(), "vs": vs.tobytes(), "ls": ls.tobytes(), "lists": lists.tolist()}

    schema = pa.schema([("no", pa.int64()), ("ks", pa.binary()), ("vs", pa.binary()), ("ls", pa.binary()), ("lists", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, parts, held = TaskContext.get().partitionId() * 1_000_003, [], 0
        for batch in batches:
            rows = len(batch)
            if not rows:
                continue
            ks, vs = _ids(batch.column("k")), batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
            if extra == "asked":
                ls = np.frombuffer(b"".join(batch.column("asked").to_pylist()), np.uint8).reshape(rows, -1)
            else:
                ls = batch.column("list").to_numpy().astype(np.int32) if extra else np.zeros(rows, np.int32)
            most, a = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * vs.shape[1]))), 0
            while a < rows:
                b = min(rows, a + most - held)
                parts.append((ks[a:b], vs[a:b], ls[a:b]))
                held, a = held + b - a, b
                if held >= most:
                    yield pa.RecordBatch.from_pylist([block(no, parts)], schema)
                    no, parts, held = no + 1, [], 0
        if parts:
            yield pa.RecordBatch.from_pylist([block(no, parts)], schema)

    return df.mapInArrow(run, BLOCK)


def _dealt(blocks: DataFrame, parts: int) -> DataFrame:
    return blocks.repartitionById(parts, F.pmod("no", F.lit(parts)).cast("int"))


def _best_of_blocks(k: int, by_lists: bool):
    """Task function: the best items per query of the pairs of blocks that come, all of one block of queries in a row."""

    def lists(best: _Best, keys: np.ndarray) -> pa.RecordBatch:
        row, value, item = best.rank()
        kept, n = np.unique(row, return_counts=True)
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        aids, far = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (item, -value))
        return pa.RecordBatch.from_arrays([pa.array(keys[kept]), aids, far], ["key", "aids", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, asked, best = None, None, None, None
        for batch in batches:
            for n in range(len(batch)):
                no, x = batch.column("no")[n].as_py(), {c: np.frombuffer(batch.column(c)[n].as_buffer(), t) for c, t in (("i_ks", np.int64), ("i_vs", np.float64))}
                if no != at:
                    if best is not None:
                        yield lists(best, keys)
                    # copies, as the batch does not stay
                    at, keys = no, np.frombuffer(batch.column("ks")[n].as_py(), np.int64)
                    best = _Best(np.frombuffer(batch.column("vs")[n].as_py(), np.float64).reshape(len(keys), -1), k)
                    if by_lists:
                        asked = np.unpackbits(np.frombuffer(batch.column("ls")[n].as_py(), np.uint8).reshape(len(keys), -1), axis=1).view(bool)
                own = np.frombuffer(batch.column("i_ls")[n].as_buffer(), np.int32) if by_lists else None
                best.meet(x["i_vs"].reshape(len(x["i_ks"]), -1), x["i_ks"], asked, own)
        if best is not None:
            yield lists(best, keys)

    return run


def _best_lists(q: DataFrame, i: DataFrame, k: int, key: str, cell_rows: int) -> DataFrame:
    """(key, neighbor_aids, cosine_similarity) of written queries and items, and of those in the lists they ask for if any are named."""
    by_lists, n, m = "asked" in q.columns, q.count(), i.count()
    cores = q.sparkSession.sparkContext.defaultParallelism
    q_parts = max(1, -(-n // min(TASK_QUERIES, cell_rows)), min(-(-n // BLOCK_ROWS), CORE_TASKS * cores))
    i_parts = max(1, -(-m // (ITEM_CELLS * cell_rows)))
    left, right = _dealt(_blocks(q), q_parts), _dealt(_blocks(i), i_parts).select(*[F.col(c).alias(f"i_{c}") for c in ("ks", "vs", "ls", "lists")])
    met = left.hint("shuffle_replicate_nl").join(right, F.arrays_overlap("lists", "i_lists") if by_lists else None, "inner" if by_lists else "cross")
    scored = met.select("no", "ks", "vs", "ls", "i_ks", "i_vs", "i_ls").mapInArrow(_best_of_blocks(k, by_lists), SCORED)
    near = F.flatten(F.collect_list(F.arrays_zip("far", "aids")))
    top = scored.groupBy("key").agg(F.slice(F.sort_array(near), 1, k).alias("n"))
    return top.select(F.col("key").alias(key), F.col("n.aids").alias("neighbor_aids"), F.transform("n.far", lambda x: -x).alias("cosine_similarity"))


def _sampled(df: DataFrame, rows: int) -> DataFrame:
    """The rows with the smallest hashes of their ids."""
    return df.orderBy(F.xxhash64("k"), "k").limit(rows)


def centroids(items: DataFrame, lists: int, seed: int = 0) -> np.ndarray:
    """Unit centres of ``lists`` groups of the sampled unit vectors; ``MAX_LISTS`` at most, so a task can hold them."""
    model = KMeans(k=max(2, min(lists, MAX_LISTS)), maxIter=10, seed=seed, distanceMeasure="cosine").fit(
        stage(_sampled(items, SAMPLE_ROWS).select(array_to_vector("v").alias("features")))
    )
    c = np.array(model.clusterCenters())
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)


def _vectors_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def _order(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The numbers of the centres, nearest first, equal ones by number."""
    return np.argsort(-np.round(v @ centres.T, 12), axis=1, kind="stable").astype(np.int32)


def _listed(q: DataFrame, i: DataFrame, k: int, recall: float, lists: int | None) -> tuple[DataFrame, DataFrame]:
    """Queries with their nearest list and a bit for each list that they look into, and items with their own list."""
    n = i.count()
    if n <= 2 * k:  # one list
        return q.select("k", "v", F.lit(0).alias("list"), F.lit(bytearray([128])).alias("asked")), i.withColumn("list", F.lit(0))
    centres = centroids(i, lists or int(np.ceil(np.sqrt(n))))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                own = np.round(_vectors_of(batch) @ centres.T, 12).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("v"), pa.array(own)], ["k", "v", "list"])

    kind = {side: df.schema["k"].dataType.simpleString() for side, df in (("q", q), ("i", i))}
    own = stage(i.mapInArrow(nearest, f"k {kind['i']}, v array<double>, list int"))
    size = np.zeros(len(centres), np.int64)
    for r in own.groupBy("list").count().collect():
        size[r["list"]] = r["count"]
    few = stage(_sampled(q, SAMPLE_QUERIES))
    exact = apart(lambda: _best_lists(few, own.select("k", "v"), k, "k", CELL_ROWS))
    found = exact.select("k", F.explode("neighbor_aids").alias("aid")).join(own.select(F.col("k").alias("aid"), "list"), "aid")

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                order = _order(_vectors_of(batch), centres)
                ends = np.arange(0, order.size + 1, order.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.ListArray.from_arrays(ends, pa.array(order.ravel()))], ["k", "lists"])

    seen = found.join(few.mapInArrow(ordered, f"k {kind['q']}, lists array<int>"), "k")
    # how many lists until each neighbour is met
    needed = np.sort([r[0] for r in seen.select(F.array_position("lists", F.col("list"))).collect()])
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                order = _order(_vectors_of(batch), centres)
                # as many lists as the sample asks for, and more until they hold k items
                wanted = np.maximum(probes, (np.cumsum(size[order], axis=1) < k).sum(axis=1) + 1)
                asked = np.zeros(order.shape, bool)
                np.put_along_axis(asked, order, np.arange(order.shape[1]) < wanted[:, None], axis=1)
                bits = pa.array([r.tobytes() for r in np.packbits(asked, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("v"), pa.array(order[:, 0]), bits], ["k", "v", "list", "asked"])

    asking = q.mapInArrow(run, f"k {kind['q']}, v array<double>, list int, asked binary")
    if 4 * probes >= len(centres):  # most blocks are asked for; thresholds rise sooner if near items come in any order
        return asking, own
    # the fewer lists in a block, the fewer queries ask for it
    parts = max(-(-n // CELL_ROWS), min(q.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK_ROWS)))
    return asking.sortWithinPartitions("list"), own.repartition(parts, "list").sortWithinPartitions("list")


def recall_of(found: DataFrame, exact: DataFrame, key: str) -> float:
    """The share of the exact neighbours that are found.

    Lists meet lists, so neither's neighbours become rows.
    """
    a = found.groupBy(key).agg(F.flatten(F.collect_list("neighbor_aids")).alias("_found"))
    both = exact.select(key, F.coalesce("neighbor_aids", F.array()).alias("_exact")).hint("merge").join(a, key, "left")
    hits = F.size(F.filter("_exact", lambda x: F.coalesce(F.array_contains("_found", x), F.lit(False))))
    n, of = both.agg(F.sum(hits), F.sum(F.size("_exact"))).first()
    return (n or 0) / max(1, of or 0)
