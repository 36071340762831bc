"""SimHash near-duplicates: fingerprints, a vantage-point tree over them, exact pairs, components."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from sessionrank.llm.common import forget_words, fresh, stage, utf8
from sessionrank.llm.components import components, forest

SHINGLE, SEED, DISTANCE = 3, 42, 2
PARTS = 2
LEAF_ROWS = 2_000
CELL_ROWS = 8_192
SAMPLE = 262_144
MAX_LEVELS = 16


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set where over half of the shingles' XXH64 have it set; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    flat, n = b" ".join(words), max(1, len(words) - shingle + 1)
    stop = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], stop[:-1] + 1])
    a, b = start[:n].tolist(), stop[len(words) - n :].tolist()
    one, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for g in range(0, n, 1 << 16):
        h = np.fromiter((one(flat[x:y], seed) for x, y in zip(a[g : g + (1 << 16)], b[g : g + (1 << 16)], strict=True)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(shingle: int = SHINGLE, seed: int = SEED):
    """Column function: a text's fingerprint as a signed long."""

    @arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget_words()
        for texts in batches:
            data, cut = utf8(texts)
            own = [simhash(data[a:b].tobytes(), shingle, seed) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.array(np.array(own, np.uint64).view(np.int64))

    return prints


class Tree:
    """A perfect vantage-point tree over some bits of the fingerprints.

    Node i has the vantage point ``point[i]`` and the radius ``mu[i]``: what lies within goes
    to node 2 i + 1, the rest to 2 i + 2. Distances on some of the bits satisfy the triangle
    inequality, so a ball of radius r around x meets the inner side only if d - r <= mu, and
    the outer one only if d + r > mu.
    """

    def __init__(self, sample: np.ndarray, mask: int, levels: int, radius: int):
        self.mask, self.levels, self.radius = np.uint64(mask), levels, radius
        self.point, self.mu = np.zeros(2**levels - 1, np.uint64), np.zeros(2**levels - 1, np.int64)
        sets = [sample & self.mask]
        for level in range(levels):
            below = []
            for j, own in enumerate(sets):
                i = 2**level - 1 + j
                if len(own):
                    self.point[i] = own[0]
                    d = np.bitwise_count(own ^ own[0]).astype(np.int64)
                    self.mu[i] = np.sort(d)[(len(d) - 1) // 2]
                    below += [own[d <= self.mu[i]], own[d > self.mu[i]]]
                else:
                    below += [own, own]
            sets = below

    def _distance(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        return np.bitwise_count((x & self.mask) ^ self.point[node]).astype(np.int64)

    def home(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (self._distance(x, node) > self.mu[node])
        return node - (2**self.levels - 1)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that the ball around a row meets."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.levels):
            d = self._distance(x[row], node)
            inner, outer = d - self.radius <= self.mu[node], d + self.radius > self.mu[node]
            row, node = np.concatenate([row[inner], row[outer]]), np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2])
        return row, node - (2**self.levels - 1)


def _masks(parts: int) -> list[int]:
    cuts = [64 * p // parts for p in range(parts + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def close_pairs(a: np.ndarray, b: np.ndarray, distance: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with a[i] and b[j] within the distance; of one set with itself, i < j only."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for g in range(0, len(a), 256):
        i, j = np.nonzero(np.bitwise_count(a[g : g + 256, None] ^ b[None, :]) <= distance)
        if same:
            i, j = i[i + g < j], j[i + g < j]
        found.append((i + g, j))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def links(prints: DataFrame, distance: int = DISTANCE, parts: int = PARTS, leaf_rows: int = LEAF_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b) that connect all distinct fingerprints (column fp) within the distance, as trees.

    The bits are cut into ``parts``; two fingerprints within the distance agree up to
    distance // parts bits in one of them at least, so each part has a tree and that radius. A
    fingerprint has one home leaf in each tree and visits the leaves after it that its ball
    meets; pairs are looked for between homes and between homes and visitors, and compared on all
    64 bits. The trees are fitted on a bounded sample of ``SAMPLE``; it decides on balance
    only, never on pairs.

    A leaf with more homes or visitors than ``cell_rows`` becomes a grid of cells of bounded
    size. Each cell sends the spanning forest of its pairs, not the pairs.
    """
    spark = prints.sparkSession
    n = prints.count()
    levels = min(MAX_LEVELS, max(0, int(np.ceil(np.log2(max(1, n / leaf_rows))))))
    sample = prints.orderBy(F.xxhash64("fp")).limit(min(SAMPLE, 16 << levels)).collect() if levels else []
    sample = np.array([r[0] for r in sample], np.int64).view(np.uint64)
    trees = [Tree(sample, m, levels, distance // parts) for m in _masks(parts)]
    leaves = 2**levels
    schema = "leaf long, visitor boolean, fp long"

    def routed(batches):
        for batch in batches:
            got = batch.column(0).to_numpy()
            for g in range(0, len(got), 4096):
                fp = got[g : g + 4096]
                x = fp.view(np.uint64)
                for p, tree in enumerate(trees):
                    home = tree.home(x)
                    row, leaf = tree.visits(x)
                    away = leaf > home[row]
                    row, leaf = row[away], leaf[away]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([home, leaf]) + p * leaves),
                            pa.array(np.arange(len(fp) + len(leaf)) >= len(fp)),
                            pa.array(np.concatenate([fp, fp[row]])),
                        ],
                        ["leaf", "visitor", "fp"],
                    )

    fps = prints.select("fp")
    sizes = np.zeros((parts * leaves, 2), np.int64)
    for leaf, visitor, count in fps.mapInArrow(routed, schema).groupBy("leaf", "visitor").count().collect():  # two rows a leaf
        sizes[leaf, int(visitor)] = count
    blocks = spark.sparkContext.broadcast(np.maximum(1, -(-sizes // cell_rows)).astype(np.int64))

    def celled(batches):
        """Homes in block i meet homes in blocks from i on (cells i, j of the first grid) and visitors (second grid)."""
        for batch in routed(batches):
            leaf, visitor, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            mix = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            n_home, n_guest = blocks.value[leaf, 0], blocks.value[leaf, 1]
            i = (mix % np.where(visitor, n_guest, n_home).astype(np.uint64)).astype(np.int64)
            grown = np.where(visitor, n_home, n_home + n_guest)
            at = np.repeat(np.arange(len(fp)), grown)
            k = np.arange(len(at)) - np.repeat(np.cumsum(grown) - grown, grown)
            i, k_home = i[at], n_home[at]
            guest = visitor[at]
            own = ~guest & (k < k_home)
            lo = np.where(own, np.minimum(i, k), np.where(guest, k, i))
            hi = np.where(own, np.maximum(i, k), np.where(guest, i, k - k_home))
            side = np.where(own, i != lo, guest)  # in the first grid: whether it is of the second block
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf[at]), pa.array(own), pa.array(lo), pa.array(hi), pa.array(side), pa.array(fp[at])],
                ["leaf", "own", "lo", "hi", "side", "fp"],
            )

    def compared(table):
        own, lo, hi = (table.column(c)[0].as_py() for c in ("own", "lo", "hi"))
        fp, side = table.column("fp").to_numpy(), table.column("side").to_numpy()
        x = fp.view(np.uint64)
        if own and lo == hi:
            i, j = close_pairs(x, x, distance, True)
            at = np.arange(len(fp))
            i, j = at[i], at[j]
        else:
            left, right = np.flatnonzero(~side), np.flatnonzero(side)
            i, j = close_pairs(x[left], x[right], distance, False)
            i, j = left[i], right[j]
        root = forest(i, j, len(fp))
        at = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"a": pa.array(fp[at]), "b": pa.array(fp[root[at]])})

    cells = fps.mapInArrow(celled, "leaf long, own boolean, lo long, hi long, side boolean, fp long")
    return cells.groupBy("leaf", "own", "lo", "hi").applyInArrow(compared, "a long, b long")


def groups(prints: DataFrame, **options) -> DataFrame:
    """(fp, root, component_id) from (fp, doc_id): the smallest doc_id of all fingerprints that links reach."""
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(stage(links(distinct, **options)))
    owned = stage(distinct.join(roots, F.expr("fp = node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = stage(owned.groupBy("root").agg(F.min("first").alias("component_id")))
    return owned.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, **options) -> DataFrame:
    """(doc_id, fp, component_id): each document's fingerprint and the smallest doc_id of its group.

    Words are runs of bytes other than ASCII white space, in ASCII lower case. Texts of fewer
    words than a shingle are one shingle; null and empty texts have fingerprint 0 and are
    linked like any other. Equal fingerprints are folded before links are looked for, so
    copies cost nothing there. Rows without doc_id take part and have the smallest id of
    their group, null if none has one; repeated rows stay; no rows give no rows.
    """
    prints = stage(docs.select("doc_id", fingerprint(shingle, seed)("text").alias("fp")))
    found = stage(groups(prints, **options))
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


def one_each(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, **options) -> DataFrame:
    """One document of each group, with the columns of ``docs``: the one with the smallest doc_id.

    An id that occurs once decides on its row. Rows whose id occurs repeatedly, and rows without
    one, which stay only for a group without ids, are told apart by their fingerprint; of
    several that could stay for a group it is the first in order of text and other columns.
    """
    hashed = fingerprint(shingle, seed)
    prints = stage(docs.select("doc_id", hashed("text").alias("fp")))
    found = stage(groups(prints, **options))
    many = stage(prints.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("repeated")))
    # those that go are fewer than those that stay, unless most documents are copies
    kept, gone = fresh(docs, "kept_id"), prints.join(found, "fp").where("doc_id <> component_id").select("doc_id")
    gone = stage(gone.union(many.where("repeated is not null")).distinct().select(F.col("doc_id").alias(kept)))
    single = docs.where("doc_id is not null").join(gone, F.col("doc_id") == F.col(kept), "left_anti")
    if not many.limit(1).count():
        return single
    row, fp = fresh(docs, "row"), fresh(docs, "fp")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), "doc_id", "text")
    doubtful = packed.join(many, F.expr("doc_id <=> repeated"), "left_semi").withColumn(fp, hashed("text"))
    # an id may occur in other groups too; there another id stays
    rivals = doubtful.join(found.withColumnRenamed("fp", "own"), F.expr(f"`{fp}` = own and doc_id <=> component_id"))
    first = rivals.groupBy("root").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("kept"))
    return single.union(first.select("kept.*"))
