"""Embedding near-duplicates: random-hyperplane tables, exact cosines, components."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessionrank.llm.common import bounded, stage
from sessionrank.llm.components import components, forest

COSINE, TABLES, BITS, SEED = 0.98, 28, 14, 11
CELL_ROWS = 2_048
SHELF_ROWS = 4_096
FEW_BUCKETS = 100_000


def _planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def _unit(flat: np.ndarray) -> np.ndarray:
    v = flat.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # very large and very small numbers keep their direction
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _linked(x: np.ndarray, y: np.ndarray, kx: np.ndarray, ky: np.ndarray, table: int, cosine: float, same: bool):
    """Places (i, j) of pairs with the cosine that share no bucket in an earlier table."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for g in range(0, len(x), 512):
        i, j = np.nonzero(x[g : g + 512] @ y.T >= cosine)
        i = i + g
        if same:
            i, j = i[i < j], j[i < j]
        for c in range(0, len(i), 1 << 18):
            p, q = i[c : c + (1 << 18)], j[c : c + (1 << 18)]
            new = ~(kx[p, :table] == ky[q, :table]).any(axis=1)
            found.append((p[new], q[new]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, bits: int = BITS, seed: int = SEED, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vec_id, embedding, label.

    Vectors of one label and length are linked if their cosine in double precision reaches
    ``cosine`` and the signs of ``bits`` random projections agree in one of ``tables``: two
    vectors at cosine 0.98 share no table with a probability below one in a million.
    Equal vectors are folded first. What is dealt to buckets is a vector's number; buckets of one
    vector go before its components are fetched. A bucket above ``cell_rows`` becomes a grid of
    cells of bounded size. A cell counts the links of each vector (a pair counts in the first
    table that it shares) and sends a spanning forest of them, never the pairs.

    Null labels, null or empty vectors, zero vectors and those with null or non-finite
    components link with nothing. A vector's component is the smallest vec_id that links reach; rows
    without vec_id take part, and are never kept unless alone without an id: kept is
    vec_id = component_id, false for null ids. Repeated rows are other vectors and link; no rows give no rows; other columns
    are not read.
    """
    spark = vectors.sparkSession
    sound = F.expr(
        "label is not null and embedding is not null and size(embedding) > 0"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        " and exists(embedding, x -> x <> 0)"
    )
    rows = vectors.select("vec_id", "embedding", "label", F.coalesce(sound, F.lit(False)).alias("sound"))
    folded = stage(
        rows.where("sound")
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )

    def hashed(batches):
        """The bucket of each vector in every table, and its components as bytes."""
        powers = 1 << np.arange(bits)
        for batch in batches:
            lists = batch.column("embedding")
            dims = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for g in range(0, len(at), 1024):
                    own = pa.array(at[g : g + 1024])
                    flat = lists.take(own).flatten().to_numpy().reshape(-1, dim)
                    keys = (_unit(flat) @ _planes(int(dim), tables, bits, seed) >= 0).reshape(-1, tables, bits) @ powers
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("node").take(own),
                            batch.column("label").take(own),
                            pa.array(np.full(len(own), int(dim))),
                            batch.column("copies").take(own),
                            pa.array([r.tobytes() for r in np.ascontiguousarray(flat)], pa.binary()),
                            pa.array(list(keys.astype(np.int32)), pa.list_(pa.int32())),
                        ],
                        ["node", "label", "dim", "copies", "vec", "keys"],
                    )

    label_type = vectors.schema["label"].dataType.simpleString()
    double = vectors.schema["embedding"].dataType.elementType.simpleString() != "float"
    data = folded.select("node", "label", "copies", F.col("embedding").cast("array<double>" if double else "array<float>"))
    signed = stage(data.mapInArrow(hashed, f"node long, label {label_type}, dim long, copies long, vec binary, keys array<int>"))
    bucket = ["t", "label", "dim", "key"]
    tabled = signed.select("node", "label", "dim", F.posexplode("keys").alias("t", "key"))
    shared = stage(
        tabled.groupBy(*bucket).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").withColumn("n", F.ceil(F.col("rows") / cell_rows))
    )
    # a row of a bucket of n blocks goes to n cells; most cells hold a few vectors, and a task call takes a shelf of them
    shelves = max(1, -(-(shared.agg(F.sum(F.col("rows") * F.col("n"))).first()[0] or 0) // SHELF_ROWS))
    cell = [*bucket, "lo", "hi"]
    celled = (
        tabled.join(F.broadcast(shared) if bounded(shared, FEW_BUCKETS) else shared, bucket)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .select("node", "t", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block")
    )
    fetched = celled.join(signed.select("node", "label", "dim", "copies", "vec", "keys"), "node")
    kind = np.float64 if double else np.float32
    shelved = fetched.withColumn("shelf", F.pmod(F.xxhash64(*cell), F.lit(shelves)))

    def compared(shelf: pa.Table) -> pa.Table:
        """All cells of a shelf."""
        label = shelf.column("label").combine_chunks().dictionary_encode()
        label = (label.chunk(0) if isinstance(label, pa.ChunkedArray) else label).indices
        cols = {c: shelf.column(c).to_numpy() for c in ("t", "dim", "key", "lo", "hi", "block", "node", "copies")}
        keys = [np.asarray(label), *(cols[c] for c in ("t", "key", "lo", "hi", "dim"))]
        order = np.lexsort(keys)
        new = np.ones(len(order), bool)
        new[1:] = np.any([np.diff(k[order]) != 0 for k in keys], axis=0)
        cuts = np.append(np.flatnonzero(new), len(order))
        several = np.flatnonzero(np.diff(cuts) > 1)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        _, limits, data = shelf.column("vec").combine_chunks().take(pa.array(order)).buffers()
        limits = np.frombuffer(limits, np.int32)
        sig = shelf.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, tables)[order]
        ordered = {k: c[order] for k, c in cols.items()}
        first, units = 0, None  # the unit vectors of one length, from row ``first`` on; lengths are the main order
        for c in several.tolist():
            at, stop = cuts[c], cuts[c + 1]
            t, dim, lo, hi = (int(ordered[k][at]) for k in ("t", "dim", "lo", "hi"))
            if units is None or units.shape[1] != dim:
                first, last = np.searchsorted(ordered["dim"], [dim, dim + 1])
                flat = np.frombuffer(data, np.uint8)[limits[first] : limits[last]]
                units = _unit(flat.view(kind).reshape(-1, dim))
            node, copies, n = ordered["node"][at:stop], ordered["copies"][at:stop], stop - at
            x, own = units[at - first : stop - first], sig[at:stop]
            if lo == hi:
                i, j = _linked(x, x, own, own, t, cosine, True)
            else:
                a, b = np.flatnonzero(ordered["block"][at:stop] == lo), np.flatnonzero(ordered["block"][at:stop] == hi)
                i, j = _linked(x[a], x[b], own[a], own[b], t, cosine, False)
                i, j = a[i], b[j]
            if len(i):
                links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
                met = np.flatnonzero(links)
                out.append((node[met], node[forest(i, j, n)[met]], links[met].astype(np.int64)))
        a, b, links = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"a": a, "b": b, "links": links})

    found = stage(shelved.groupBy("shelf").applyInArrow(compared, "a long, b long, links long"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b")).withColumnRenamed("node", "a")
    owned = stage(
        folded.join(roots, F.expr("node = a"), "left")
        .select("label", "embedding", "first", "copies", "node", F.coalesce("root", "node").alias("root"))
        .join(counts, "node", "left")
    )
    least = stage(owned.groupBy("root").agg(F.min("first").alias("component_id")))
    known = owned.join(least, "root").select(
        F.col("label").alias("l"), F.col("embedding").alias("e"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "component_id"
    )
    known = stage(known)
    out = rows.where("sound").join(known, F.expr("label = l and embedding = e")).select("vec_id", F.col("n").alias("n_links"), "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
