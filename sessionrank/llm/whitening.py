"""Whitening of embeddings: a covariance from Spark, its components by spectral divide and conquer, projections by broadcast."""

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from sessionrank.llm.common import fresh, stage

SCALE, COMPONENTS = 256, 4
SLICE = 4_096
RESULT = "struct<n:long,deviation:long,whitened:array<double>,explained:array<double>,identity_error:double>"
_KIND = pa.struct(
    [("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64())), ("explained", pa.list_(pa.float64())), ("identity_error", pa.float64())]
)
_EPS = np.finfo(float).eps
#: Shifts that are tried in turn, as shares of the spread around the mean eigenvalue.
SHIFTS = (0.0, 0.29, -0.29, 0.61, -0.61, 0.13, -0.13, 0.87, -0.87, 0.03, -0.03)


def polar(a: np.ndarray) -> np.ndarray | None:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps (QDWH).

    Its eigenvalues are the signs of those of ``a``. None where one of them is zero to working precision.
    """
    x, one = a / np.linalg.norm(a), np.eye(len(a))
    try:
        low = min(1.0, 0.9 / np.linalg.norm(np.linalg.inv(x)))  # below the least singular value
    except np.linalg.LinAlgError:
        return None
    for _ in range(12):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        p = root + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:  # far from orthogonal: the stable form by an orthogonal factorisation
            both = np.linalg.qr(np.concatenate([np.sqrt(r) * x, one]))[0]
            new = q / r * x + (p - q / r) / np.sqrt(r) * both[: len(a)] @ both[len(a) :].T
        else:
            new = q / r * x + (p - q / r) * np.linalg.solve(one + r * x.T @ x, x.T).T
        new = (new + new.T) / 2
        step, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (p + q * low**2) / (1 + r * low**2))
        if step < np.cbrt(_EPS) and 1 - low < 10 * _EPS:
            break
    return x if np.linalg.norm(x @ x - one) < 1e-10 * len(a) else None


def spectral(a: np.ndarray, components: int, tiny: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    The polar factor U of the matrix less a shift gives the projector (U + 1) / 2 on the
    eigenvectors above the shift. Bases of its range and of the complement split the matrix
    into two, which are split again; only what holds wanted components is followed. A block
    whose eigenvalues agree to working precision is a component for each of its axes.
    """
    n = len(a)
    tiny = _EPS * np.linalg.norm(a) * n if tiny is None else tiny
    centre = np.trace(a) / n
    spread = np.linalg.norm(a - centre * np.eye(n))
    if n == 1 or spread <= tiny:
        order = np.argsort(-np.diag(a), kind="stable")[:components]
        return np.diag(a)[order], np.eye(n)[:, order]
    start = np.random.default_rng(n).standard_normal((n, n))
    for share in SHIFTS:
        u = polar(a - (centre + share * spread / np.sqrt(n)) * np.eye(n))
        if u is None:
            continue
        project = (u + np.eye(n)) / 2
        rank = round(float(np.trace(project)))
        if not 0 < rank < n:
            continue
        upper = np.linalg.qr(project @ start[:, :rank])[0]
        q = np.linalg.qr(project @ upper, mode="complete")[0]  # one step of subspace iteration
        upper, lower = q[:, :rank], q[:, rank:]
        if np.linalg.norm(lower.T @ a @ upper) > 100 * max(tiny, _EPS * np.linalg.norm(a) * n):
            continue
        parts = []
        for basis, wanted in ((upper, components), (lower, components - rank)):
            if wanted > 0:
                block = basis.T @ a @ basis
                values, vectors = spectral((block + block.T) / 2, wanted, tiny)
                parts.append((values, basis @ vectors))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1)
    raise ArithmeticError("no shift splits the covariance")


def _sound() -> str:
    return (
        "embedding is not null and size(embedding) > 0"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )


def _steps(lists: pa.Array, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, whole numbers floor(scale * c)) of the vectors of each length, in slices; unsound ones are left out."""
    if not len(lists):
        return
    sizes = np.diff(np.asarray(lists.offsets))
    sizes[np.asarray(lists.is_null())] = 0
    flat, first = lists.values, np.asarray(lists.offsets)[:-1].astype(np.int64)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        for g in range(0, len(at), SLICE):
            own = at[g : g + SLICE]
            x = np.floor(scale * values[first[own][:, None] + np.arange(dim)])
            fine = (np.abs(x) < 2.0**63).all(axis=1)  # false for NaN and infinity
            yield dim, own[fine], x[fine].astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row in the least of 2, 4 and 8 bytes a number: equal rows have equal bytes."""
    most, least = x.max(axis=1), x.min(axis=1)
    out: list[bytes] = [b""] * len(x)
    small = np.zeros(len(x), bool)
    for kind in ("<i2", "<i4", "<i8"):
        info = np.iinfo(kind)
        fits = ~small & (least >= info.min) & (most <= info.max)
        for i, row in zip(np.flatnonzero(fits).tolist(), x[fits].astype(kind), strict=True):
            out[i] = row.tobytes()
        small |= fits
    return out


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(length, whole numbers) from rows of dim and x."""
    dims = batch.column("dim").to_numpy()
    data = batch.column("x")
    width = np.asarray(pa.compute.binary_length(data)) // np.maximum(dims, 1)
    for dim, w in sorted(set(zip(dims.tolist(), width.tolist(), strict=True))):
        at = np.flatnonzero((dims == dim) & (width == w))
        for g in range(0, len(at), SLICE):
            own = data.take(pa.array(at[g : g + SLICE])).to_pylist()
            yield dim, np.frombuffer(b"".join(own), f"<i{w}").astype(np.int64).reshape(-1, dim)


def _exact(x: np.ndarray, bound: int) -> np.ndarray:
    """The numbers themselves, as Python integers where sums up to ``bound`` leave 64 bits."""
    return x if bound < 2**62 else x.astype(object)


def _distinct(vectors: DataFrame, scale: int) -> DataFrame:
    def steps(batches):
        for batch in batches:
            for dim, _, x in _steps(batch.column(0), scale):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), dim, np.int32)), pa.array(_packed(x), pa.binary())], ["dim", "x"])

    rows = vectors.where(_sound()).select(F.col("embedding"))
    return stage(rows.mapInArrow(steps, "dim int, x binary").distinct())


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """n and the sums of each dimension, for each length of vectors."""

    def summed(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for dim, x in _unpacked(batch):
                own = total.setdefault(dim, [0, [0] * dim])
                own[0] += len(x)
                most = int(np.abs(x.astype(float)).max()) + 1
                own[1] = [a + int(b) for a, b in zip(own[1], _exact(x, most * len(x)).sum(axis=0), strict=True)]
        for dim, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim), pa.array([Decimal(v) for v in s], pa.decimal128(38, 0))],
                ["dim", "i", "n", "s"],
            )

    rows = fit.mapInArrow(summed, "dim int, i int, n long, s decimal(38,0)").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows.collect()):
        out.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))
    return out


def _covariance(fit: DataFrame, sums: dict, onto: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """Covariance matrices of the centred vectors, or of their projections ``onto`` some columns.

    A task adds up the products of its slices and sends one upper triangle for each length,
    which Spark adds up by place; the driver gets the triangle of the total.
    """
    means = {dim: np.array([v / n for v in s]) for dim, (n, s) in sums.items()}

    def products(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, x in _unpacked(batch):
                y = x - means[dim]
                if onto is not None:
                    y = y @ onto[dim]
                total[dim] = total.get(dim, 0) + y.T @ y
        for dim, own in total.items():
            for i in range(len(own)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([i], pa.int32()), pa.array([own[i, i:]], pa.list_(pa.float64()))], ["dim", "i", "v"]
                )

    rows = fit.mapInArrow(products, "dim int, i int, v array<double>").select("dim", "i", F.posexplode("v").alias("j", "v"))
    out = {dim: np.zeros((d, d)) for dim, d in ((dim, dim if onto is None else onto[dim].shape[1]) for dim in sums)}
    for r in rows.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():
        a, i, j = out[r["dim"]], r["i"], r["i"] + r["j"]
        a[i, j] = a[j, i] = r["v"] / sums[r["dim"]][0]
    return out


def fitted(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> dict[int, dict]:
    """For each length of vectors: n, sums, columns that whiten (NaN where a component has no variance), explained, identity_error.

    Fitted on each distinct sound vector of whole numbers once. The driver holds one
    covariance matrix for each length, whose size is the square of that length.
    """
    fit = _distinct(vectors, scale)
    sums = _sums(fit)
    models, onto = {}, {}
    for dim, v in _covariance(fit, sums).items():
        values, axes = spectral(v, components)
        trace = float(np.trace(v))
        real = values > dim * _EPS * trace
        with np.errstate(invalid="ignore", divide="ignore"):
            columns = np.where(real, axes / np.sqrt(np.where(real, values, 1.0)), np.nan)
        explained = [float(x) / trace if trace > 0 else None for x in values]
        models[dim] = {"n": sums[dim][0], "sums": sums[dim][1], "columns": columns, "explained": explained, "identity_error": None}
        onto[dim] = columns[:, real]
    for dim, c in (_covariance(fit, sums, onto) if models else {}).items():
        if len(c):
            models[dim]["identity_error"] = float(np.abs(c - np.eye(len(c))).max())
    return models


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, name: str = "white") -> DataFrame:
    """The rows with a sound ``embedding``, with a struct: n, deviation, whitened, explained, identity_error.

    An entry c becomes x = floor(scale * c). Mean and covariance (divisor n) come from the n
    distinct vectors x of a length; vectors of different lengths are fitted apart. Components
    are the covariance's unit eigenvectors by falling eigenvalue, ``components`` at most;
    ``whitened`` holds the projections of x less the mean, each over the root of its
    eigenvalue, ``explained`` the eigenvalues over their sum, ``deviation`` the sum of
    (n x - sums)^2, ``identity_error`` how far the covariance of ``whitened`` is from the identity.

    Rows whose vector is null or empty, or holds null, NaN, infinity or a number whose x leaves 64
    bits, are left out. A component without variance (one distinct vector, or fewer than there
    are components) is null in ``whitened``; so are ``explained`` and ``identity_error`` where nothing
    varies, and a ``deviation`` beyond 64 bits. Repeated rows are kept and count once in the fit;
    other columns pass through, ``name`` gets underscores where the table has it; no rows give no rows.
    """
    name = fresh(vectors, name)
    models = fitted(vectors, components, scale)

    def projected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            out: list = [None] * len(lists)
            for dim, at, x in _steps(lists, scale):
                if dim not in models or not len(x):
                    continue
                m = models[dim]
                n, s = m["n"], m["sums"]
                most = n * (int(np.abs(x.astype(float)).max()) + 1) + max(map(abs, s))
                wide = dim * most * most >= 2**62
                gap = n * (x.astype(object) if wide else x) - np.array(s, object if wide else np.int64)
                deviation = (gap * gap).sum(axis=1).tolist()
                scores = (x - np.array([v / n for v in s])) @ m["columns"]
                for i, d, z in zip(at.tolist(), deviation, scores.tolist(), strict=True):
                    out[i] = {
                        "n": n,
                        "deviation": d if d < 2**63 else None,
                        "whitened": [v if v == v else None for v in z],
                        "explained": m["explained"],
                        "identity_error": m["identity_error"],
                    }
            yield pa.array(out, _KIND)

    rows = vectors.where(_sound()).withColumn(name, arrow_udf(projected, RESULT)("embedding"))
    return rows.where(F.col(name).isNotNull())
