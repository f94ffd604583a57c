"""Embedding whitening: float32 eigenvectors of a distributed covariance, refined in higher
precision.

Entries become whole numbers, so counts, sums and the centred second moments are summed
exactly, whatever the partitions: rows are taken less the rounded mean, and products of limbs of
22 bits are whole numbers that float64 matrix products hold exactly. Spark adds the parts.

The eigenvectors of the covariance are computed in float32 and corrected by Ogita-Aishima
steps, matrix products alone, in extended precision. Eigenvalues nearer than a step can tell
apart form a cluster: its subspace is refined with the others and its vectors come from a
sub-solve, the small eigenproblem of the covariance less the cluster's value inside it.

Defined cases: rows whose vector is null, empty or holds null, NaN or infinite entries go, and
so do rows of another length than most different vectors have (the longest of equally frequent
lengths). Whole numbers beyond 2^62 in size are cut to it. Repeated rows and null ids are rows of their own; a vector counts once in the fit.
With fewer than ``count`` dimensions there are as many components. A component without
variance has null ``whitened``. ``deviation`` is null where it exceeds a long. An empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import pinned

LIMB = 22  # bits: products of two limbs over CHUNK rows stay below 2 ** 53
CHUNK = 1 << 9
STEPS = 20
LARGEST = (1 << 62) - 1


class Fit(NamedTuple):
    """Moments of the different vectors and the leading eigenpairs of their covariance."""

    n: int
    sums: list[int]
    shift: np.ndarray  # rounded mean
    vectors: np.ndarray  # one column per component
    values: np.ndarray
    trace: float


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of the rows with a usable vector: floor(256 * c) as whole numbers."""
    entry = F.transform(rows[vector_col], lambda c: c.cast("double"))
    rows = rows.select(rows[id_col].alias("vec_id"), entry.alias("c"))
    usable = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("c").isNotNull() & (F.size("c") > 0)).where(usable)
    most = F.lit(LARGEST)
    return rows.select(
        "vec_id",
        F.transform("c", lambda c: F.greatest(-most, F.least(most, F.floor(c * 256.0)))).alias("x"),
    )


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _added(parts: DataFrame, size: int) -> list[int]:
    """Sum per place of (k, high, low), value high * 2^62 + low: ``size`` numbers."""
    sums = parts.groupBy("k").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    out = [0] * size
    for k, high, low in sums.collect():
        out[k] = (int(high) << 62) + int(low)
    return out


_PARTS = pa.schema(
    [("k", pa.int64()), ("high", pa.decimal128(28, 0)), ("low", pa.decimal128(28, 0))]
)
_PARTS_DDL = "k bigint, high decimal(28,0), low decimal(28,0)"


def _parts(values: Iterator[int]) -> pa.RecordBatch:
    values = [(k, int(v)) for k, v in enumerate(values) if v]
    columns = [
        pa.array([k for k, _ in values], pa.int64()),
        pa.array([Decimal(v >> 62) for _, v in values], _PARTS.field("high").type),
        pa.array([Decimal(v & ((1 << 62) - 1)) for _, v in values], _PARTS.field("low").type),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_PARTS)


def vector_sums(fit: DataFrame, size: int) -> list[int]:
    """Exact sum of every entry over the rows (x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, object)
        for batch in batches:
            x = _matrix(batch.column("x"), size)
            # Halves of 32 bits add up without overflow.
            own += (x >> 32).sum(0).astype(object) * (1 << 32)
            own += (x & 0xFFFFFFFF).sum(0).astype(object)
        yield _parts(own)

    return _added(fit.select("x").mapInArrow(run, _PARTS_DDL), size)


def products(y: np.ndarray) -> np.ndarray:
    """Exact y^T y of whole numbers, as Python integers."""
    rest, limbs = y, []
    while not limbs or rest.any():
        low = ((rest + (1 << LIMB - 1)) & ((1 << LIMB) - 1)) - (1 << LIMB - 1)
        limbs.append(low.astype(np.float64))
        rest = (rest - low) >> LIMB
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for i, one in enumerate(limbs):
        for j, other in enumerate(limbs):
            own = np.zeros(out.shape, np.int64)
            for at in range(0, len(y), CHUNK):
                own += (one[at : at + CHUNK].T @ other[at : at + CHUNK]).astype(np.int64)
            out += own.astype(object) << (LIMB * (i + j))
    return out


def second_moments(fit: DataFrame, shift: np.ndarray) -> np.ndarray:
    """Exact sum of (x - shift)(x - shift)^T over the rows (x), as Python integers."""
    size = len(shift)
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((size, size), object)
        for batch in batches:
            own += products(_matrix(batch.column("x"), size) - shift)
        yield _parts(own[upper])

    sums = _added(fit.select("x").mapInArrow(run, _PARTS_DDL), len(upper[0]))
    out = np.zeros((size, size), object)
    out[upper] = sums
    out.T[upper] = sums
    return out


def covariance(moments: np.ndarray, sums: list[int], n: int, shift: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) from whole numbers, rounded once to extended precision."""
    left = np.array([s - n * int(m) for s, m in zip(sums, shift)], object)
    exact = n * moments - np.outer(left, left)

    def rounded(value: int) -> np.longdouble:
        sign, value = (-1, -value) if value < 0 else (1, value)
        over = max(0, value.bit_length() - 64)
        value >>= over
        parts = np.longdouble(value >> 32) * np.longdouble(1 << 32) + np.longdouble(value & 0xFFFFFFFF)
        return sign * np.ldexp(parts, over)

    made = np.array([[rounded(v) for v in row] for row in exact.tolist()], np.longdouble)
    return made / np.longdouble(n) / np.longdouble(n)


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Columns that are orthonormal but for small errors, with these squared."""
    return x @ (1.5 * np.eye(x.shape[1]) - 0.5 * (x.T @ x))


def refined(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) by falling value of a symmetric matrix, from rough eigenvectors.

    Ogita-Aishima steps in extended precision; a cluster's vectors come from a sub-solve.
    """
    wide = np.longdouble
    matrix, x = matrix.astype(wide), vectors.astype(wide)
    one = np.eye(len(matrix), dtype=wide)
    small = np.finfo(wide).eps * len(matrix)
    whole = np.sqrt((matrix * matrix).sum())
    for _ in range(STEPS):
        r = one - x.T @ x
        s = x.T @ matrix @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        near = 2 * (np.sqrt((off * off).sum()) + whole * np.sqrt((r * r).sum()))
        near = max(near, small * whole)
        apart = values[None, :] - values[:, None]
        close = np.abs(apart) <= near
        left = np.where(close, 0, s + values[None, :] * r)
        e = np.where(close, r / 2, left / np.where(close, 1, apart))
        x = x + x @ e
        order = np.argsort(-values, kind="stable")
        breaks = np.flatnonzero(-np.diff(values[order]) > near) + 1
        for cluster in np.split(order, breaks):
            if len(cluster) > 1:
                own = x[:, cluster]
                own = _orthonormal(own)
                middle = values[cluster].mean()
                inner = own.T @ (matrix @ own - middle * own)
                scale = np.abs(inner).max()
                if scale > 0:
                    turned = np.linalg.eigh((inner + inner.T).astype(np.float64) / float(2 * scale))
                    own = own @ _orthonormal(turned[1].astype(wide))
                x[:, cluster] = own
        if np.abs(left).max() < 8 * small * whole and np.abs(r).max() < 8 * small:
            break
    x = _orthonormal(_orthonormal(x))
    values = (x * (matrix @ x)).sum(0) / (x * x).sum(0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x * x).sum(0))[order]
    return values[order], x


def eigenpairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues and their vectors."""
    scale = np.abs(matrix).max(initial=0)
    if not scale > 0:
        return np.zeros(count, np.longdouble), np.eye(len(matrix), dtype=np.longdouble)[:, :count]
    rough = np.linalg.eigh((matrix / scale).astype(np.float32))[1]
    values, vectors = refined(matrix / scale, rough)
    return values[:count] * scale, vectors[:, :count]


def fitted(fit: DataFrame, size: int, count: int) -> Fit:
    n = fit.count()
    sums = vector_sums(fit, size)
    shift = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    matrix = covariance(second_moments(fit, shift), sums, n, shift)
    values, vectors = eigenpairs(matrix, min(count, size))
    tiny = np.finfo(np.float64).eps * np.abs(matrix).max(initial=0) * size
    values = np.where(values > tiny, values, 0).astype(np.float64)
    return Fit(n, sums, shift, vectors.astype(np.float64), values, float(np.trace(matrix)))


def _projected(x: np.ndarray, fit: Fit) -> np.ndarray:
    left = np.array([(s - fit.n * int(m)) / fit.n for s, m in zip(fit.sums, fit.shift)])
    scale = np.where(fit.values > 0, np.sqrt(np.where(fit.values > 0, fit.values, 1)), np.nan)
    return ((x - fit.shift).astype(np.float64) - left) @ (fit.vectors / scale)


def _deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    sums = np.array(fit.sums, np.float64)
    rough = ((x.astype(np.float64) * fit.n - sums) ** 2).sum(1)
    largest = np.abs(x).max(initial=0) * float(fit.n) + np.abs(sums).max(initial=0)
    if max(rough.max(initial=0), largest) < LARGEST:
        gaps = x * fit.n - np.array(fit.sums, np.int64)
        return (gaps * gaps).sum(1).tolist()
    gaps = x.astype(object) * fit.n - np.array(fit.sums, object)
    exact = (gaps * gaps).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def identity_error(fit_rows: DataFrame, fit: Fit) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, over
    the components with variance."""
    chosen = np.flatnonzero(fit.values > 0)
    k = len(chosen)
    shared = fit_rows.sparkSession.sparkContext.broadcast(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares = np.zeros(k, np.longdouble), np.zeros((k, k), np.longdouble)
        for batch in batches:
            z = _projected(_matrix(batch.column("x"), len(fit.shift)), shared.value)[:, chosen]
            sums += z.sum(0)
            squares += z.T @ z
        values = np.concatenate([sums, squares.ravel()]).astype(np.float64)
        yield pa.RecordBatch.from_pydict({"k": np.arange(len(values)), "v": values})

    parts = fit_rows.select("x").mapInArrow(run, "k bigint, v double")
    found = dict(parts.groupBy("k").agg(F.sum("v")).collect())
    if not k:
        return 0.0
    values = np.array([found[i] for i in range(k + k * k)]) / fit.n
    mean, squares = values[:k], values[k:].reshape(k, k)
    return float(np.abs(squares - np.outer(mean, mean) - np.eye(k)).max())


def whitened(
    rows: DataFrame, count: int = 4, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per usable vector and component: vec_id, component (from 1), n, deviation,
    whitened, explained (share of the variance), identity_error (one value)."""
    spark = rows.sparkSession
    usable = whole_vectors(rows, id_col, vector_col)
    fit_rows = pinned(usable.select("x").distinct(), "fit")
    sizes = fit_rows.groupBy(F.size("x").alias("size")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    kind = (
        f"vec_id {dict(usable.dtypes)['vec_id']}, component int, n bigint, deviation bigint, "
        "whitened double, explained double, identity_error double"
    )
    if most is None:
        return spark.createDataFrame([], kind)
    size = most["size"]
    fit_rows = fit_rows.where(F.size("x") == size)
    fit = fitted(fit_rows, size, count)
    error = identity_error(fit_rows, fit)
    shared = spark.sparkContext.broadcast(fit)
    explained = (fit.values / fit.trace if fit.trace > 0 else fit.values * 0).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for batch in batches:
            x = _matrix(batch.column("x"), size)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k)))
            deviations = pa.array(_deviations(x, shared.value), pa.int64())
            z = _projected(x, shared.value).ravel()
            columns = [
                ids,
                pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(len(ids), fit_n), pa.int64()),
                deviations.take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(z, pa.float64(), mask=np.isnan(z)),
                pa.array(np.tile(explained, len(x)), pa.float64()),
                pa.array(np.full(len(ids), error), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    fit_n = fit.n
    return usable.where(F.size("x") == size).mapInArrow(run, kind)
