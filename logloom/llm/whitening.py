"""Whitening of embeddings.

Entries become whole numbers, of which sums and deviations are exact. Partial sums of each partition, and after them partial
products of the centred vectors, are added up by Spark; only the matrix of the dimensions reaches the driver. There Householder
reflections make it tridiagonal, bisection by Sturm counts finds the leading eigenvalues, and inverse iteration their vectors,
those of close eigenvalues kept orthogonal. The components, a few rows of numbers, travel with the projection of all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import materialize

#: Entries are counted in steps of 1 / SCALE.
SCALE = 256
#: Vectors with an entry of this size or beyond take no part: their whole numbers would outgrow what is added exactly.
TOO_LARGE = 2.0**30
COMPONENTS = 4


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal, and the unit vectors of the reflections (zero: none) that make a symmetric matrix tridiagonal."""
    a, n, mirrors = a.copy(), len(a), []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if np.any(v[1:]):
            v[0] += np.copysign(size, v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1 :, k + 1 :]
            p = 2 * (rest @ v)
            w = p - (v @ p) * v
            rest -= np.outer(v, w) + np.outer(w, v)
            a[k + 1, k] -= 2 * v[0] * (v @ a[k + 1 :, k])
        else:
            v[:] = 0
        mirrors.append(v)
    return np.diag(a).copy(), np.array([a[k + 1, k] for k in range(n - 1)]), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each number of ``at``."""
    tiny = np.finfo(float).tiny
    q = diagonal[0] - at
    count = (q < 0).astype(int)
    for d, e in zip(diagonal[1:], off, strict=True):
        q = d - at - e * e / np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each halved down to neighbouring doubles."""
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    pad = 1e-12 * max(1.0, np.abs(low).max(), np.abs(high).max())
    low, high, wanted = low - pad, high + pad, len(diagonal) - np.arange(k)
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            return middle
        reached = below(diagonal, off, middle) >= wanted  # as many lie below as this one and all smaller ones
        low, high = np.where(reached, low, middle), np.where(reached, middle, high)


def solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """x with (T - shift) x = right, rows exchanged where that gives the larger pivot; a vanishing pivot counts as tiny."""
    n, tiny = len(diagonal), max(1e-200, np.finfo(float).eps * np.abs(np.append(diagonal, off)).max())
    x, rows = right.copy(), []
    d, u = diagonal[0] - shift, off[0] if n > 1 else 0.0
    for i in range(n - 1):
        low, nd, nu = off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < n else 0.0
        if abs(low) > abs(d):
            rows.append((low, nd, nu))
            x[i], x[i + 1] = x[i + 1], x[i]
            f = d / low
            d, u = u - f * nd, -f * nu
        else:
            d = d if abs(d) > tiny else tiny
            rows.append((d, u, 0.0))
            f = low / d
            d, u = nd - f * u, nu
        x[i + 1] -= f * x[i]
    rows.append((d if abs(d) > tiny else tiny, 0.0, 0.0))
    for i in range(n - 1, -1, -1):
        d, u, v = rows[i]
        x[i] = (x[i] - (u * x[i + 1] if i + 1 < n else 0.0) - (v * x[i + 2] if i + 2 < n else 0.0)) / d
    return x


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector for each of the falling ``values``; within a cluster of close ones each is kept orthogonal to the earlier."""
    draw, out, first = np.random.default_rng(7), [], 0
    size = max(1e-300, float(np.abs(np.concatenate([diagonal, off])).max()))
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * size:
            first = i
        x = draw.standard_normal(len(diagonal))
        for _ in range(6):
            x = solved(diagonal, off, value - (i - first) * 4e-16 * size, x / np.linalg.norm(x))
            x /= np.abs(x).max()
            for _ in range(2):
                for y in out[first:]:
                    x -= (y @ x) * y
            x /= np.linalg.norm(x)
        out.append(x)
    return np.array(out)


def eigen(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows."""
    diagonal, off, mirrors = tridiagonal(matrix)
    values = leading(diagonal, off, k)
    rows = vectors_of(diagonal, off, values)
    for j in range(len(mirrors) - 1, -1, -1):
        v = mirrors[j]
        rows[:, j + 1 :] -= 2 * np.outer(rows[:, j + 1 :] @ v, v)
    return values, rows / np.linalg.norm(rows, axis=1, keepdims=True)


def whole(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): floor(SCALE * entry) of each vector that isn't null or empty and holds only finite entries below TOO_LARGE."""
    c = F.col(vector_col)
    fit = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(TOO_LARGE)))
    return embeddings.filter(fit).select(F.col(id_col).alias("id"), F.transform(c, lambda v: F.floor(v.cast("double") * SCALE)).alias("x"))


def matrix_of(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summed(fit: DataFrame, d: int, value: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
    """Sum over all vectors of what ``value`` makes of a block of them: partitions add up theirs, Spark the partitions' sums."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                own = value(matrix_of(batch.column(0).slice(a, 4096), d)).ravel()
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "part"])

    parts = fit.select("x").mapInArrow(scan, f"at long, part {'long' if exact else 'double'}")
    rows = parts.groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)") if exact else F.col("part")).alias("total")).collect()  # as many as the matrix has cells
    out = np.zeros(len(rows), object if exact else float)
    for r in rows:
        out[r["at"]] = int(r["total"]) if exact else r["total"]
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n * x - S)**2; null beyond what a long holds. 64-bit arithmetic that wraps is exact wherever the result fits."""
    s = np.array([((v + (1 << 63)) % (1 << 64)) - (1 << 63) for v in sums], np.int64)
    with np.errstate(over="ignore"):
        exact = ((np.int64(n) * x - s) ** 2).sum(1).tolist()
    about = ((float(n) * x - np.array(sums, float)) ** 2).sum(1)
    for i in np.flatnonzero(about > 9e18):
        own = sum((n * int(v) - t) ** 2 for v, t in zip(x[i], sums, strict=True))
        exact[i] = own if own < 1 << 63 else None
    return exact


def whitened(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every vector and each of its ``k`` leading
    components (all, if it has fewer dimensions).

    Vectors that are null or empty, that hold null, NaN, an infinity or an entry of 2**30 or more, or whose length isn't the one
    that most distinct vectors have (ties: the longest), take no part. The covariance is that of the distinct vectors, so copies
    weigh nothing; every row is projected, rows that repeat or have no id too. ``deviation`` is null beyond a long. A component
    without variance (of one vector, or of dimensions that depend on others) has a null ``whitened`` and doesn't count in
    ``identity_error``, which is null where no component has any. An empty table gives an empty result; other columns are ignored.
    """
    kind = embeddings.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole(embeddings, id_col, vector_col)
    distinct = materialize(rows.select("x").distinct(), "vectors")
    most = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    if most is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    d, n = most["d"], most["n"]
    fit = distinct.filter(F.size("x") == d)
    sums = summed(fit, d, lambda x: x.sum(0), exact=True).tolist()
    mean = np.array([v / n for v in sums])
    centred = lambda x: x - mean
    covariance = summed(fit, d, lambda x: centred(x).T @ centred(x)).reshape(d, d) / n
    covariance = (covariance + covariance.T) / 2
    trace, k = float(np.trace(covariance)), min(k, d)
    values, components = eigen(covariance, k)
    some = values > d * np.finfo(float).eps * trace
    scale = np.where(some, np.sqrt(np.where(some, values, 1.0)), np.nan)
    project = lambda x: (centred(x) @ components.T) / scale
    error = None
    if some.any():
        means = summed(fit, d, lambda x: project(x)[:, some].sum(0)) / n
        apart = lambda x: project(x)[:, some] - means
        error = float(np.abs(summed(fit, d, lambda x: apart(x).T @ apart(x)) / n - np.eye(int(some.sum())).ravel()).max())
    explained = (np.maximum(values, 0.0) / trace if trace else np.zeros(k)).tolist()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                own = batch.slice(a, 1024)
                x, m = matrix_of(own.column(1), d), own.num_rows
                each = pa.array(np.repeat(np.arange(m), k))
                white = pa.array(project(x).ravel(), pa.float64(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([own.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array([n] * (m * k), pa.int64()), pa.array(deviations(x, n, sums), pa.int64()).take(each), white, pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64())], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.filter(F.size("x") == d).mapInArrow(scan, schema).withColumnRenamed("id", id_col)
