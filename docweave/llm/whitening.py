"""Embedding whitening: principal components of all vectors, scaled to unit variance.

Entries become integers, so sums are exact.  Every task adds up the centred products of its rows;
rows of the covariance are summed in Spark, dealt by place, and only the finished matrix comes to
the driver, where it is reduced to tridiagonal form by reflections, its leading eigenvalues are
found by bisection on Sturm counts, and their vectors by inverse iteration, made orthogonal again
within clusters of close eigenvalues.  The components are broadcast and all rows projected.

Vectors of one length are a space of their own: each length has its own fit list, components and
error.  No part is taken by vectors that are null or hold null or non-finite entries; an empty
vector has no component and gives no row.  A row without an id keeps its null id, repeated rows
count and stay, equal vectors get equal results.  A direction without variance (as where a list
has one distinct vector, or fewer than it has dimensions) cannot be scaled to one: its component
is there with ``whitened`` null and what it explains 0, and it takes no part in the error.  Entries
of more than 2^46 are cut there; a deviation beyond a long is null.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.session import stage

SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 52  # of a scaled entry, so that doubles hold it
LENGTHS = 64  # lengths of vectors, each of which has a matrix on the driver
ROWS = 1 << 22  # entries of vectors multiplied at once
FLAT = 1e-10  # share of the largest variance up to which a direction counts as without any
SUMS = "d int, i int, n long, s decimal(38,0)"
PRODUCTS = "d int, i int, row binary"


def fit_list(vectors: DataFrame) -> DataFrame:
    """vec_id, d, x (longs) of the vectors that take part."""
    v = F.col("embedding")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def scaled(c):
        cut = F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
        return F.floor(cut) + F.lit(SHIFT).cast("long")

    rows = vectors.where(v.isNotNull()).where(finite).where(F.size(v) > 0)
    return rows.select("vec_id", F.size(v).alias("d"), F.transform(v, scaled).alias("x"))


def by_length(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length: it, the rows that have it, and their entries as a matrix; in bounded blocks."""
    x = batch.column(column)
    size = np.diff(x.offsets.to_numpy())
    flat = x.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(size)])
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        step = max(1, ROWS // d)
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            yield d, some, flat[at[some][:, None] + np.arange(d)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for d, rows, x in by_length(batch):
            # Halves, so that no sum of a block leaves a long.
            high, low = x >> 26, x & ((1 << 26) - 1)
            s = [(int(h) << 26) + int(w) for h, w in zip(high.sum(0), low.sum(0), strict=True)]
            n, before = total.get(d, (0, [0] * d))
            total[d] = (n + len(rows), [a + b for a, b in zip(before, s, strict=True)])
    for d, (n, s) in total.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([d] * d, pa.int32()),
                pa.array(np.arange(d), pa.int32()),
                pa.array([n] * d, pa.int64()),
                pa.array([Decimal(v) for v in s], pa.decimal128(38, 0)),
            ],
            ["d", "i", "n", "s"],
        )


def _products(shared, column: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The centred products of a task's rows: a row per dimension."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, _, x in by_length(batch, column):
            c = centred(x, *shared.value[d])
            total[d] = total.get(d, 0) + c.T @ c
    for d, v in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d] * d, pa.int32()), pa.array(np.arange(d), pa.int32()), pa.array([r.tobytes() for r in v], pa.binary())],
            ["d", "i", "row"],
        )


def centred(x: np.ndarray, n: int, s) -> np.ndarray:
    """x - s / n, rounded once where the integers allow it."""
    if x.dtype.kind == "f":
        return x - s / n
    return deviations(x, n, s).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n x - s, exact: as longs where they suffice, as Python's integers otherwise."""
    most = max(int(x.max()), -int(x.min()), 1)
    if n * most + max(map(abs, s)) < 2**63:
        return n * x - np.array(s, np.int64)
    return n * x.astype(object) - np.array(s, object)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a matrix that are dealt to a task, summed over all tasks before."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for d, i, row in zip(*(batch.column(c) for c in range(3)), strict=True):
            key = (d.as_py(), i.as_py())
            total[key] = total.get(key, 0) + np.frombuffer(row.as_buffer(), np.float64)
    for (d, i), row in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([row.tobytes()], pa.binary())], ["d", "i", "row"])


def covariances(rows: DataFrame, column: str, means: dict[int, tuple]) -> dict[int, np.ndarray]:
    """Per length the covariance of the arrays in ``column``: d x d doubles, whatever the rows."""
    shared = rows.sparkSession.sparkContext.broadcast(means)
    parts = rows.select(column).mapInArrow(functools.partial(_products, shared, column), PRODUCTS)
    out = {d: np.zeros((d, d)) for d in means}
    for r in parts.repartition("d", "i").mapInArrow(_added, PRODUCTS).toLocalIterator():
        out[r.d][r.i] = np.frombuffer(r.row, np.float64) / means[r.d][0]
    shared.destroy()
    return {d: (v + v.T) / 2 for d, v in out.items()}


# The leading eigenvectors of a symmetric matrix


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the reflections that lead there (Householder)."""
    a = v.copy()
    reflections = []
    for k in range(len(a) - 2):
        x = a[k + 1 :, k]
        length = np.sqrt(x @ x)
        u = x.copy()
        u[0] += np.copysign(length, x[0])
        size = np.sqrt(u @ u)
        if not size or not np.abs(x[1:]).any():
            reflections.append(None)
            continue
        u /= size
        reflections.append(u)
        p = a[k + 1 :, k + 1 :] @ u
        q = p - (u @ p) * u
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(u, q) + np.outer(q, u))
        a[k + 1 :, k] -= 2 * (u @ x) * u
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def counts_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are less than each of ``at``: the negative terms of Sturm's sequence."""
    tiny = np.finfo(float).tiny * max(1.0, float((off * off).max(initial=0)))
    below, q = np.zeros(len(at), int), np.ones(len(at))
    for d, e in zip(diagonal, np.r_[0.0, off], strict=True):
        q = d - at - e * e / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each by bisection to double precision."""
    reach = np.r_[0, np.abs(off)] + np.r_[np.abs(off), 0]
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    spare = np.finfo(float).eps * max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high = low - spare, high + spare
    rank = len(diagonal) - np.arange(k)  # as many are less than what lies above the value
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high) & (high - low > spare)
        if not open_.any():
            return high
        above = counts_below(diagonal, off, middle) >= rank
        high, low = np.where(open_ & above, middle, high), np.where(open_ & ~above, middle, low)


def solver(diagonal: np.ndarray, off: np.ndarray, at: float, least: float):
    """Solves (T - at) x = b by elimination with row exchanges."""
    n = len(diagonal)
    first, second, third = diagonal - at, np.r_[off, 0.0], np.zeros(n)
    factors, swapped = np.zeros(n), np.zeros(n, bool)
    below = off.copy()
    for i in range(n - 1):
        if abs(below[i]) > abs(first[i]):
            swapped[i] = True
            f = first[i] / below[i]
            first[i], second[i], third[i], first[i + 1], second[i + 1] = (
                below[i], first[i + 1], second[i + 1], second[i] - f * first[i + 1], third[i] - f * second[i + 1],
            )
        else:
            first[i] = first[i] if abs(first[i]) > least else least
            f = below[i] / first[i]
            first[i + 1] -= f * second[i]
        factors[i] = f
    first[-1] = first[-1] if abs(first[-1]) > least else least

    def solve(b: np.ndarray) -> np.ndarray:
        b = b.copy()
        for i in range(n - 1):
            if swapped[i]:
                b[i], b[i + 1] = b[i + 1], b[i] - factors[i] * b[i + 1]
            else:
                b[i + 1] -= factors[i] * b[i]
        for i in range(n - 1, -1, -1):
            if i + 1 < n:
                b[i] -= second[i] * b[i + 1]
            if i + 2 < n:
                b[i] -= third[i] * b[i + 2]
            b[i] /= first[i]
            if abs(b[i]) > 1e150:  # only the direction counts
                b *= 1e-150
        return b

    return solve


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A unit vector per eigenvalue (falling), orthogonal within clusters of close ones."""
    rng = np.random.default_rng(seed)
    size = max(float(np.abs(values).max(initial=0)), float(np.abs(diagonal).max()), np.finfo(float).tiny)
    eps = np.finfo(float).eps * size
    out = np.zeros((len(values), len(diagonal)))
    start, used = 0, np.inf
    for k, e in enumerate(values.tolist()):
        if k and values[k - 1] - e > 1e-3 * size:
            start = k
        at = min(e, used - 10 * eps) if k > start else e  # equal values are drawn apart a little
        used = at
        solve = solver(diagonal, off, at, eps)
        x = rng.standard_normal(len(diagonal))
        for _ in range(6):
            x = solve(x / np.abs(x).max())
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[start:k].T @ (out[start:k] @ x)
            x /= np.sqrt(x @ x)
        out[k] = x
    return out


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors, as rows, of the ``k`` largest."""
    diagonal, off, reflections = tridiagonal(v)
    values = leading_values(diagonal, off, k)
    vectors = vectors_of(diagonal, off, values)
    for place in range(len(reflections) - 1, -1, -1):
        if (u := reflections[place]) is not None:
            tail = vectors[:, place + 1 :]
            tail -= 2 * np.outer(tail @ u, u)
    largest = np.abs(vectors).argmax(1)
    sign = np.where(np.take_along_axis(vectors, largest[:, None], 1) < 0, -1.0, 1.0)
    return values, vectors * sign


# Projection


def _project(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, d, deviation and the whitened components of each row."""
    for batch in batches:
        for d, rows, x in by_length(batch):
            n, s, scaled = shared.value[d]
            far = deviations(x, n, s)
            exact = far.astype(object) if float(np.abs(far).max()) ** 2 * d >= 2.0**62 else far
            total = [int(v) if v < 2**63 else None for v in (exact * exact).sum(1).tolist()]
            w = (far.astype(np.float64) / n) @ scaled
            flat = pa.array(w.ravel(), pa.float64())
            at = pa.array(np.arange(len(rows) + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)), pa.array([d] * len(rows), pa.int32()), pa.array(total, pa.int64()), pa.ListArray.from_arrays(at, flat)],
                ["vec_id", "d", "deviation", "w"],
            )


def whiten(vectors: DataFrame, most: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    spark = vectors.sparkSession
    rows = stage(fit_list(vectors))
    sums = rows.mapInArrow(_sums, SUMS).groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    lengths = [r.d for r in rows.select("d").distinct().limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    means: dict[int, tuple[int, list[int]]] = {d: (0, [0] * d) for d in lengths}
    for r in sums.collect():
        means[r.d][1][r.i] = int(r.s)
        means[r.d] = (r.n, means[r.d][1])
    models, explained = {}, {}
    for d, v in covariances(rows, "x", means).items():
        trace, k = float(np.trace(v)), min(most, d)
        values, components = leading_components(v, k) if trace > 0 else (np.zeros(k), np.zeros((k, d)))
        varied = int((values > FLAT * values[0]).sum())
        models[d] = (*means[d], components[:varied].T / np.sqrt(values[:varied]))
        explained[d] = [float(e) / trace for e in values[:varied]] + [0.0] * (len(values) - varied)
    shared = spark.sparkContext.broadcast(models)
    projected = stage(rows.mapInArrow(functools.partial(_project, shared), f"vec_id {kind}, d int, deviation long, w array<double>"))
    errors = identity_errors(projected, models)
    facts = [(d, means[d][0], explained[d], errors.get(d)) for d in lengths]
    known = F.broadcast(spark.createDataFrame(facts, "d int, n long, explained array<double>, identity_error double"))
    each = projected.join(known, "d").select("*", F.posexplode("explained").alias("i", "share"))
    return each.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", F.get("w", "i").alias("whitened"),
        F.col("share").alias("explained"), "identity_error",
    )


def identity_errors(projected: DataFrame, models: dict[int, tuple]) -> dict[int, float]:
    """Per length the largest entry of the whitened rows' covariance minus the identity.

    A length with one vector, or equal ones, has no direction to whiten and error 0.
    """
    sums = projected.select("d", F.posexplode("w").alias("i", "v")).groupBy("d", "i").agg(F.sum("v").alias("s"))
    totals: dict[int, dict[int, float]] = {}
    for r in sums.collect():
        totals.setdefault(r.d, {})[r.i] = r.s
    out = {d: 0.0 for d in models}
    for d, s in totals.items():  # apart, as vectors of several lengths may have as many components
        mean = {len(s): (models[d][0], np.array([s[i] for i in range(len(s))]))}
        (v,) = covariances(projected.where(F.col("d") == d), "w", mean).values()
        out[d] = float(np.abs(v - np.eye(len(v))).max())
    return out
