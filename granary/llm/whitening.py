"""Embedding whitening by spectral divide and conquer on polar decompositions (QDWH).

Three scans of the vectors, each a sum that tasks take part by part: the sums of
each dimension; the products of each pair of dimensions, centred at the rounded
means, as exact integers; and the projections. Between them the driver holds one
matrix of dimensions times dimensions, whatever the number of rows.

The components come from the covariance V alone. For a shift s the polar factor
U of V - s*I is its matrix sign, and (U + I) / 2 projects onto the eigenvectors
above s. An orthonormal basis of that subspace and its complement split V into
two smaller blocks, which are split in turn until a block is a multiple of the
identity or one number. U comes from the dynamically weighted Halley iteration
with QR decompositions: six steps at most in double precision, each backward stable,
however near an eigenvalue lies to the shift.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.scratch import map_batches, written

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Vectors of more entries are an error: the driver holds a matrix of this width at most.
MOST_DIMS = 4096
#: Entries beyond this count as it, so that integers stay within 64 bits.
_MOST_ENTRY = float(1 << 40)
_EXACT = 1 << 53
_EPS = float(np.finfo(np.float64).eps)
_ROWS = 1024


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix (its matrix sign) by QDWH."""
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))  # no singular value is below it
    except np.linalg.LinAlgError:
        low = 0.0
    low, eye = min(1.0, max(low, _EPS)) if np.isfinite(low) else _EPS, np.eye(n)
    for _ in range(30):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2))
        a_k = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * np.sqrt(1 + d))) / 2
        b_k = (a_k - 1) ** 2 / 4
        c_k = a_k + b_k - 1
        q, _ = np.linalg.qr(np.concatenate((np.sqrt(c_k) * x, eye)))
        after = b_k / c_k * x + (a_k - b_k / c_k) / np.sqrt(c_k) * (q[:n] @ q[n:].T)
        after = (after + after.T) / 2
        moved = np.linalg.norm(after - x)
        x, low = after, min(1.0, low * (a_k + b_k * l2) / (1 + c_k * l2))
        if 1 - low < 10 * _EPS and moved < np.cbrt(10 * _EPS):
            break
    return x


def _halves(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces of ``a`` above and below a shift; None if no shift splits it (a multiple of the identity)."""
    n, norm = len(a), np.linalg.norm(a)
    diagonal = np.sort(np.diag(a))
    spread = np.linalg.norm(a - np.diag(np.full(n, diagonal.mean())))
    if spread <= n * _EPS * norm:
        return None
    # The least eigenvalue is below every diagonal entry, the greatest above. A shift upon an eigenvalue moves aside.
    for away in (0.0, 0.03, -0.03, 0.11, -0.11, 0.29, -0.29, 0.47, -0.47):
        u = polar(a - (np.median(diagonal) + away * spread / np.sqrt(n)) * np.eye(n))
        above = round((np.trace(u) + n) / 2)
        if not 0 < above < n or np.linalg.norm(u @ u - np.eye(n)) > 1e-10:
            continue
        projector = (u + np.eye(n)) / 2
        basis = projector @ rng.standard_normal((n, above))
        for _ in range(2):
            basis, _ = np.linalg.qr(basis, mode="complete")
            basis = projector @ basis[:, :above]
        q, _ = np.linalg.qr(basis, mode="complete")
        high, low = q[:, :above], q[:, above:]
        if np.linalg.norm(low.T @ a @ high) <= 100 * n * _EPS * norm:
            return high, low
    return None


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, the ``most`` greatest. Subspaces that can't hold any of them aren't split."""
    if not len(v):
        return np.zeros(0), np.zeros((0, 0))
    rng, values, vectors, open_spaces = np.random.default_rng(1), [], [], [np.eye(len(v))]
    while open_spaces and len(values) < most:
        basis = open_spaces.pop()  # of the greatest eigenvalues that aren't known yet
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        split = _halves(a, rng) if len(a) > 1 else None
        if split is None:
            values += list(np.diag(a))
            vectors += list(basis.T)
            continue
        high, low = split
        open_spaces += [basis @ low, basis @ high]
    order = np.argsort(-np.array(values), kind="stable")[:most]
    found = np.array(vectors)[order].T
    return np.array(values)[order], found / np.maximum(np.linalg.norm(found, axis=0), _EPS)


def _entries(column: pa.ListArray, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, and floor(SCALE * entry) of those, a row each; a shorter vector is filled up with zeros. Without ``dims`` as many as the longest has, or one more than are allowed."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    whole = ~column.is_null().to_numpy(zero_copy_only=False)
    if len(values):
        row = np.repeat(np.arange(len(lengths)), np.where(whole, lengths, 0))
        whole &= np.bincount(row[~np.isfinite(values)], minlength=len(lengths)) == 0
        values = values[whole[row]]
    lengths = lengths[whole]
    dims = min(int(lengths.max(initial=0)), MOST_DIMS + 1) if dims is None else dims
    if lengths.max(initial=0) > dims:
        values = values[np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths) < dims]
    out = np.zeros((len(lengths), dims), dtype=np.int64)
    out[np.arange(dims) < lengths[:, None]] = np.floor(SCALE * np.clip(values, -_MOST_ENTRY, _MOST_ENTRY)).astype(np.int64)
    return whole, out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _products(y: np.ndarray) -> np.ndarray:
    """y.T @ y in exact integers."""
    most = int(np.abs(y).max(initial=0)) ** 2 * len(y)
    if most < _EXACT:
        return (y.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64)
    return y.T @ y if most < 1 << 63 else y.astype(object).T @ y.astype(object)


def moments(vectors: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """(n, sums of each dimension, covariance with divisor n) of x = floor(SCALE * entry) + SHIFT over the vectors that take part; ``vectors`` has one column."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(0, dtype=object), 0
        for part in _parts(batches):
            _, y = _entries(part.column(0))
            total = np.pad(total, (0, max(0, y.shape[1] - len(total))))
            total[: y.shape[1]] += y.sum(axis=0).astype(object)
            n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), _decimals([n, *total])], ["i", "s"])

    found = {r["i"]: int(r["s"]) for r in map_batches(vectors, sums, "i int, s decimal(38,0)").where(F.col("i") < MOST_DIMS + 1).groupBy("i").agg(F.sum("s").alias("s")).collect()}
    n, dims = found.pop(-1, 0), 1 + max(found, default=-1)
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of more than {MOST_DIMS} entries")
    each = [found.get(i, 0) for i in range(dims)]
    if not n:
        return 0, [], np.zeros((0, 0))
    centre = np.array([(2 * s + n) // (2 * n) for s in each], dtype=np.int64)
    upper = np.triu_indices(dims)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), dtype=object)
        for part in _parts(batches):
            total += _products(_entries(part.column(0), dims)[1] - centre)
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), _decimals(total[upper])], ["i", "j", "s"])

    rows = map_batches(vectors, products, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").cast("decimal(38,0)").alias("s")).toArrow()
    rest = [s - n * int(c) for s, c in zip(each, centre)]  # what the rounded means leave
    v = np.zeros((dims, dims))
    for i, j, s in zip(*(rows.column(c).to_pylist() for c in ("i", "j", "s"))):
        v[i, j] = v[j, i] = (n * int(s) - rest[i] * rest[j]) / (n * n)
    return n, [s + n * SHIFT for s in each], v


def whitened(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector of ``embeddings`` (vec_id, embedding) that takes part, and each of its ``most`` first components.

    Vectors that are null, or hold a null or an entry that isn't finite, take
    no part. x is floor(1024 * entry) + 100000; a shorter vector counts as filled up
    with zeros, an entry beyond 2^40 as 2^40. Components are unit eigenvectors
    of x's covariance by falling eigenvalue; directions without variance (less
    than rounding leaves of the whole) are none, so there may be fewer than
    ``most``, and no row where all vectors are equal. deviation is exact; null
    where it doesn't fit a long. Null ids and repeated rows stay, each part of
    the fit; an empty table gives no rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n, sums, v = moments(rows.select("embedding"))
    values, vectors = components(v, most)
    kept = values > 64 * len(v) * _EPS * np.trace(v)
    values, vectors = values[kept], vectors[:, kept]
    shared = spark.sparkContext.broadcast((n, np.array([s - n * SHIFT for s in sums], dtype=object), vectors / np.sqrt(values)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, project = shared.value
        far = int(np.abs(sums).max(initial=0))
        for part in _parts(batches):
            whole, y = _entries(part.column(1), len(sums))
            most = n * int(np.abs(y).max(initial=0)) + far
            off = n * y - sums.astype(np.int64) if most < 1 << 63 else n * y.astype(object) - sums
            squares = (off if most * most * len(sums) < 1 << 63 else off.astype(object)) ** 2
            deviation = [int(s) if s < 1 << 63 else None for s in squares.sum(axis=1)]
            out = np.ascontiguousarray((off.astype(np.float64) / n) @ project)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(whole)), pa.array(deviation, pa.int64()), lists], ["vec_id", "deviation", "w"])

    found = written(map_batches(rows, run, "vec_id long, deviation long, w array<double>"), "whitened")
    k = len(values)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    w = [F.element_at("w", i + 1) for i in range(k)]
    error = None
    if k and n:
        got = found.agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(w)), *(F.avg(w[i] * w[j]).alias(f"p{i}_{j}") for i, j in pairs)).first()
        error = max(abs(got[f"p{i}_{j}"] - got[f"m{i}"] * got[f"m{j}"] - (i == j)) for i, j in pairs)
    shares = F.array(*(F.lit(float(e / np.trace(v))) for e in values)) if k else F.lit(None).cast("array<double>")
    each = found.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
