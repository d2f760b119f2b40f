"""Operator 12: whitening of embeddings by principal components from FEAST contour integration.

Spark gathers the count, the exact sums and the centred second moments of the distinct vectors; only the
d x d covariance reaches the driver.  There its spectrum is cut into intervals by inertia counts (signs of
an LDL^T factorisation).  For each interval a quadrature of complex shifted solves around it projects a
random block onto the eigenspace inside, Rayleigh-Ritz extracts the eigenpairs, and the interval is done
when as many lie inside as the inertia counts say.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textbytes as tb

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Eigenvalues of one contour, at most (a tighter cluster is one contour), and its quadrature nodes.
PER_CONTOUR, NODES = 8, 12
#: Share of the trace below which a variance counts as zero.
ZERO = 1e-13
_ENTRIES = 1 << 19


def inertia_below(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix `a` are below `shift`: the negative pivots of a
    Bunch-Parlett LDL^T factorisation of a - shift * I."""
    m, negative = a - shift * np.eye(len(a)), 0
    while len(m):
        size = np.abs(m)
        p = int(np.argmax(np.diagonal(size)))
        i, j = divmod(int(np.argmax(size)), len(m))
        if size[i, j] == 0:
            return negative
        pivot = [p] if i == j or size[p, p] >= 0.64 * size[i, j] else sorted((i, j))
        block = m[np.ix_(pivot, pivot)]
        negative += int(block[0, 0] < 0) if len(pivot) == 1 else 1  # such a 2 x 2 block has one eigenvalue of each sign
        rest = np.delete(np.arange(len(m)), pivot)
        side = m[np.ix_(rest, pivot)]
        m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
    return negative


def spectrum_slices(a: np.ndarray, wanted: int, most: int = PER_CONTOUR) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside) from the top down that hold at least the `wanted` largest
    eigenvalues, each with `most` or a cluster that cannot be told apart."""
    bound = float(np.abs(a).sum(1).max())
    high, low = 1.01 * bound + 1e-300, -0.01 * bound - 1e-300
    found, total, todo = [], 0, [(low, high, len(a), 0)]
    while todo and total < wanted:
        lo, hi, under_hi, under_lo = todo.pop()
        count = under_hi - under_lo
        if not count:
            continue
        if count <= most or hi - lo < 1e-11 * bound:
            found.append((lo, hi, count))
            total += count
            continue
        gap = 1e-3 * (hi - lo)
        for part in (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65):  # cut where no eigenvalue is near
            cut = lo + part * (hi - lo)
            under = inertia_below(a, cut)
            if under == inertia_below(a, cut - gap) == inertia_below(a, cut + gap):
                break
        todo += [(lo, cut, under, under_lo), (cut, hi, under_hi, under)]
    return found


def contour_eigenpairs(a: np.ndarray, low: float, high: float, count: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenvalues inside (low, high), falling, and their unit eigenvectors as columns."""
    d, norm = len(a), float(np.abs(a).sum(1).max())
    rng = np.random.default_rng(20)
    for more in (1, 2, 4):
        at, weight = np.polynomial.legendre.leggauss(nodes * more)
        turn = np.exp(0.5j * np.pi * (1 - at))
        centre, radius = (low + high) / 2, (high - low) / 2
        block = rng.standard_normal((d, min(d, (3 * count // 2 + 4) * more)))
        best = np.inf
        for _ in range(40):
            moved = np.zeros_like(block)
            for t, w in zip(turn, weight):
                moved += (w / 2) * (radius * t * np.linalg.solve((centre + radius * t) * np.eye(d) - a, block.astype(complex))).real
            left, size, _ = np.linalg.svd(moved, full_matrices=False)
            basis = left[:, size > 1e-14 * size[0]] if size[0] > 0 else left
            values, small = np.linalg.eigh(basis.T @ a @ basis)
            vectors = basis @ small
            inside = np.flatnonzero((values > low) & (values < high))
            error = np.abs(a @ vectors[:, inside] - vectors[:, inside] * values[inside]).max(initial=0.0) / norm
            if len(inside) == count and (error < 1e-15 or (error < 1e-12 and error >= best / 2)):
                order = inside[::-1]
                return values[order], vectors[:, order]
            best = min(best, error) if len(inside) == count else np.inf
            block = vectors
    raise ArithmeticError(f"{count} eigenvalues between {low} and {high} were counted but not found")


def largest_eigenpairs(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` (or all) largest eigenvalues of a symmetric matrix, falling, and their eigenvectors."""
    wanted = min(wanted, len(a))
    if not wanted or not np.abs(a).max():
        return np.zeros(wanted), np.eye(len(a))[:, :wanted]
    parts = [contour_eigenpairs(a, *s) for s in spectrum_slices(a, wanted)]
    return np.concatenate([p[0] for p in parts])[:wanted], np.concatenate([p[1] for p in parts], axis=1)[:, :wanted]


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, list<double>) -> (id, dim, x as little-endian int64 bytes) of the usable rows."""
    for batch in batches:
        sizes = batch.column(1).value_lengths().fill_null(0).to_numpy()
        step = max(1, _ENTRIES // max(1, int(sizes.max(initial=1))))
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            vectors, size = part.column(1), sizes[lo:lo + step].astype(np.int64)
            bounds = np.concatenate(([0], np.cumsum(size)))
            c = vectors.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                c = np.floor(SCALE * c)
                good = np.abs(c) < 2.0 ** 62
            x = np.where(good, c, 0).astype(np.int64) + OFFSET
            usable = (tb.segment_sum((~good).astype(np.int64), bounds) == 0) & (size > 0) & vectors.is_valid().to_numpy(zero_copy_only=False)
            held = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((8 * bounds).astype(np.int32)), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), held], ["id", "dim", "x"]).filter(pa.array(usable))


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their `x` as an int64 matrix."""
    step = max(1, _ENTRIES // d)
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            yield part, np.frombuffer(b"".join(part.column("x").to_pylist()), dtype="<i8").reshape(-1, d)


def _sums(d: int):
    """x -> (j, n, high, low): the sum of entry j is high * 2**32 + low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in _matrices(batches, d):
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["j", "n", "high", "low"])

    return run


def _moments(d: int, base: np.ndarray, part: np.ndarray, project: np.ndarray | None):
    """x -> (k, value): sums of products of the centred (and projected) entries; k is row * width + column,
    and width * width + column for plain sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = d if project is None else project.shape[1]
        total, plain, n = np.zeros((width, width)), np.zeros(width), 0
        for _, x in _matrices(batches, d):
            y = (x - base) - part
            y = y if project is None else y @ project
            total, plain, n = total + y.T @ y, plain + y.sum(0), n + len(x)
        if n:
            flat = np.concatenate((total.ravel(), plain))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "value"])

    return run


def _covariance(fit: DataFrame, n: int, d: int, base: np.ndarray, part: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    width = d if project is None else project.shape[1]
    rows = fit.mapInArrow(_moments(d, base, part, project), "k long, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(width * (width + 1))
    for r in rows:
        flat[r["k"]] = r["value"]
    mean = flat[width * width:] / n
    out = flat[:width * width].reshape(width, width) / n - np.outer(mean, mean)
    return (out + out.T) / 2


def _report(d: int, n: int, base: np.ndarray, over: list[int], part: np.ndarray, project: np.ndarray, explained: np.ndarray, error: float):
    """(id, x) -> the report's rows."""
    k, left = project.shape[1], np.array(over, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _matrices(batches, d):
            y = x - base
            white = (y - part) @ project
            reach = n * (int(np.abs(y).max(initial=0)) + 1)
            if reach * reach * d < 1 << 63:
                apart = ((n * y - np.array(over, dtype=np.int64)) ** 2).sum(1).tolist()
            else:
                apart = [s if s < 1 << 63 else None for s in ((n * y.astype(object) - left) ** 2).sum(1)]
            m = len(x)
            yield pa.RecordBatch.from_arrays([
                rows.column("id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pa.array(apart, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: id, component, n, deviation, whitened, explained,
    identity_error.

    Entries c become x = floor(64 c) + 1000000.  The principal components, numbered from 1 by falling
    eigenvalue, are those of the covariance of the distinct x vectors (divisor n); whitened is the centred
    x on the component over the root of its eigenvalue, explained the eigenvalue's share of the trace,
    deviation the exact sum of (n x - S)^2 (null where it passes 64 bits), identity_error how far the
    covariance of the whitened distinct vectors is from the identity.

    Left out are null and empty vectors, those with a null or non-finite entry (or one whose 64 c has no
    64-bit integer), and those of another length than the most frequent one (of equals the longest).
    Components without variance are left out, so one distinct vector, or an empty table, gives no rows.
    Null and repeated ids are kept; repeated vectors count once in the fit and each has its rows.  Other
    columns are not read.

    Jobs run while the frame is built: the driver gets d sums and d * d second moments, whatever the
    number of rows.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    held = shared.stored(rows.mapInArrow(_quantised, f"id {kind}, dim long, x binary"), "whitening")
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sizes = held.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    none = held.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    if sizes is None:
        return none
    d = sizes["dim"]
    held = held.where(F.col("dim") == d).select("id", "x")
    fit = shared.stored(held.select("x").distinct(), "whitening-fit")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = {r["j"]: r for r in fit.mapInArrow(_sums(d), "j long, n long, high long, low long").groupBy("j").agg(F.sum("n").alias("n"), exact("high"), exact("low")).collect()}
    n = sums[0]["n"]
    whole, over = zip(*(divmod((int(sums[j]["high"]) << 32) + int(sums[j]["low"]), n) for j in range(d)))
    base, part = np.array(whole, dtype=np.int64), np.array([o / n for o in over])
    cov = _covariance(fit, n, d, base, part)
    trace = float(np.trace(cov))
    values, axes = largest_eigenpairs(cov, components)
    some = values > ZERO * trace
    values, axes = values[some], axes[:, some]
    if not len(values):
        return none
    project = axes / np.sqrt(values)
    error = float(np.abs(_covariance(fit, n, d, base, part, project) - np.eye(len(values))).max())
    out = held.mapInArrow(_report(d, n, base, list(over), part, project, values / trace, error), schema)
    return out.withColumnRenamed("id", id_col)
