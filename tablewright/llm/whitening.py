"""Embedding whitening: leading eigenvectors of the covariance by Chebyshev-filtered subspace iteration.

The covariance matrix is never formed. A pass over the centred vectors multiplies it with a block of
columns: every task adds up its own Xᵀ(XQ), the sums are added in Spark, and the driver holds matrices of
dimension x block only. A polynomial of such passes damps the unwanted end of the spectrum, QR makes the
block orthonormal again, and Rayleigh-Ritz reads off eigenvalues and residuals, until these certify the
wanted pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Grid that entries are rounded down to: steps per unit, and the shift that makes them positive.
STEPS, SHIFT = 64, 1_000_000
#: Entries of larger size are no embeddings; below it grid values and their differences are exact.
LARGEST = float(2**40)
#: A pair is certified if its residual is at most this share of the largest eigenvalue.
RESIDUAL = 1e-13
#: Degree of a filter, and what it may amplify the largest eigenvalue over the smallest wanted one by.
DEGREE, AMPLIFY = 20, 1e12
#: Passes after which a block that converges too slowly is doubled.
SLOW = 160
#: Partial sums that the driver adds up itself; more are added in Spark first.
AT_ONCE = 32


def grid(vector_col: str) -> Column:
    """The vector on the grid as array<bigint>; NULL for vectors that are missing or hold a NULL, NaN, infinite or absurd entry."""
    entries = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST))
    return F.when(
        F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(False)),
        F.transform(entries, lambda c: F.floor(c * STEPS).cast("long") + SHIFT),
    )


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(df: DataFrame, step: Callable[[np.ndarray], np.ndarray], like: np.ndarray) -> np.ndarray:
    """The sum of `step` over batches of the vectors `x`; `like` has its type and shape."""
    dtype, shape = like.dtype, like.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(shape, dtype), 0
        for batch in batches:
            if batch.num_rows:
                total += step(_matrix(batch.column("x")))
                rows += batch.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype)
        for batch in batches:
            for part in batch.column("part"):
                total += np.frombuffer(part.as_py(), dtype).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts, n = df.select("x").mapInArrow(partial, "part binary"), df.rdd.getNumPartitions()
    while n > AT_ONCE:
        n = math.ceil(math.sqrt(n))
        parts = parts.repartition(n).mapInArrow(added, "part binary")
    total = np.zeros(shape, dtype)
    for row in parts.collect():  # at most AT_ONCE matrices
        total += np.frombuffer(row["part"], dtype).reshape(shape)
    return total


def _centred(whole: np.ndarray, rest: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """x - mean without rounding the mean: its integer part is subtracted from integers first."""
    return lambda x: (x - whole) - rest


@dataclass(frozen=True)
class Whitening:
    """A fitted transform. The mean of a dimension is whole + rest / n, exactly."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    components: np.ndarray  # dimension x components, unit columns
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]

    def apply(self, df: DataFrame, x_col: str = "x") -> DataFrame:
        """Add `whitened` array<double> and `deviation` long, the exact sum of (n x - S)² over dimensions.

        A deviation of 2^63 or more does not fit and is NULL.
        """
        n, whole, rest = self.n, self.whole, self.rest
        centre = _centred(whole, rest / max(1, n))
        scaled = self.components / np.sqrt(self.eigenvalues)
        names = [c for c in df.columns if c != x_col]
        schema = df.select(*[F.col(c) for c in names]).schema.simpleString()[7:-1]
        fields = ", ".join([*([schema] if schema else []), "whitened:array<double>", "deviation:bigint"])

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(x_col))
                apart = x - whole
                reach = (float(np.abs(apart).max()) + 1) * n
                if reach * reach * x.shape[1] < 2**62:
                    deviation = ((apart * n - rest) ** 2).sum(axis=1).tolist()
                else:
                    sums = ((apart.astype(object) * n - rest.astype(object)) ** 2).sum(axis=1)
                    deviation = [v if v < 2**63 else None for v in sums]
                out = centre(x) @ scaled
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(out) + 1) * scaled.shape[1], pa.int32()), pa.array(out.ravel(), pa.float64())
                )
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in names], lists, pa.array(deviation, pa.int64())], [*names, "whitened", "deviation"]
                )

        return df.mapInArrow(rows, f"struct<{fields}>")


def _rate(value: float, top: float) -> float:
    """Growth per pass of an eigenvalue above the damped interval [0, top]."""
    t = max(1.0, 2 * value / top - 1) if top > 0 else 2.0
    return t + math.sqrt(t * t - 1)


def _filtered(times: Callable[[np.ndarray], np.ndarray], block: np.ndarray, degree: int, top: float, largest: float) -> np.ndarray:
    """The scaled Chebyshev recurrence: eigenvalues in [0, top] stay small, the largest is kept near 1."""
    half = top / 2
    sigma_1 = sigma = half / (largest - half)
    before, now = block, (times(block) - half * block) * (sigma_1 / half)
    for _ in range(degree - 1):
        following = 1 / (2 / sigma_1 - sigma)
        before, now = now, (times(now) - half * now) * (2 * following / half) - (sigma * following) * before
        sigma = following
    return now


def leading_eigenpairs(times: Callable[[np.ndarray], np.ndarray], dimension: int, wanted: int, seed: int = 7):
    """(eigenvalues, unit eigenvectors, largest residual, passes) of a symmetric positive semidefinite operator.

    `times` multiplies it with a block of columns and is one pass over the data. The block holds three times the
    wanted columns; one that converges too slowly, because the spectrum has no gap behind it, is
    doubled, and a block of the whole dimension is exact after one pass. Pairs that are certified are locked
    and kept out of the filter.
    """
    wanted = min(wanted, dimension)
    width, draw, passes = min(dimension, 3 * wanted), np.random.default_rng(seed), 0

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return times(q)

    def away(q: np.ndarray, locked: np.ndarray) -> np.ndarray:
        return q - locked @ (locked.T @ q)

    def ritz(q: np.ndarray):
        image = product(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, image = q @ turn, image @ turn
        return values, vectors, np.linalg.norm(image - vectors * values, axis=0)

    locked = np.zeros((dimension, 0))
    values, vectors, residuals = ritz(np.linalg.qr(draw.standard_normal((dimension, width)))[0])
    largest = values[0]
    stalled, best = 0, math.inf
    while largest > 0:
        need = wanted - locked.shape[1]
        good = 0
        while good < need and residuals[good] <= RESIDUAL * largest:
            good += 1
        if good == need or locked.shape[1] + vectors.shape[1] >= dimension or stalled >= 3:
            break
        if good:
            locked = np.linalg.qr(np.hstack([locked, vectors[:, :good]]))[0]
            values, vectors, residuals, need = values[good:], vectors[:, good:], residuals[good:], need - good
            best = math.inf
        top = max(values[-1], 1e-14 * largest)
        first, last = _rate(values[0], top), _rate(values[need - 1], top)
        ahead = math.log(max(residuals[:need].max() / (RESIDUAL * largest), 1.0)) / max(math.log(last), 1e-9)
        if ahead > SLOW and vectors.shape[1] + locked.shape[1] < dimension:
            more = min(dimension - locked.shape[1], 2 * vectors.shape[1]) - vectors.shape[1]
            vectors = np.hstack([vectors, draw.standard_normal((dimension, more))])
            values, vectors, residuals = ritz(np.linalg.qr(away(away(vectors, locked), locked))[0])
            largest, best = max(largest, values[0]), math.inf
            continue
        degree = max(2, min(DEGREE, math.ceil(ahead) + 1, int(math.log(AMPLIFY) / max(math.log(first / last), 1e-9))))
        block = _filtered(lambda q: away(product(q), locked), vectors, degree, top, max(values[0], top * (1 + 1e-9)))
        values, vectors, residuals = ritz(np.linalg.qr(away(np.linalg.qr(away(block, locked))[0], locked))[0])
        largest = max(largest, values[0])
        worst = residuals[:need].max()
        # rounding sets a floor: three filters that no longer halve the residual have reached it
        stalled, best = (0, worst) if worst < best / 2 else (stalled + 1, min(best, worst))
    values, vectors, residuals = ritz(np.linalg.qr(np.hstack([locked, vectors]))[0])
    return values[:wanted], vectors[:, :wanted], float(residuals[:wanted].max(initial=0.0)), passes


def fit_whitening(vectors: DataFrame, n_components: int = 16, x_col: str = "x") -> Whitening | None:
    """Fit on the distinct vectors of `vectors` (array<bigint>, all of one dimension); None if there are none.

    Sums are exact, the covariance has divisor n, and vectors are centred before they are multiplied. Components
    whose eigenvalue is 0, up to 1e-12 of the largest, can't be whitened and are left out.
    """
    fit = cut_lineage(vectors.select(F.col(x_col).alias("x")).distinct())
    head = fit.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = head["n"], head["d"] or 0
    if not n or not d:
        return None
    bits, low = np.int64(23), np.int64(2**23 - 1)  # halves whose sums fit 64 bits for 2^40 vectors
    halves = _summed(fit, lambda x: np.stack([(x >> bits).sum(axis=0), (x & low).sum(axis=0)]), np.zeros((2, d), np.int64))
    sums = [(int(a) << 23) + int(b) for a, b in halves.T]
    whole, rest = (np.array([f(s, n) for s in sums], np.int64) for f in (lambda s, m: s // m, lambda s, m: s % m))
    centre = _centred(whole, rest / n)

    def times(q: np.ndarray) -> np.ndarray:
        def step(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return c.T @ (c @ q)

        return _summed(fit, step, np.zeros((d, q.shape[1]))) / n

    trace = float(_summed(fit, lambda x: (centre(x) ** 2).sum(axis=0), np.zeros(d)).sum() / n)
    values, components, residual, passes = leading_eigenpairs(times, d, n_components)
    if residual > 1e-9 * max(values[0], 0.0):
        raise ArithmeticError(f"eigenpairs are not certified: residual {residual:g} after {passes} passes")
    usable = values > 1e-12 * max(values[0], 1e-300)
    values, components = values[usable], components[:, usable]
    scaled = components / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centre(x) @ scaled
        return np.vstack([w.T @ w, w.sum(axis=0)])

    k = len(values)
    found = _summed(fit, moments, np.zeros((k + 1, k))) / n
    error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max(initial=0.0))
    return Whitening(n, whole, rest, components, values, trace, error, residual, passes)


def whiten(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", n_components: int = 16) -> DataFrame:
    """One row for each usable row of `df` and component: whitened coordinates of its vector.

    Vectors are rounded down to a grid of 1/64. A row is dropped if its vector is missing or empty, holds a NULL, NaN,
    infinite entry or one beyond 2^40 in size, or has another length than the most frequent one (of equally frequent
    ones the longest). The fit uses every distinct vector once, so copies have no weight, and all rows are transformed, repeated
    ids and rows included. Columns: id, component (from 1, by falling eigenvalue), n (distinct vectors), deviation, whitened,
    explained (share of the total variance), identity_error (of the whitened covariance), n_components, n_passes,
    residual. There are fewer components than asked for where the vectors vary in fewer directions, and no rows
    where they don't vary. Other columns are not read; an empty table gives an empty table.
    """
    rows = df.select(F.col(id_col).alias("id"), grid(vector_col).alias("x")).where("x is not null and size(x) > 0")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("x") == (lengths["d"] if lengths else 0))
    model = fit_whitening(rows, n_components) if lengths else None
    if model is None or not len(model.eigenvalues):
        kind = dict(df.dtypes)[id_col]
        return df.sparkSession.createDataFrame(
            [], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, "
            "n_components int, n_passes int, residual double",
        )
    explained = F.array(*[F.lit(v) for v in model.explained])
    return model.apply(rows).select(
        F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("at", "whitened")
    ).select(
        id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
        F.lit(len(model.eigenvalues)).alias("n_components"), F.lit(model.passes).alias("n_passes"), F.lit(model.residual).alias("residual"),
    )
