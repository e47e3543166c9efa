"""Least squares from the moments of rows: one pass for all folds, whatever the number of rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Places of a design whose products are summed up in tasks; wider ones are left to passes over the rows.
MOST_PLACES = 256
# Directions with a smaller share of the correlations than this are sums of others but for rounding.
LEAST_SHARE = 1e-12


@dataclass
class Moments:
    """Count, means and centred products of the places of a design (flags, numbers and, last, the target)."""

    n: int
    means: np.ndarray
    products: np.ndarray


def _task_functions(labels: list[list[str]], n_numbers: int):
    """Functions for `mapInArrow` that sum up rows by group, and such sums again; they need nothing of this package in a task."""
    width = sum(map(len, labels)) + n_numbers + 1

    def joined(a, b):
        if a is None:
            return b
        n, step = a[0] + b[0], b[1] - a[1]
        return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)

    def told(found):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(found), pa.int32()), pa.array([s[0] for s in found.values()], pa.int64()),
                pa.array([s[1] for s in found.values()], pa.list_(pa.float64())),
                pa.array([s[2].ravel() for s in found.values()], pa.list_(pa.float64())),
            ],
            ["group", "n", "means", "products"],
        )

    def of_rows(batches):
        found = {}
        for batch in batches:
            block, at = np.zeros((batch.num_rows, width)), 0
            for i, own in enumerate(labels):
                code = pc.index_in(batch.column(f"l{i}"), value_set=pa.array(own, batch.column(f"l{i}").type))
                code = code.fill_null(-1).to_numpy(zero_copy_only=False)
                known = np.flatnonzero(code >= 0)
                block[known, at + code[known]] = 1.0
                at += len(own)
            for i in range(n_numbers):
                block[:, at + i] = batch.column(f"x{i}").to_numpy(zero_copy_only=False)
            block[:, -1] = batch.column("y").to_numpy(zero_copy_only=False)
            groups = batch.column("group").to_numpy()
            for g in np.unique(groups).tolist():
                own = block[groups == g]
                means = own.mean(axis=0)
                centred = own - means
                found[g] = joined(found.get(g), (len(own), means, centred.T @ centred))
        yield from told(found)

    def of_sums(batches):
        found = {}
        for batch in batches:
            for r in batch.to_pylist():
                sums = r["n"], np.array(r["means"]), np.array(r["products"]).reshape(width, width)
                found[r["group"]] = joined(found.get(r["group"]), sums)
        yield from told(found)

    return of_rows, of_sums


def moments_by(df: DataFrame, group: Column, labels: dict[str, tuple[Column, list[str]]], numbers: list[Column], target: Column) -> dict[int, Moments]:
    """The moments of every group of rows, from one pass; places are a flag for each given label, the numbers and the target.

    Each task sums up its batches centred on their own means, and each group is put together in one place: a row for each task and group.
    """
    known = [own for _, own in labels.values()]
    of_rows, of_sums = _task_functions(known, len(numbers))
    schema = "group int, n long, means array<double>, products array<double>"
    rows = df.select(
        group.cast("int").alias("group"), *[c.alias(f"l{i}") for i, (c, _) in enumerate(labels.values())],
        *[c.cast("double").alias(f"x{i}") for i, c in enumerate(numbers)], target.cast("double").alias("y"),
    )
    width = sum(map(len, known)) + len(numbers) + 1
    sums = rows.mapInArrow(of_rows, schema).repartition("group").mapInArrow(of_sums, schema)
    return {r["group"]: Moments(r["n"], np.array(r["means"]), np.array(r["products"]).reshape(width, width)) for r in sums.collect()}


def joined(parts: list[Moments]) -> Moments:
    """The moments of several groups of rows together."""
    n = sum(p.n for p in parts)
    means = sum(p.means * (p.n / n) for p in parts)
    steps = [p.means - means for p in parts]
    return Moments(n, means, sum(p.products + np.outer(d, d) * p.n for p, d in zip(parts, steps)))


def plane_points(m: Moments) -> np.ndarray:
    """Two points for each place, whose least-squares fit is that of all the rows behind the moments.

    They lie on the fitted plane, along the axes of the correlations of the places and as far out as the rows do. Where places are sums of
    others (the flags of a column add up to one), many planes fit equally well; the points stand for the one without a slope in such
    a direction, so it is the only one that fits them.
    """
    spread = np.sqrt(np.diag(m.products) / m.n)
    scale = np.where(spread > 0, spread, 1.0)
    shares = m.products / m.n / np.outer(scale, scale)
    values, axes = np.linalg.eigh(shares[:-1, :-1])
    seen = values > LEAST_SHARE * max(1.0, values.max())
    slopes = np.where(seen, axes.T @ shares[:-1, -1] / np.where(seen, values, 1.0), 0.0)
    reach = np.sqrt(np.where(seen, values, 1.0) * len(values))
    steps = reach[:, None] * np.column_stack([axes.T, slopes])
    return m.means + np.vstack([steps, -steps]) * scale
