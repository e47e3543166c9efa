import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm.whitening import fit_whitening, grid, leading_eigenpairs, whiten

SCHEMA = "vec_id long, embedding array<float>, n string, x string, whitened string"


def rows_of(vectors, first=0):
    return [(first + i, None if v is None else [None if c is None else float(c) for c in v], "a", "b", "c") for i, v in enumerate(vectors)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    plain = rng.standard_normal((400, 24)) * np.r_[8, 5, np.linspace(1, 1.1, 22)]
    return np.vstack([plain, np.repeat(plain[:1], 200, axis=0)]).astype(np.float32)  # a third are copies of one


def brute(vectors, k):
    x = np.floor(64 * vectors.astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), ((n * x - s) / n) @ u / np.sqrt(e), e / (c**2).sum() * n


def test_equals_a_dense_eigensolver(spark, vectors):
    df = spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(5)
    n, deviation, white, explained = brute(vectors, 16)
    got = whiten(df).collect()
    assert len(got) == 16 * len(vectors)
    table = np.zeros((len(vectors), 16))
    for r in got:
        i, j = r["vec_id"], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation[i])
        assert r["explained"] == pytest.approx(explained[j], rel=1e-9) and r["identity_error"] < 1e-9
        table[i, j] = r["whitened"]
    signs = np.sign((table * white).sum(axis=0))
    assert np.abs(table * signs - white).max() < 1e-8


def test_odd_rows(spark, vectors):
    good = [[1, 2, 3], [2, 2, 5], [4, 0, 1], [1, 2, 3]]
    odd = [None, [], [1, None, 2], [math.nan, 1, 2], [1, math.inf, 2], [1e30, 1, 1], [1, 2], [1, 2, 3, 4]]
    df = spark.createDataFrame([*rows_of(good), *rows_of(odd, 100), *rows_of([good[0]], 0), (None, [4.0, 0.0, 1.0], None, None, None)], SCHEMA)
    got = whiten(df).collect()
    assert {r["vec_id"] for r in got} == {0, 1, 2, 3, None}
    assert {r["n"] for r in got} == {3} and {r["component"] for r in got} == {1, 2}  # three points span a plane
    assert sum(r["vec_id"] == 0 for r in got) == 4
    assert grid("embedding") is not None
    assert df.where(grid("embedding").isNull()).count() == 5


def test_nothing_varies(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    same = spark.createDataFrame(rows_of([[1, 1]] * 3), SCHEMA)
    one = spark.createDataFrame(rows_of([[5, 7]]), SCHEMA)
    assert whiten(nothing).count() == whiten(same).count() == whiten(one).count() == 0
    assert whiten(nothing).columns == whiten(spark.createDataFrame(rows_of([[1, 2], [2, 1]]), SCHEMA)).columns


def test_deviation_is_exact_or_missing(spark):
    df = spark.createDataFrame([(i, [float(v) * 2**30, 0.0]) for i, v in enumerate([1, -1, 3])], "vec_id long, embedding array<double>")
    x = [[(v << 30) * 64 + 1_000_000, 1_000_000] for v in (1, -1, 3)]
    sums = [sum(c) for c in zip(*x)]
    true = [sum((3 * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    got = {r["vec_id"]: r["deviation"] for r in whiten(df).collect()}
    assert got == {i: v if v < 2**63 else None for i, v in enumerate(true)}


@pytest.mark.parametrize("spectrum", [
    np.ones(60), np.r_[1e6, 1e3, np.linspace(1, 2, 70)], np.exp(-np.arange(120) / 5), np.r_[np.ones(3), np.zeros(60)],
    np.linspace(1, 1.0001, 90), np.arange(5.0), np.zeros(8), np.r_[50.0, np.full(40, 2.0), np.ones(40)],
], ids=range(8))
def test_eigenpairs(spectrum):
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((len(spectrum), len(spectrum))))[0]
    v = (q * spectrum) @ q.T
    values, vectors, residual, passes = leading_eigenpairs(lambda b: v @ b, len(spectrum), 16)
    assert np.abs(values - np.sort(spectrum)[::-1][:16]).max() <= 1e-12 * max(1, spectrum.max())
    assert residual <= 1e-12 * max(1, spectrum.max()) and passes < 400
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-12


def test_partitions_do_not_matter(spark, vectors):
    df = spark.createDataFrame(rows_of(vectors), SCHEMA).select(grid("embedding").alias("x"))
    models = [fit_whitening(df.repartition(p), 4) for p in (1, 40)]
    assert np.allclose(models[0].eigenvalues, models[1].eigenvalues, rtol=1e-12)
    assert (models[0].whole == models[1].whole).all() and (models[0].rest == models[1].rest).all()
