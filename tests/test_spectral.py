"""Eigenpairs in tables against dense ones."""

import numpy as np
import pytest

from cladewise.operators import distances, embedding, spectral
from cladewise.plans.config import AnalysisConfig


def _pairs(spark, many):
    rows = [(ds, i, j, float(d[i, j])) for ds, d in enumerate(many) for i in range(len(d)) for j in range(i + 1, len(d))]
    return spark.createDataFrame(rows, "ds long, i long, j long, d double")


def _euclid(x):
    return np.sqrt(np.maximum(0, ((x[:, None] - x[None]) ** 2).sum(-1)))


@pytest.fixture(scope="module")
def sets():
    rng = np.random.default_rng(4)
    line = _euclid(np.arange(5.0)[:, None])  # one dimension only
    equal = np.ones((9, 9)) - np.eye(9)  # eight equal eigenvalues
    noisy = _euclid(rng.normal(0, 1, (64, 4)) * [9, 5, 3, 2])
    noisy = np.triu(noisy + 0.1 * rng.random(noisy.shape), 1)
    return [line, noisy + noisy.T, equal, _euclid(np.array([[0.0], [3.0]]))]


def _near(spark, sets, config):
    pairs = _pairs(spark, sets)
    got = spectral.embed(pairs, config).toPandas()
    want = embedding.embed(pairs, config).toPandas()
    for ds in range(len(sets)):
        a, b = (np.stack(f[f.ds == ds].sort_values("taxon")["x"].to_list()) for f in (got, want))
        assert a.shape == b.shape
        b = b * np.where((a * b).sum(0) < 0, -1, 1)  # of equals at both ends either may give the side
        yield ds, a, b


def test_points_in_flat_space(spark, sets):
    for ds, a, b in _near(spark, sets, AnalysisConfig(dimensionality=3)):
        if ds == 2:  # any three of the equal directions do, so their lengths are compared
            assert np.allclose(a.T @ a, 0.5 * np.eye(3), atol=1e-6)
        else:
            assert np.allclose(a, b, atol=1e-5), ds


def test_points_on_the_hyperboloid(spark, sets):
    small = [d / d.max() for d in sets]
    for ds, a, b in _near(spark, small, AnalysisConfig(dimensionality=2, hyperbolic=True)):
        if ds == 2:
            assert np.allclose((a * a).sum(0), (b * b).sum(0), atol=1e-6)
        else:
            assert np.allclose(a, b, atol=1e-5), ds


def test_covariance_of_distances_that_fit_no_space(spark):
    d = np.full((6, 6), 1.0)
    d[0, 1:] = d[1:, 0] = [0.1, 0.1, 9.0, 9.0, 0.1]
    np.fill_diagonal(d, 0)
    h = np.eye(6) - 1 / 6
    b = -0.5 * h @ d @ h
    least = np.linalg.eigvalsh(b)[0]
    assert least < -0.1
    b += (spectral.MARGIN - least) * np.eye(6)
    b *= 2 * 6 / np.trace(b)
    got = spectral.distance_covariance(_pairs(spark, [d]), 2.0).toPandas()
    assert len(got) == 21
    assert all(abs(r.b - b[r.i, r.j]) < 1e-6 for r in got.itertuples())
    assert distances.double_centre(_pairs(spark, [])).count() == 0


def test_no_rows(spark):
    assert spectral.embed(_pairs(spark, [])).count() == 0
    assert spectral.distance_covariance(_pairs(spark, [])).count() == 0


def test_products_are_summed_by_batches(spark):
    """One row leaves for each data set of a batch, not one for each product; blocks of numbers far apart make one data set."""
    rng = np.random.default_rng(2)
    q, w = rng.normal(size=(40, 3)), rng.normal(size=(40, 2))
    rows = spark.createDataFrame([(k % 2, 700 * k, q[k].tolist(), w[k].tolist()) for k in range(40)], "ds long, i long, q array<double>, w array<double>")
    found = spectral._products(rows.repartition(3), "q", "w", "c")
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.ds: np.reshape(r.c, (3, 2)) for r in found.collect()}
    small = spark.createDataFrame([(d, got[d].ravel().tolist(), [2.0, 0.0, 0.0, 1.0]) for d in got], "ds long, c array<double>, t array<double>")
    moved = {r.i: r.w for r in spectral._applied(rows, small, ["c", "t"], ["q"], "w", lambda q, w, c, t: (w - q @ c.reshape(3, 2)) @ t.reshape(2, 2)).collect()}
    for d in (0, 1):
        assert np.allclose(got[d], q[d::2].T @ w[d::2])
        assert np.allclose([moved[700 * k] for k in range(d, 40, 2)], (w[d::2] - q[d::2] @ got[d]) @ np.diag([2.0, 1.0]))
