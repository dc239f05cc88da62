"""Whitening against exact sums in Python integers and a dense eigenvalue solver."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pagegrain.llm import whitening
from pagegrain.llm.queries import QUERIES


def frame(spark, vectors, ids=None):
    rows = [(i, v, 7, [0.5]) for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, whitened array<double>")


def exact(vectors):
    x = np.array([[math.floor(c * 64) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    y = n * x - s
    return x, n, s, y, y.T.dot(y)


def check(spark, vectors, count=32):
    rows = sorted(whitening.whiten(frame(spark, vectors).repartition(3), count=count).collect(), key=lambda r: r.vec_id)
    x, n, s, y, a = exact(vectors)
    assert [int(r.deviation) for r in rows] == [int(v) for v in (y * y).sum(axis=1)]
    values, basis = np.linalg.eigh(a.astype(float) / n ** 3)
    keep = [k for k in np.argsort(-values) if values[k] > 1e-9 * values.max()][:count]
    z = np.array([r.whitened for r in rows])
    assert z.shape == (n, len(keep))
    assert np.allclose(rows[0].explained, values[keep] / values.sum(), rtol=1e-9)
    assert rows[0].identity_error < 1e-9 and {r.n for r in rows} == {n}
    return z, (y.astype(float) / n) @ basis[:, keep] / np.sqrt(values[keep])


def test_equals_a_dense_solver_up_to_sign(spark):
    rng = np.random.default_rng(3)
    z, want = check(spark, (rng.normal(size=(300, 12)) * np.linspace(1, 4, 12)).tolist(), 8)
    signs = np.sign((z * want).sum(axis=0))
    assert np.abs(z * signs - want).max() < 1e-9


def test_multiple_roots_and_missing_directions(spark):
    eye = [[float(i == j) for j in range(5)] + [1.0, 0.25] for i in range(5)]
    z, _ = check(spark, eye + [[-c for c in v[:5]] + v[5:] for v in eye])
    assert z.shape[1] == 5


def test_repeated_rows_and_huge_entries(spark):
    big = [[1e17, 1.0], [1e17, 2.0], [-1e17, 3.0], [-1e17, 3.0], [0.0, 3.0]]
    x, n, s, y, a = exact(big)
    rows = sorted(whitening.whiten(frame(spark, big)).select("vec_id", "deviation").collect())
    assert [int(r.deviation) for r in rows] == [int(v) for v in (y * y).sum(axis=1)]


def test_sums_are_exact_beyond_doubles(spark):
    big = [[1e14, 3.0], [-1e14 + 1, 5.0], [7.0, 9.0], [1e14, 3.0]]
    n, s, a = whitening.scatter(frame(spark, big).withColumnRenamed("embedding", "vector"), 2)
    x = np.array([[math.floor(c * 64) for c in v] for v in big], object)
    want = n * x.T.dot(x) - np.outer(x.sum(axis=0), x.sum(axis=0))
    assert a == want.tolist()


def test_rows_that_take_no_part(spark):
    bad = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [1.0, 2.0, 3.0]]
    good = [[0.5, 0.1], [0.25, -1.0], [-3.0, 0.5], [0.5, 0.1]]
    rows = whitening.whiten(frame(spark, bad + good, [*range(6), 6, None, 8, 8]))
    assert sorted((r.vec_id is None, r.vec_id) for r in rows.collect()) == [(False, 6), (False, 8), (False, 8), (True, None)]
    assert {r.n for r in rows.collect()} == {4}


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 3])
def test_without_variance_there_is_no_component(spark, vectors):
    rows = whitening.whiten(frame(spark, vectors)).collect()
    assert len(rows) == len(vectors) and all(r.whitened == [] and r.identity_error is None and int(r.deviation) == 0 for r in rows)


def test_polynomial_of_known_matrices(spark):
    a = [[2, 1, 0], [1, 2, 0], [0, 0, 0]]
    assert whitening.polynomial(spark, a) == [0, 3, -4, 1]
    places, found = whitening.roots([0, 3, -4, 1], 5)
    assert [(r / 2 ** places, m) for r, m in found] == [(3.0, 1), (1.0, 1)]
    # (x - 2)^3 (x - 2 - 1/1)^1 expanded, a triple root
    places, found = whitening.roots([24, -44, 30, -9, 1], 5)
    assert [(round(r / 2 ** places, 12), m) for r, m in found] == [(3.0, 1), (2.0, 3)]


def test_roots_closer_than_doubles_are_told_apart():
    """(x - 10^20) (x - 10^20 - 1): one unit apart, far below double precision."""
    k = 10 ** 20
    places, found = whitening.roots([k * (k + 1), -(2 * k + 1), 1], 2)
    assert [(r + (1 << places - 1)) >> places for r, _ in found] == [k + 1, k] and [m for _, m in found] == [1, 1]


def test_query_over_the_whole_table(spark, con, sf):
    rows = QUERIES["op12_whitening"](spark, sf).collect()
    vectors = dict(con.execute("SELECT vec_id, embedding FROM embeddings").fetchall())
    x, n, s, y, a = exact([list(v) for v in vectors.values()])
    assert len(rows) == 32 * n
    deviation = dict(zip(vectors, (y * y).sum(axis=1)))
    assert all(r.deviation == deviation[r.vec_id] and r.n == n and r.identity_error <= 1e-4 for r in rows)
    values = np.sort(np.linalg.eigvalsh(a.astype(float)))[::-1]
    assert all(abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-4 for r in rows)
