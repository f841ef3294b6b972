"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest

from lexis.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def dense(vectors, k=32):
    """n, sums, x, eigenpairs of the centred covariance, by numpy on exact integers."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = ((n * x - s) / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return n, s, x, centred, e[::-1][:k], u[:, ::-1][:, :k]


def check(got, kept, k):
    n, s, x, centred, e, u = dense([v for _, v in kept], k)
    e, u = e[:k], u[:, :k]
    want = centred @ u / np.sqrt(e)
    by_row: dict = {}
    for r in got:
        by_row.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    sign = np.ones(k)
    assert len(got) == len(kept) * k
    for j in range(k):
        mine = np.array([by_row[i][j + 1][0]["whitened"] for i, _ in kept])
        sign[j] = np.sign(mine @ want[:, j])
        assert np.allclose(mine * sign[j], want[:, j], atol=1e-8)
    for (i, _), row in zip(kept, x):
        r = by_row[i][1][0]
        assert r["n"] == n and r["deviation"] == sum(int(n * a - b) ** 2 for a, b in zip(row, s))
        assert abs(r["explained"] / (e[0] / (centred ** 2).sum(axis=1).mean()) - 1) < 1e-9
        assert r["identity_error"] < 1e-10


@pytest.mark.parametrize("dim", [3, 48, 90])
def test_equals_dense(spark, dim):
    rng = np.random.default_rng(dim)
    vectors = (rng.normal(size=(400, dim)) * np.linspace(0.2, 2, dim)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(900, None), (901, [float("nan")] * dim), (902, [1.0, None] + [0.0] * (dim - 2)), (903, [float("inf")] + [0.0] * (dim - 1)), (904, []), (905, [1.0])]
    df = spark.createDataFrame(rows + bad, SCHEMA).selectExpr("embedding", "'a' AS x", "1 AS n", "vec_id", "0 AS dim", "'b' AS component").repartition(5)
    check(whitening.whiten(df).collect(), rows, min(dim, 32))


def test_rank_ties_and_repeats(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-40, 40, size=(6, 20)) / 64
    rows = [(i % 70, base[i % 6].tolist()) for i in range(120)] + [(None, base[0].tolist())]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1, 2, 3, 4, 5} and len(got) == 5 * 121
    assert got[0]["identity_error"] < 1e-9
    assert sum(r["vec_id"] is None for r in got) == 5
    # two equally frequent lengths: the longer one is fitted
    two = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [1.0]), (4, [2.0])]
    assert {r["vec_id"] for r in whitening.whiten(spark.createDataFrame(two, SCHEMA)).collect()} == {1, 2}


def test_no_variance_and_empty(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)]):
        out = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert out.collect() == [] and out.columns == [c.split(" ")[0] for c in whitening.WHITENED.split(", ")]


def test_large_entries(spark):
    """Sums and deviations stay exact; a deviation beyond a long is null, entries that are no long drop the row."""
    rows = [(1, [3e15, 0.0]), (2, [-3e15, 1.0]), (3, [1e30, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"] for r in got} == {1, 2} and {r["deviation"] for r in got} == {None} and {r["n"] for r in got} == {2}


@pytest.mark.parametrize("kind", ["flat", "decay", "repeated", "low rank", "zero"])
def test_eigenpairs(kind):
    rng = np.random.default_rng(5)
    d, k = 150, 32
    a = rng.normal(size=(2000, d))
    if kind == "decay":
        a *= np.arange(1, d + 1) ** -1.0
    m = a.T @ a / 2000
    if kind == "repeated":
        u, _ = np.linalg.qr(rng.normal(size=(d, d)))
        m = (u * np.r_[np.full(20, 3.0), np.full(30, 2.0), np.full(100, 1.0)]) @ u.T
    if kind == "low rank":
        m = a[:6].T @ a[:6]
    if kind == "zero":
        m = np.zeros((d, d))
    e, u = whitening.leading_eigenpairs(lambda w: m @ w, d, k)
    want = np.linalg.eigvalsh(m)[::-1][:k]
    top = max(want[0], 1e-300)
    assert np.abs(e - want).max() < 1e-13 * top + 1e-300
    assert np.abs(u.T @ u - np.eye(k)).max() < 1e-13
    assert np.linalg.norm(m @ u - u * e, axis=0).max() <= 1e-12 * top


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 40))
    m = a @ a.T
    q, _ = np.linalg.qr(rng.normal(size=(40, 4)))
    b, theta = rng.normal(size=(40, 3)), np.array([1.0, 5.0, 9.0])
    p = np.eye(40) - q @ q.T
    t = whitening.minres_block(lambda w: m @ w, theta, q, b, steps=400, tolerance=1e-12)
    for j in range(3):
        assert np.linalg.norm(p @ (m - theta[j] * np.eye(40)) @ p @ t[:, j] - p @ b[:, j]) < 1e-6 * np.linalg.norm(b[:, j])
