"""Whitening against a dense eigendecomposition, and the Jacobi-Davidson iteration on matrices of its own."""

import numpy as np
import pytest

from skillgraph.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, x long, whitened string, deviation string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "w", "d") for i, v in rows], SCHEMA)


def dense(x, components):
    """(whitened, shares, deviations, n) of all rows of ``x``, by a dense decomposition."""
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = (n * fit - sums) / n
    v = c.T @ c / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    apart = n * x - sums
    return apart / n @ axes / np.sqrt(values), values / np.trace(v), (apart**2).sum(axis=1), n


def check(spark, rows, components=16):
    got = whitening.whiten(vectors_of(spark, rows), components).toPandas()
    sound = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in sound], dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    white, shares, deviation, n = dense(x, components)
    order = np.lexsort((deviation, [-1 if i is None else i for i, _ in sound]))
    got = got.assign(key=got["vec_id"].fillna(-1)).sort_values(["key", "deviation"], kind="stable")
    assert got["key"].tolist() == [-1 if sound[k][0] is None else sound[k][0] for k in order]
    assert got["deviation"].tolist() == deviation[order].tolist() and (got["n"] == n).all()
    mine = np.array(got["whitened"].tolist())
    sign = np.sign((mine * white[order]).sum(axis=0))
    assert np.abs(mine * sign - white[order]).max() < 1e-8
    assert np.allclose(got["explained"].iloc[0], shares, rtol=1e-12)
    assert (got["identity_error"] < 1e-10).all() and got["identity_error"].nunique() == 1


def test_matches_a_dense_decomposition(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(400, 24)) * np.linspace(3, 0.5, 24)).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(500), x)]
    rows += [(900 + i, v) for i, (_, v) in enumerate(rows[:150])]  # copies count once in the fit
    rows += [(700, None), (701, [None] * 24), (702, [float("nan")] * 24), (703, [float("inf")] + [0.0] * 23), (704, [0.0] * 24), (None, rows[0][1]), (5, rows[3][1])]
    check(spark, rows)


def test_fewer_dimensions_than_components(spark):
    rng = np.random.default_rng(2)
    check(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 5)).astype(np.float32) * 9)], 5)
    got = whitening.whiten(vectors_of(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 5)) * 9)])).first()
    assert len(got["whitened"]) == 5


def test_odd_tables(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, [None, None], [0.0, 0.0], 0.0)] * 2
    two = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0]), (3, [1.0])])).collect()
    assert {r["vec_id"] for r in two} == {1, 2}  # another length
    assert all(abs(abs(r["whitened"][0]) - 1) < 1e-12 and r["whitened"][1:] == [None, None] and abs(r["explained"][0] - 1) < 1e-12 for r in two)
    with pytest.raises(Exception, match="larger than"):
        whitening.whiten(vectors_of(spark, [(1, [1e30]), (2, [1.0])])).collect()
    with pytest.raises(Exception, match="63 bits"):
        whitening.whiten(vectors_of(spark, [(i, [float(1e9 * i)]) for i in range(9)])).collect()


@pytest.mark.parametrize("size", [1, 7, 60, 400])
def test_eigenpairs_of_double_precision(size):
    rng = np.random.default_rng(size)
    q, _ = np.linalg.qr(rng.normal(size=(size, size)))
    values = np.sort(np.concatenate([[900.0, 900.0, 899.9999][: min(3, size)], rng.uniform(0, 100, size=max(0, size - 3))]))[::-1]
    v = (q * values) @ q.T
    calls = []
    theta, x = whitening.leading_eigenpairs(lambda u: calls.append(u.shape[1]) or v @ u, size, 16)
    k = min(16, size)
    assert np.allclose(theta, values[:k], rtol=1e-12) and np.linalg.norm(v @ x - x * theta, axis=0).max() < 1e-11 * values[0]
    assert np.abs(x.T @ x - np.eye(k)).max() < 1e-10
    assert len(calls) < 160
