"""Whitening against numpy's eigenvectors of the whole covariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from airgrid.llm.whitening import fit, whiten, whole_vectors


def frame(spark, vectors, kind="double"):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"x": F.lit(1), "n": F.lit("n"), "k": F.lit(2), "component": F.lit(0)}).repartition(3)


def brute(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    some = e > 1e-9 * e[0]
    return c @ q[:, some] / np.sqrt(e[some]), e[some] / np.trace(c.T @ c / n), ((n * x - s) ** 2).sum(1)


@pytest.mark.parametrize("d,n", [(12, 300), (5, 40), (20, 9)])
def test_against_eigenvectors(spark, d, n):
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((n, d)) * 2.0 ** -np.arange(d) + rng.standard_normal(d)).astype(np.float32).tolist()
    z, share, deviation = brute(vectors)
    got = whiten(frame(spark, vectors, "float")).collect()
    k = z.shape[1]
    assert len(got) == n * k
    w = np.zeros((n, k))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[r.vec_id] and abs(r.explained / share[r.component - 1] - 1) < 1e-8 and r.identity_error < 1e-8
    assert np.abs(w * np.sign((w * z).sum(0)) - z).max() < 1e-6


def test_equal_variances_are_all_found(spark):
    vectors = [[s * (i == j) for i in range(6)] for j in range(4) for s in (1, -1)]
    got = whiten(frame(spark, vectors)).collect()
    assert sorted({r.component for r in got}) == [1, 2, 3, 4] and all(abs(r.explained - 0.25) < 1e-12 and r.identity_error < 1e-10 for r in got)
    w = np.zeros((8, 4))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    assert np.allclose(w.T @ w / 8, np.eye(4))


def test_left_and_right_vectors_stay_orthogonal(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((80, 30)) * 10.0 ** -(np.arange(30) / 12)).tolist()
    table = whole_vectors(frame(spark, vectors))
    whole, _ = fit(table, components=30)
    z, share, _ = brute(vectors, 30)
    assert np.abs(whole.components @ whole.components.T - np.eye(30)).max() < 1e-12
    assert np.allclose(whole.variances / whole.trace, share, rtol=1e-9)
    few, _ = fit(table, components=3, steps=20)
    assert np.allclose(few.variances, whole.variances[:3], rtol=1e-6)


def test_odd_rows(spark):
    bad = [None, [], [1], [None, 1], [float("nan"), 1], [float("inf"), 0], [1e300, 0]]
    got = whiten(frame(spark, [*bad, [0, 1], [1, 0], [1, 0]])).collect()
    assert sorted(r.vec_id for r in got) == [7, 8, 9] and all(r.n == 3 for r in got)
    ids = frame(spark, [[0, 1], [1, 0], [1, 0]]).withColumn("vec_id", F.lit(None).cast("long"))
    assert len(whiten(ids).collect()) == 3 and whiten(ids).filter("vec_id is null").count() == 3
    for none in ([], bad, [[1, 2]], [[1, 2]] * 4):
        assert whiten(frame(spark, none)).count() == 0


def test_deviations_beyond_64_bits_are_null(spark):
    got = {r.vec_id: r for r in whiten(frame(spark, [[1e12, 0], [3, 1e11], [-5e11, 2]])).filter("component = 1").collect()}
    assert all(r.deviation is None and abs(r.whitened) < 2 for r in got.values())
    near = whiten(frame(spark, [[1e6, 0], [0, 0]])).collect()
    assert {r.deviation for r in near} == {(1024 * 10**6) ** 2}
