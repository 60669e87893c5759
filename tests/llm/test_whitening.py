"""Whitened embeddings against numpy's own eigenvectors of the whole covariance."""

import math

import numpy as np
import pytest

from tidejoin.llm import whitening as W


def plain(vectors, k=16):
    """n, S, eigenvalues, eigenvectors and trace of the different vectors."""
    x = np.array(sorted({tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors}), dtype=object)
    n, s = len(x), x.sum(0)
    c = ((n * x - s).astype(float)) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    return n, s, e[::-1][:k], q[:, ::-1][:, :k], np.trace(v)


def check(spark, ids, vectors, k=16):
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<float>").repartition(3)
    got = W.whitened(df, k=k).collect()
    vectors = [np.float32(v).tolist() for v in vectors]
    n, s, e, q, trace = plain(vectors, k)
    assert len(got) == len(ids) * len(e) and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    want = {}
    for i, v in zip(ids, vectors, strict=True):
        x = np.array([math.floor(64 * c) + 1_000_000 for c in v], dtype=object)
        want.setdefault(i, []).append((sum((n * x - s) ** 2), ((n * x - s).astype(float) / n) @ q / np.sqrt(e)))
    sign = {}
    for r in got:
        dev, y = want[r.vec_id][0]
        assert r.deviation == dev
        assert abs(r.explained - e[r.component - 1] / trace) <= 1e-9
        v = y[r.component - 1]
        if abs(v) > 1e-3:
            assert sign.setdefault(r.component, np.sign(v * r.whitened)) == np.sign(v * r.whitened)
        assert abs(abs(v) - abs(r.whitened)) < 1e-6
    return got


def test_filtered_block(spark):
    """More dimensions than the block has columns, and a flat spectrum."""
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 60)) * np.linspace(1.3, 0.7, 60)
    check(spark, range(300), v.tolist())


def test_whole_space_and_repeats(spark):
    rng = np.random.default_rng(2)
    v = (rng.standard_normal((40, 7)) * [9, 5, 3, 2, 1, 0.5, 0.2]).tolist()
    check(spark, [*range(40), *range(100, 190)], v + [v[0]] * 90)


def test_rounds_of_a_wide_space(spark):
    rng = np.random.default_rng(3)
    x = np.floor(64 * rng.standard_normal((500, 90)) * np.r_[8, 7.9, 6, np.ones(87)]).astype(np.int64) + 1_000_000
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, x array<long>")
    fit = W.fit_list(rows)
    assert fit.moments.sums == tuple(x.sum(0).tolist()) and fit.moments.n == 500
    found = W.leading(fit, k=3, spare=5, degree=6)
    c = x - x.mean(0)
    e = np.linalg.eigvalsh(c.T @ c / 500)[::-1]
    assert found.rounds > 1 and np.allclose(found.values, e[:3], rtol=1e-12) and math.isclose(found.trace, e.sum(), rel_tol=1e-12)


def test_edges(spark):
    schema = "vec_id long, embedding array<double>, component string, n string"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "c", "n"), (1, [1.0, 2.0], "c", "n"), (2, None, "c", "n"), (3, [1.0, None], "c", "n"), (4, [nan, 1.0], "c", "n"), (5, [inf, 1.0], "c", "n"), (6, [-inf, 1.0], "c", "n"), (7, [], "c", "n"), (8, [1.0, 2.0, 3.0], "c", "n"), (None, [3.0, -0.001], "c", "n")]
    got = W.whitened(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == [(0, 1, 2), (1, 1, 2), (1, 1, 2)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12 for r in got)
    x, y = (64 + 1_000_000, 128 + 1_000_000), (192 + 1_000_000, -1 + 1_000_000)
    assert {r.deviation for r in got} == {(x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2}
    assert W.whitened(spark.createDataFrame([], schema)).count() == 0
    assert W.whitened(spark.createDataFrame(rows[:2], schema)).count() == 0  # one vector has no variance
    assert W.whitened(spark.createDataFrame(rows[2:3], schema)).count() == 0


def test_deviation_beyond_a_long():
    x = np.array([[3, 2**40], [1, 1]])
    assert W.deviations(x, 2**20, (4, 2**40 + 1)).to_pylist()[0] is None
    assert W.deviations(x, 2, (4, 2**40 + 1)).to_pylist() == [None, None]
    assert W.deviations(np.array([[5, 7]]), 2, (4, 9)).to_pylist() == [61]


@pytest.mark.parametrize("spare", [3, 9])
def test_missed_directions_are_noticed(spark, spare):
    """A block that starts without the leading direction isn't taken for right."""
    x = np.diag(np.arange(2, 32) * 10)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, x array<long>")
    found = W.leading(W.fit_list(rows), k=2, spare=spare, degree=8, tolerance=1e-11)
    c = x - x.mean(0)
    assert np.allclose(found.values, np.linalg.eigvalsh(c.T @ c / 30)[::-1][:2], rtol=1e-9)
