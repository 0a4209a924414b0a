"""Whitening against the eigenvectors of the whole covariance, in one array."""

import numpy as np
import pytest

from shelfmark.llm.whitening import embedding_whitening, fit_whitening

SCHEMA = "component int, vec_id long, embedding array<float>, n long"


def frame_of(spark, vectors, parts=3):
    return spark.createDataFrame([(7, i, None if v is None else [None if c is None else float(c) for c in v], 7) for i, v in enumerate(vectors)], SCHEMA).repartition(parts)


def plain(vectors):
    """(x, eigenvalues, eigenvectors) by falling eigenvalue."""
    x = np.floor(1024 * np.asarray(vectors, np.float32).astype(np.float64)) + 100000
    far = x - x.mean(axis=0)
    e, w = np.linalg.eigh(far.T @ far / len(x))
    return x.astype(np.int64), e[::-1], w[:, ::-1]


def agree(spark, vectors, count, tolerance=1e-8):
    x, e, w = plain(vectors)
    n, sums = len(x), x.sum(axis=0)
    rows = embedding_whitening(frame_of(spark, vectors)).collect()
    assert len(rows) == n * count
    found = np.zeros((n, count))
    for r in rows:
        found[r.vec_id, r.component - 1] = r.whitened
        far = sum(int(v) ** 2 for v in n * x[r.vec_id] - sums)
        assert r.n == n and r.deviation == (far if far < 1 << 63 else None)
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9) and r.identity_error < 1e-9
    expected = (x - sums / n) @ w[:, :count] / np.sqrt(e[:count])
    assert np.abs(np.abs(found) - np.abs(expected)).max() < tolerance
    sign = np.sign((found * expected).sum(axis=0))
    assert np.abs(found - sign * expected).max() < tolerance


def test_whitening_of_odd_and_plain_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 12)) * np.arange(1, 13) @ rng.normal(size=(12, 12))
    agree(spark, base, 8)
    agree(spark, np.repeat(base[:40], 3, axis=0), 8)
    flat = base.copy()
    flat[:, 3] = 0.5
    agree(spark, flat, 8)


def test_ill_conditioned_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(500, 16)) * np.geomspace(1e5, 1e-1, 16)
    turn, _ = np.linalg.qr(rng.normal(size=(16, 16)))
    agree(spark, base @ turn, 8, 1e-6)


def test_fewer_dimensions_than_entries(spark):
    rng = np.random.default_rng(6)
    whole = rng.integers(-50, 50, size=(300, 3)) @ rng.integers(-3, 4, size=(3, 10))
    agree(spark, whole, 3, 1e-6)
    agree(spark, rng.normal(size=(5, 20)), 4, 1e-6)


def test_vectors_that_do_not_count(spark):
    rng = np.random.default_rng(7)
    good = rng.normal(size=(50, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0, 0], [float("inf"), 1, 1], [1.0, 2.0], [3e9, 0, 0]]
    rows = embedding_whitening(frame_of(spark, good + bad)).collect()
    assert {r.vec_id for r in rows} == set(range(50)) and {r.n for r in rows} == {50} and {r.component for r in rows} == {1, 2, 3}
    for few in ([], [good[0]], [good[0], good[0]], [None, []]):
        out = embedding_whitening(frame_of(spark, few))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(8)
    agree(spark, (rng.normal(size=(60, 3)) * 2000).tolist(), 3)
    rows = embedding_whitening(frame_of(spark, (rng.normal(size=(400, 3)) * 2**28).tolist())).collect()
    assert len(rows) == 1200 and any(r.deviation is None for r in rows) and max(r.identity_error for r in rows) < 1e-9


def test_passes_are_few(spark):
    rng = np.random.default_rng(9)
    model, _ = fit_whitening(frame_of(spark, rng.normal(size=(2000, 8))))
    assert model.passes <= 3
