"""Whitening against numpy on the fit list, and its updates against dense eigenproblems."""

import numpy as np
import pytest

from lodestrata.llm import whitening
from lodestrata.llm.whitening import Spectrum


def brute(vectors):
    """From the contract: n, x per row, components by falling eigenvalue, eigenvalues, trace."""
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    centred = (len(fit) * fit - fit.sum(0)) / len(fit)
    values, components = np.linalg.eigh(centred.T @ centred / len(fit))
    return len(fit), x, fit.sum(0), values[::-1], components[:, ::-1]


def test_rank_one_updates():
    rng = np.random.default_rng(0)
    for _ in range(400):
        d = int(rng.integers(1, 12))
        values = np.sort(rng.choice([0, 1.0, 1.0 + 1e-15, 2.5, 1e6, 1e-9], d))
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        x = q[:, 0] * 3.0 if rng.random() < 0.3 else rng.normal(size=d) * rng.choice([1e-8, 1, 1e4])
        factor = rng.choice([1.0, 0.5, 1e-6])
        got, u = whitening.rank_one(values, q, x, factor)
        want = (q * values) @ q.T + factor * np.outer(x, x)
        assert np.abs((u * got) @ u.T - want).max() <= 1e-13 * max(np.abs(want).max(), 1e-300)
        assert np.abs(u.T @ u - np.eye(d)).max() <= 1e-13 and (np.diff(got) >= 0).all()


@pytest.mark.parametrize("d", [1, 2, 9, 40])
def test_secular_roots(d):
    rng = np.random.default_rng(d)
    poles, weights = np.sort(rng.normal(size=d)) * 3, rng.random(d) ** 6 + 1e-9
    near, offset = whitening.secular_roots(poles, weights)
    want = np.linalg.eigvalsh(np.diag(poles) + np.outer(np.sqrt(weights), np.sqrt(weights)))
    assert np.allclose(poles[near] + offset, want, rtol=0, atol=1e-13 * max(1, np.abs(want).max()))


def test_spectra_of_parts_combine():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(300, 12)) * [9, 9, 5, 3, 1, 1, 1, 0, 0, 1, 1, 40]).astype(np.int64) + 1_000_000
    parts = [Spectrum.empty(12) for _ in range(7)]
    for k, row in enumerate(x):
        parts[min(k % 11, 6) if k > 1 else 0].add(row)
    made = whitening._combined([*parts, Spectrum.empty(12)])
    centred = x - x.mean(0)
    assert made.n == 300 and made.total.tolist() == x.sum(0).tolist()
    assert np.allclose((made.vectors * made.values) @ made.vectors.T, centred.T @ centred, rtol=0, atol=1e-9 * (centred ** 2).sum())


def check(rows, vectors, ids, parts=1.0):
    n, x, total, values, components = brute(vectors)
    k = min(16, int((values > 1e-12 * values[0]).sum()))
    assert len(rows) == k * len(ids)
    by = {}
    for r in rows:
        by.setdefault(r.component, []).append(r)
    at = {i: p for p, i in enumerate(ids)}
    for c in range(1, k + 1):
        got = sorted(by[c], key=lambda r: at[r.vec_id])
        want = (n * x - total) / n @ components[:, c - 1] / np.sqrt(values[c - 1])
        made = np.array([r.whitened for r in got])
        made *= np.sign(made @ want)
        assert np.allclose(made, want, rtol=0, atol=1e-8 * max(1, np.abs(want).max()))
        assert [r.deviation for r in got] == [sum(int(v) ** 2 for v in n * row - total) for row in x]
        assert all(abs(r.explained / (values[c - 1] / values.sum()) - 1) < 1e-9 and r.n == n and r.identity_error < 1e-8 for r in got)


def test_whitening_of_the_table(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    vectors = rows.select("vec_id", "embedding").collect()
    made = whitening.whiten(rows.selectExpr("*", "1 AS x", "2 AS n").repartition(20)).collect()
    check(made, [r.embedding for r in vectors], [r.vec_id for r in vectors])


def test_whitening_edges(spark):
    rng = np.random.default_rng(2)
    good = [(k, rng.normal(size=5).round(3).tolist()) for k in range(60)]
    good += [(100 + k, good[0][1]) for k in range(300)]  # many copies count once
    bad = [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0]), (502, [float("nan")] * 5), (503, [float("inf")] * 5), (504, []), (505, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<double>")
    check(whitening.whiten(df.repartition(11)).collect(), [v for _, v in good], [k for k, _ in good])
    flat = [(k, [float(k), 2.0 * k, 3.0]) for k in range(40)] + [(None, [1.0, 2.0, 3.0])]
    rows = whitening.whiten(spark.createDataFrame(flat, "vec_id bigint, embedding array<float>")).collect()
    assert {r.component for r in rows} == {1} and len(rows) == 41 and all(abs(r.explained - 1) < 1e-12 for r in rows)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 3")).count() == 0  # one vector has no component
    assert whitening.whiten(df.filter("vec_id >= 500 AND vec_id < 505")).count() == 0
