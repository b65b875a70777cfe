"""Whitening against a dense eigensolver; the iteration also on matrices of its own."""

import math

import numpy as np
import pytest

from rillway.llm import embedding_whitening as W

SCHEMA = "vec_id long, embedding array<float>, x string, n string, component string"


def dense(rows):
    """Ids, deviations, eigenvalues and eigenvectors of the contract, in plain Python and numpy."""
    whole = [(i, e) for i, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    width = max((len(e) for _, e in whole), default=0)
    xs = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e] + [1_000_000] * (width - len(e))) for i, e in whole]
    fit = sorted({tuple(x) for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[c - s / n for c, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    away = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), np.array([c - s / n for c, s in zip(x, sums, strict=True)])) for i, x in xs]
    return n, values[::-1], vectors[:, ::-1], away


def check(spark, rows, k=16, **how):
    df = spark.createDataFrame([(i, e, "x", "n", "c") for i, e in rows], SCHEMA)
    vectors = W.integer_vectors(df)
    got = W.whiten(vectors, W.fit(vectors, k=k, **how)).collect()
    n, values, vecs, away = dense(rows)
    there = int((values[:k] > 1e-10 * values[0]).sum())
    assert len(got) == len(away) * there
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9
    sign = {}
    for i, d, z in away:
        for c in range(there):
            want = z @ vecs[:, c] / math.sqrt(values[c])
            mine = by[i, d][c + 1]
            if abs(want) > 1e-3:
                sign.setdefault(c, math.copysign(1, want * mine[0]))
            assert any(abs(m * sign.get(c, 1) - want) < 1e-6 for m in mine)


def rows_of(n, width, seed=1):
    rng = np.random.default_rng(seed)
    e = rng.standard_normal((n, width)) * np.linspace(2, 0.2, width)
    return [(i, [float(c) for c in v]) for i, v in enumerate(e)]


def test_awkward_rows(spark):
    rows = rows_of(300, 24)
    rows += [(300 + i, rows[7][1]) for i in range(200)] + [rows[3], rows[3], (None, rows[4][1])]
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan")] * 24), (903, [float("inf")] * 24), (904, [-float("inf"), 1.0]), (905, [0.5, 0.25]), (906, [])]
    check(spark, rows)


@pytest.mark.parametrize("block", [1, 3, 16])
def test_blocks(spark, block):
    check(spark, rows_of(120, 20), k=5, block=block)


def test_little_variance(spark):
    flat = [(i, [float(i % 5), 1.0, 2.0 * (i % 3), 0.0]) for i in range(40)]
    check(spark, flat)
    for rows in ([], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5]), (2, [0.5])], [(1, [])]):
        vectors = W.integer_vectors(spark.createDataFrame([(i, e, "x", "n", "c") for i, e in rows], SCHEMA))
        assert W.whiten(vectors, W.fit(vectors)).collect() == []


def test_huge_entries(spark):
    rows = [*rows_of(20, 3), (50, [3e38, 0.0, 0.0]), (51, [-3e38, 1.0, 0.0])]
    vectors = W.integer_vectors(spark.createDataFrame([(i, e, "x", "n", "c") for i, e in rows], SCHEMA))
    got = W.whiten(vectors, W.fit(vectors)).collect()
    assert {r.vec_id for r in got} == {i for i, _ in rows} and {r.deviation for r in got if r.vec_id >= 50} == {None}


def test_exact_deviations():
    rng = np.random.default_rng(2)
    for reach in (5, 1 << 30, 1 << 55):
        x = rng.integers(-reach, reach, (50, 7)) + 1_000_000
        sums = [int(s) for s in x.astype(object).sum(axis=0)]
        assert W.deviations(x, 50, sums) == [sum((50 * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]


def lanczos(m, k, **how):
    return W.block_lanczos(lambda q: m @ q, len(m), k, **how)


def test_restarts_and_breakdowns():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    spectra = {
        "spread": np.sort(rng.random(300))[::-1] ** 3,
        "rank 5": np.r_[[9, 8, 7, 6, 5], np.zeros(295)],
        "one eigenvalue 40 times": np.r_[np.full(40, 3.0), np.full(260, 1.0)],
        "zero": np.zeros(300),
    }
    for name, values in spectra.items():
        m = (q * values) @ q.T
        for how in ({"block": 4, "most": 64}, {"block": 16}, {"block": 1, "most": 40}):
            if name.startswith("one") and how["block"] == 1:
                continue
            got, vectors, _ = lanczos(m, 12, **how)
            assert np.allclose(got, values[:12], atol=1e-10), (name, how)
            assert np.abs(m @ vectors - vectors * got).max() < 1e-9
            assert np.abs(vectors.T @ vectors - np.eye(12)).max() < 1e-9
    assert lanczos((q * spectra["rank 5"]) @ q.T, 12)[2] < 6  # a closed space ends it early
