"""Embedding whitening against numpy's eigenvectors."""

import math

import duckdb
import numpy as np
import pytest

from loglattice.llm.embedding_whitening import polar_factor, spectral_split, whitened
from loglattice.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<float>, component string, x int"


def brute(vectors, most=4):
    """(n, deviation, whitened up to sign, explained) per vector id."""
    kept = [(i, v) for i, v in vectors if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    xs = [(i, [math.floor(256 * float(np.float32(e))) for e in v]) for i, v in kept]
    fit = np.array(sorted({tuple(x) for _, x in xs}), np.int64)
    n, sums = len(fit), fit.sum(0)
    d = fit - sums / n
    values, vecs = np.linalg.eigh(d.T @ d / n)
    order = np.argsort(-values)[:most]
    out = {}
    for i, x in xs:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))
        w = ((np.array(x) - sums / n) @ vecs[:, order]) / np.sqrt(values[order])
        out[i] = (n, deviation, w, values[order] / values.sum())
    return out


@pytest.mark.parametrize(
    "values",
    [np.arange(1, 31), np.ones(7), np.repeat([1.0, 5.0], 6), 10.0 ** np.linspace(-10, 3, 40),
     np.r_[np.zeros(9), np.linspace(0.1, 1, 11)], np.array([2.0]), np.array([1.0, 1 + 1e-9]), np.zeros(5)],
)
def test_spectral_split(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.normal(size=(len(values),) * 2))
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    v = spectral_split(a)
    v = v @ spectral_split(v.T @ a @ v)
    assert np.abs(v.T @ v - np.eye(len(values))).max() < 1e-13
    assert np.abs(v.T @ a @ v - np.diag(np.diag(v.T @ a @ v))).max() <= 1e-13 * max(values.max(), 1e-300)


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(20, 20))
    a = a + a.T
    u = polar_factor(a)
    values, vectors = np.linalg.eigh(a)
    assert np.abs(u - vectors @ np.diag(np.sign(values)) @ vectors.T).max() < 1e-12


def test_query_equals_brute_force(spark, folder):
    vectors = duckdb.sql(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet'").fetchall()
    expected = brute(vectors)
    rows = QUERIES["op13_embedding_whitening"](spark, folder).collect()
    assert len(rows) == 4 * len(expected)
    flip = {}
    for r in rows:
        n, deviation, w, explained = expected[r.vec_id]
        k = r.component - 1
        sign = flip.setdefault(k, np.sign(w[k] * r.whitened))
        assert (r.n, r.deviation) == (n, deviation)
        assert r.whitened == pytest.approx(sign * w[k], abs=1e-9)
        assert r.explained == pytest.approx(explained[k], rel=1e-9)
        assert r.identity_error < 1e-9


def test_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(x) for x in rng.normal(size=5).astype(np.float32)]) for i in range(40)]
    same = [(100 + i, good[0][1]) for i in range(30)]
    odd = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [math.nan] * 5), (203, [math.inf, 0.0, 0.0, 0.0, 0.0]), (204, [1.0, 2.0]), (None, good[1][1]), (205, [])]
    df = spark.createDataFrame([(i, v, "own", 1) for i, v in good + same + odd], SCHEMA)
    out = whitened(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = out.collect()
    assert len(rows) == 4 * 71 and {r.n for r in rows} == {40}
    expected = brute(good)
    got = {(r.vec_id, r.component): r for r in rows}
    assert all(got[i, 1].deviation == expected[i][1] for i, _ in good)
    assert abs(got[100, 2].whitened) == pytest.approx(abs(expected[0][2][1]), abs=1e-9)


def test_little_variance(spark):
    assert whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitened(spark.createDataFrame([(1, [], "", 1)], SCHEMA)).count() == 0
    one = whitened(spark.createDataFrame([(1, [0.5, 0.25, 1.0], "", 1), (1, [0.5, 0.25, 1.0], "", 1)], SCHEMA)).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    line = whitened(spark.createDataFrame([(i, [i / 4, i / 2, 0.0], "", 1) for i in range(9)], SCHEMA)).collect()
    assert {r.component: (r.whitened is None, round(r.explained, 9)) for r in line} == {1: (False, 1.0), 2: (True, 0.0), 3: (True, 0.0)}
    assert max(r.identity_error for r in line) < 1e-9


def test_large_entries_stay_exact(spark):
    big = [(i, [float(np.float32(v)) for v in (1e15 + i * 1e14, -3e14 * i, 5.0)]) for i in range(6)]
    rows = whitened(spark.createDataFrame([(i, v, "", 1) for i, v in big], SCHEMA)).collect()
    assert {r.deviation for r in rows} == {None} and max(r.identity_error for r in rows) < 1e-4
