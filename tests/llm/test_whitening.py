import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kredenz.llm.queries import op11_whitening
from kredenz.llm.whitening import fit_whitening, solve, whitened
from tests.llm.fixtures import given

SCHEMA = "vec_id long, embedding array<float>, component string, n string, x string, j int"


def plain(rows, most=4):
    """``{(vec_id, component): (n, deviation, |whitened|, explained)}`` by exact sums and an eigen decomposition."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n = len(fit)
    if n < 2:
        return {}
    sums = [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    real = min(most, int((e > 1e-10 * e[0]).sum()))
    out = []
    for i, x in kept:
        away = [n * a - s for a, s in zip(x, sums)]
        for k in range(real):
            white = float(np.array(away) / n @ v[:, k] / math.sqrt(e[k]))
            out.append((i, k + 1, n, sum(a * a for a in away), white, float(e[k] / e.sum())))
    return out


def same(got, want):
    assert len(got) == len(want)
    for k in {w[1] for w in want}:
        a = sorted((r for r in got if r.component == k), key=lambda r: (str(r.vec_id), abs(r.whitened)))
        b = sorted((w for w in want if w[1] == k), key=lambda w: (str(w[0]), abs(w[4])))
        assert [(r.vec_id, r.n, r.deviation) for r in a] == [(w[0], w[2], w[3]) for w in b]
        sign = np.sign(sum(r.whitened * w[4] for r, w in zip(a, b)))
        assert np.allclose([sign * r.whitened for r in a], [w[4] for w in b], rtol=0, atol=1e-9)
        assert np.allclose([r.explained for r in a], [w[5] for w in b], rtol=1e-10)
        assert all(r.identity_error < 1e-9 for r in a)


def test_triangular_solve():
    dice = np.random.default_rng(1)
    r = np.triu(dice.normal(size=(7, 7))) + 5 * np.eye(7)
    a = dice.normal(size=(30, 7))
    assert np.allclose(solve(a, r) @ r, a)


def test_given_vectors(spark):
    for folder in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = [(r.vec_id, r.embedding) for r in given(spark, folder, "embeddings").collect()]
        same(op11_whitening(spark, folder).collect(), plain(rows))


def test_nulls_copies_constants_and_clashing_names(spark):
    dice = np.random.default_rng(2)
    base = dice.normal(size=(60, 5)).astype(np.float32)
    base[:, 3] = 0.25  # no variance
    base[:, 4] = 2 * base[:, 0]
    vectors = [v.tolist() for v in base] + [base[0].tolist()] * 100
    vectors += [None, [None] * 5, [float("nan")] * 5, [float("inf")] + [0.0] * 4, [-0.0] * 5, [0.0] * 5]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(None, vectors[1]), (3, vectors[3])]
    frame = spark.createDataFrame([(*r, "c", "n", "x", 1) for r in rows], SCHEMA).repartition(7)
    same(whitened(frame).collect(), plain(rows))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.5])] * 3, [(1, [])], [(1, [0.5]), (2, [0.5])]])
def test_tables_without_variance(spark, rows):
    assert whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_lengths_are_fitted_apart_and_few_dimensions(spark):
    dice = np.random.default_rng(3)
    short = [(k, v.tolist()) for k, v in enumerate(dice.normal(size=(20, 2)))]
    longer = [(100 + k, v.tolist()) for k, v in enumerate(dice.normal(size=(30, 6)))]
    got = whitened(spark.createDataFrame(short + longer, "vec_id long, embedding array<double>")).collect()
    same([r for r in got if r.vec_id < 100], plain(short))
    same([r for r in got if r.vec_id >= 100], plain(longer))


def test_huge_entries_have_no_deviation(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])]
    got = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == {1, 2, 3}
    assert all(r.deviation is None for r in got if r.vec_id < 3) and all(math.isfinite(r.whitened) for r in got)


def test_badly_conditioned_vectors(spark):
    """Variances 22 decimal places apart, far beyond what a plain Cholesky factor of the covariance bears."""
    dice = np.random.default_rng(4)
    sizes = np.array([1e11, 1e7, 1e3, 3.0])
    x = np.floor(dice.normal(size=(400, 4)) * sizes)
    fit = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    model = fit_whitening(fit, 4, 4)
    exact = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2 / 400
    assert len(model.variances) == 4 and np.allclose(model.variances, exact, rtol=1e-3)
    white = model.apply(x)
    assert np.abs(white.T @ white / 400 - np.eye(4)).max() < 1e-4
