"""Whitening: polynomials, roots and components against plain computations; odd rows."""

from fractions import Fraction

import numpy as np
import pytest

from cohortia.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v array<float>, deviation string, whitened double"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, 2, [1.0], "x", 0.5) for i, v in rows], SCHEMA).repartition(parts)


def plain_polynomial(matrix):
    """Faddeev and LeVerrier, in fractions; constant first."""
    d = len(matrix)
    a = np.array([[Fraction(v) for v in row] for row in matrix], object)
    found, m = [Fraction(1)], np.array([[Fraction(0)] * d for _ in range(d)], object)
    eye = np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
    for k in range(1, d + 1):
        m = a.dot(m) + found[-1] * eye
        found.append(-sum(a.dot(m)[i][i] for i in range(d)) / k)
    return [int(c) for c in reversed(found)]


@pytest.mark.parametrize("kind", ["random", "zero columns", "diagonal", "one", "rank one"])
def test_polynomial(spark, kind):
    dice = np.random.default_rng(2)
    x = dice.integers(-300, 300, (30, 7)).astype(object)
    if kind == "zero columns":
        x[:, [0, 1, 4]] = 0
    elif kind == "diagonal":
        x = np.diag([3, 0, 5, 5, 7, 1, 2]).astype(object)
    elif kind == "one":
        x = x[:, :1]
    elif kind == "rank one":
        x = x[:1]
    matrix = x.T.dot(x).tolist()
    assert W.characteristic_polynomial(spark, matrix) == plain_polynomial(matrix)


def test_roots_with_multiplicity():
    c = [1]
    for root in (0, 0, 5, 5, 9, 1000, 1001):
        c = [(c[k - 1] if k else 0) - root * (c[k] if k < len(c) else 0) for k in range(len(c) + 1)]
    found = W.largest_roots(c, 9)
    assert [r / (1 << s) for r, s in found] == [1001, 1000, 9, 5, 5]
    assert len(W.largest_roots(c, 2)) == 2
    close = [2 * 10**18 + 1, -3 * 10**9, 1]  # (z - 10^9)(z - 2 10^9) + 1
    a, b = ((r, s) for r, s in W.largest_roots(close, 2))
    for root, shift in (a, b):
        z = Fraction(root, 1 << shift)
        assert abs(z * z - 3 * 10**9 * z + 2 * 10**18 + 1) < Fraction(1, 10**9)


def check(rows, found, model, most=8):
    fine = [v for _, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    sizes = sorted({(sum(len(u) == len(v) for u in fine), len(v)) for v in fine})
    d = sizes[-1][1]
    x = np.floor(1024 * np.array([v for v in fine if len(v) == d], np.float32).astype(float)) + 100_000
    values = np.linalg.eigvalsh(np.atleast_2d(np.cov(x.T, bias=True)))[::-1]
    kept = int((values[:most] > 1e-6 * values[0]).sum())
    assert model.n == len(x) and len(model.axes) == kept
    assert np.allclose(model.eigenvalues, values[:kept], rtol=1e-9)
    assert np.allclose(model.axes @ model.axes.T, np.eye(kept), atol=1e-12)
    own = [tuple(int(c) for c in row) for row in x]
    total = [sum(r[k] for r in own) for k in range(d)]
    expected = sorted(sum((len(own) * c - s) ** 2 for c, s in zip(r, total, strict=True)) for r in own)
    assert sorted(int(r.deviation) for r in found) == expected
    if kept:
        w = np.array([r.whitened for r in found])
        assert np.allclose(np.cov(w.T, bias=True), np.eye(kept), atol=1e-9)


def test_odd_rows(spark):
    dice = np.random.default_rng(5)
    rows = [(k, dice.normal(0, 0.3, 12).astype(np.float32).tolist()) for k in range(300)]
    rows += [(1, rows[0][1]), (None, rows[3][1]), (400, None), (401, []), (402, [0.1] * 11 + [None]), (403, [0.1] * 11 + [float("nan")]), (404, [float("inf")] * 12), (405, [0.5] * 3), (406, [0.0] * 12)]
    docs = table(spark, rows)
    model = W.learn_whitening(docs)
    out = W.whiten(docs, model)
    assert out.columns == ["vec_id", "deviation", "whitened"]
    found = out.collect()
    assert len(found) == 303 and {r.vec_id for r in found}.isdisjoint(range(400, 406))
    check(rows, found, model)
    assert W.identity_error(out, 8) < 1e-9


def test_equal_eigenvalues_and_few_rows(spark):
    cube = [(k, [float(k >> b & 1) for b in range(4)]) for k in range(16)]
    model = W.learn_whitening(table(spark, cube))
    found = W.whiten(table(spark, cube), model).collect()
    check(cube, found, model)
    few = [(k, [float(k), 2.0 * k, 0.5, -1.0 * k]) for k in range(3)]
    model = W.learn_whitening(table(spark, few))
    check(few, W.whiten(table(spark, few), model).collect(), model)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [])]])
def test_nothing_to_fit(spark, rows):
    model = W.learn_whitening(table(spark, rows))
    assert model is None and W.whiten(table(spark, rows), model).collect() == []


def test_no_variance_and_large_entries(spark):
    same = [(k, [0.5, 0.25]) for k in range(5)]
    model = W.learn_whitening(table(spark, same))
    found = W.whiten(table(spark, same), model).collect()
    assert len(found) == 5 and all(r.deviation == "0" and r.whitened == [] for r in found)
    huge = [(0, [3.0e38, 1.0]), (1, [-2.0e15, 2.0]), (2, [1.0e12, -5.0]), (3, [0.0, 0.0])]
    model = W.learn_whitening(table(spark, huge))
    found = W.whiten(table(spark, huge), model).collect()
    x = [[min(max(int(np.floor(1024.0 * float(np.float32(c)))), -(1 << 62)), 1 << 62) for c in v] for _, v in huge]
    total = [sum(r[k] for r in x) for k in range(2)]
    assert sorted(int(r.deviation) for r in found) == sorted(sum((4 * c - s) ** 2 for c, s in zip(r, total, strict=True)) for r in x)
