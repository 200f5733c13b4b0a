"""Whitening against numpy's own decompositions."""

import math

import numpy as np
import pytest

from keyspan.llm.whitening import bidiagonalise, right_vectors, singular_squares, solve, triangle, whiten, whole_numbers

COLUMNS = "vec_id long, embedding array<float>, label int, n int, `a.b` int, whitened string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], COLUMNS)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
@pytest.mark.parametrize("kind", ["random", "graded", "equal", "zeros", "diagonal"])
def test_small_problem(n, kind):
    draw = np.random.default_rng(n)
    r = np.triu(draw.normal(size=(n, n)))
    if kind == "graded":
        r = np.triu(draw.normal(size=(n, n))) * 10.0 ** -np.linspace(0, 7, n)[:, None]
    elif kind == "equal":
        r = np.linalg.qr(draw.normal(size=(n, n)))[0] * 3.0
    elif kind == "zeros":
        r[:, n // 2 :] = 0
    elif kind == "diagonal":
        r = np.diag(np.arange(n, 0, -1.0))
    diagonal, upper, _ = bidiagonalise(r)
    matrix = np.diag(diagonal) + np.diag(upper, 1)
    want = np.linalg.svd(r, compute_uv=False)
    assert np.allclose(np.linalg.svd(matrix, compute_uv=False), want, rtol=1e-13, atol=1e-13 * want[0])
    squares = singular_squares(diagonal, upper)
    assert np.allclose(np.sqrt(squares), want, rtol=1e-12, atol=1e-14 * max(want[0], 1e-300))
    vectors = right_vectors(diagonal, upper, squares, 8)
    assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-10)
    found = matrix @ vectors
    assert np.allclose(np.linalg.norm(found, axis=0), want[: vectors.shape[1]], atol=1e-11 * max(want[0], 1e-300))
    if kind in ("random", "graded"):
        components = solve(r, 10, np.zeros(n), 8).components
        best = np.linalg.svd(r)[2].T[:, : components.shape[1]]
        assert np.allclose(np.abs((components * best).sum(axis=0)), 1, atol=1e-12)


def test_small_singular_values_keep_their_digits():
    # Products of the entries are exact here, so the least value is known far below the largest.
    diagonal, upper = np.array([1.0, 1e-8, 1e-3]), np.array([1e-4, 1e-12])
    least = math.sqrt(singular_squares(diagonal, upper)[-1])
    product = np.prod(np.sqrt(singular_squares(diagonal, upper)))
    assert abs(product / np.prod(diagonal) - 1) < 1e-13 and abs(least / 1e-8 - 1) < 1e-7


def brute(vectors, most=8):
    x = whole_numbers(np.array(vectors, np.float32))
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, centred, values[::-1][:most], components[:, ::-1][:, :most], values.sum()


def test_rows_of_a_table(spark):
    draw = np.random.default_rng(2)
    vectors = (draw.normal(size=(500, 24)) * np.linspace(2, 0.1, 24)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    odd = [(900, None), (901, []), (902, [float("nan")] * 24), (903, [float("inf")] + [0.0] * 23), (904, [None] + [0.0] * 23), (905, [1.0]), (906, [3e38] * 24)]
    repeated = [(0, rows[0][1]), (None, rows[1][1])]
    df = table(spark, rows + odd + repeated).repartition(70)
    x, n, s, centred, values, components, total = brute([v for _, v in rows + repeated])
    out = whiten(df).collect()
    assert len(out) == 8 * n and {r["n"] for r in out} == {n}
    ids = [k for k, _ in rows + repeated]
    dev = ((n * x.astype(object) - s) ** 2).sum(axis=1)
    assert {(r["vec_id"], r["deviation"]) for r in out} == set(zip(ids, dev, strict=True))
    for k in range(8):
        mine = {r["vec_id"]: r["whitened"] for r in out if r["component"] == k + 1 and r["vec_id"] is not None}
        want = centred @ components[:, k] / math.sqrt(values[k])
        found = np.array([mine[i] for i in range(500)])
        assert min(np.abs(found - want[:500]).max(), np.abs(found + want[:500]).max()) < 1e-9
        explained = {r["explained"] for r in out if r["component"] == k + 1}
        assert len(explained) == 1 and abs(explained.pop() / (values[k] / total) - 1) < 1e-10
    errors = {r["identity_error"] for r in out}
    assert len(errors) == 1 and errors.pop() < 1e-10


def test_tree_of_triangles(spark):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(400, 5)).astype(np.float32)
    df = table(spark, [(k, v.tolist()) for k, v in enumerate(vectors)]).repartition(130).selectExpr("embedding as vector")
    _, n, s, centred, *_ = brute(vectors)
    r = triangle(df, n, s)
    assert np.allclose(r.T @ r, centred.T @ centred, rtol=1e-12, atol=1e-6)


def test_degenerate_tables(spark):
    assert whiten(table(spark, [])).collect() == []
    assert whiten(table(spark, [(1, None), (2, [])])).collect() == []
    one = whiten(table(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(k, 1, 0, None, None, None) for k in (1, 2)]
    # Two points on a line: one component.
    two = whiten(table(spark, [(1, [0.0, 0.0, 1.0]), (2, [1.0, 1.0, 1.0])])).collect()
    assert sorted((r["vec_id"], r["component"], None if r["whitened"] is None else round(abs(r["whitened"]), 9)) for r in two) == sorted(
        ((i, k, 1.0 if k == 1 else None) for i in (1, 2) for k in (1, 2, 3)), key=lambda t: t[:2]
    )
    assert {round(r["explained"], 12) for r in two} == {1.0, 0.0} and all(r["identity_error"] < 1e-12 for r in two)
    # Equal variances in all directions.
    square = whiten(table(spark, [(k, [float(k & 1), float(k >> 1)]) for k in range(4)])).collect()
    assert all(r["identity_error"] < 1e-12 and abs(r["explained"] - 0.5) < 1e-12 for r in square)
    # Deviations beyond a long.
    far = whiten(table(spark, [(1, [0.0]), (2, [2.0**38])])).collect()
    assert all(r["deviation"] is None and abs(abs(r["whitened"]) - 1) < 1e-12 for r in far)
