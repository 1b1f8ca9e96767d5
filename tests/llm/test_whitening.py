"""Whitening against a dense eigensolver, and the solver on hard matrices."""

import math

import numpy as np
import pytest

from stayline.llm.whitening import bidiagonal, principal_directions, qd_values, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component int, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, "x") for i, v in rows], SCHEMA)


def by_numpy(rows, components):
    data = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x = np.floor(64 * data).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    white = centred @ directions[:, :components] / np.sqrt(values[:components])
    return n, [int(d) for d in ((n * x - sums) ** 2).sum(axis=1)], white, values / values.sum()


@pytest.mark.parametrize("width,components", [(24, 8), (5, 32)])
def test_whitened_rows_are_those_of_a_dense_solver(spark, width, components):
    draw = np.random.default_rng(width)
    data = draw.standard_normal((300, width)) * np.linspace(3, 1, width) + 7
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(data)]
    bad = [(1000, None), (1001, [math.nan] * width), (1002, [math.inf] + [0.0] * (width - 1)),
           (1003, [None] + [1.0] * (width - 1)), (1004, []), (1005, [1.0])]
    found = whiten(vectors(spark, rows + bad).repartition(40), "vec_id", "embedding", components).collect()
    n, deviations, white, shares = by_numpy(rows, components)
    kept = min(width, components)
    got = np.full((len(rows), kept), np.nan)
    for row in found:
        got[row["vec_id"], row["component"] - 1] = row["whitened"]
        assert row["n"] == n and row["deviation"] == deviations[row["vec_id"]]
        assert row["explained"] == pytest.approx(shares[row["component"] - 1], rel=1e-10)
        assert row["identity_error"] < 1e-10
    assert len(found) == len(rows) * kept
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-8


def test_directions_without_variance_are_left_out(spark):
    draw = np.random.default_rng(0)
    rows = [(i % 7 if i % 7 else None, [float(v), float(v), 1.0]) for i, v in enumerate(draw.integers(-9, 9, 50))]
    found = whiten(vectors(spark, rows), "vec_id", "embedding").collect()
    assert len(found) == 50 and {r["component"] for r in found} == {1} and found[0]["explained"] == pytest.approx(1)
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5):
        empty = whiten(vectors(spark, rows), "vec_id", "embedding")
        assert empty.count() == 0
        assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def hard_matrices():
    draw = np.random.default_rng(5)
    rotation = np.linalg.qr(draw.standard_normal((40, 40)))[0]
    diagonal = np.abs(np.arange(-10, 11)) + 2.0
    wilkinson = np.linalg.cholesky(np.diag(diagonal) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)).T
    deficient = draw.standard_normal((500, 40))
    deficient[:, 10:] = deficient[:, :30]
    return {
        "random": np.triu(draw.standard_normal((30, 30))),
        "one": np.array([[3.0]]),
        "zero": np.zeros((4, 4)),
        "identity": np.eye(12),
        "two values": np.linalg.qr(np.diag(np.repeat([1.0, 2.0], 20)) @ rotation, mode="r"),
        "graded": np.linalg.qr(np.diag(10.0 ** -np.arange(40)) @ rotation, mode="r"),
        "close pairs": wilkinson,
        "glued": np.kron(np.eye(3), wilkinson) + np.diag(np.full(62, 1e-9), 1),
        "dependent": np.linalg.qr(deficient, mode="r"),
        "few rows": np.vstack([np.linalg.qr(draw.standard_normal((3, 20)), mode="r"), np.zeros((17, 20))]),
    }


@pytest.mark.parametrize("name", list(hard_matrices()))
def test_solver_is_exact_and_orthonormal(name):
    r = hard_matrices()[name]
    values, directions = principal_directions(r)
    true = np.linalg.svd(r, compute_uv=False) ** 2
    size = max(true[0], 1e-300)
    assert np.abs(values - true).max() <= 1e-13 * size
    assert np.abs(directions.T @ directions - np.eye(len(r))).max() < 1e-11
    assert np.abs(r.T @ (r @ directions) - directions * values).max() <= 1e-12 * size


def test_small_singular_values_keep_their_digits():
    diagonal, above = 10.0 ** -np.arange(0, 16, 0.5), 0.3 * 10.0 ** -np.arange(0, 15.5, 0.5)
    values = qd_values(diagonal, above)
    # the product of the values is that of the diagonal, which no cancellation touches
    assert math.fsum(np.log(values)) == pytest.approx(2 * math.fsum(np.log(diagonal)), abs=1e-9)


def test_bidiagonal_form_keeps_the_products():
    r = np.triu(np.random.default_rng(1).standard_normal((9, 9)))
    diagonal, above, right = bidiagonal(r)
    b = np.diag(diagonal) + np.diag(above, 1)
    assert np.allclose(right @ b.T @ b @ right.T, r.T @ r)
