"""Elimination by Newton steps and triangles of rows, against fresh fits and dense algebra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.operators import evaluate, models, newton, prep, triangles
from tests.conftest import one


def frame(spark, x, *labels):
    names = [f"v{i}" for i in range(x.shape[1])]
    schema = ", ".join(f"{n} double" for n in [*names, *(f"y{i}" for i in range(len(labels)))])
    data = [(*map(float, r), *(float(v) for v in ys)) for r, *ys in zip(x, *labels)]
    return spark.createDataFrame(data, schema).repartition(5), names


@pytest.fixture(scope="module")
def flags(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((600, 6)) * [1, 20, 1, 0.01, 3, 1] + [0, 1000, 0, 0, -5, 2]
    x[:, 5] = x[:, 0] + 0.5 * x[:, 5]
    y = (rng.random(600) < 1 / (1 + np.exp(0.4 - x[:, 0] + 0.05 * (x[:, 1] - 1000)))).astype(int)
    df, names = frame(spark, x, y)
    return df.cache(), names


def stepwise(df, names, label, family, level):
    """Fresh fits: the remaining names, what went, and the last fit."""
    left, gone = list(names), []
    while True:
        result = models.fit(df, left, label, family)
        worst = max(left, key=lambda n: result.p_values[n])
        if result.p_values[worst] <= level or len(left) == 1:
            return result, gone
        gone.append((worst, result.p_values[worst]))
        left.remove(worst)


@pytest.mark.parametrize("level", [0.15, 1e-6, 1.0])
def test_logistic_elimination_equals_fresh_fits(flags, level):
    df, names = flags
    result = models.backward(df, names, "y0", "binomial", level)
    fresh, gone = stepwise(df, names, "y0", "binomial", level)
    assert result.features == fresh.features
    assert [n for n, _ in result.dropped] == [n for n, _ in gone]
    assert [p for _, p in result.dropped] == pytest.approx([p for _, p in gone], abs=1e-6)
    assert result.coefficients == pytest.approx(fresh.coefficients, rel=1e-5)
    assert result.intercept == pytest.approx(fresh.intercept, rel=1e-5)
    assert result.term_p_values == pytest.approx(fresh.term_p_values, abs=1e-6)


def test_each_dropped_term_takes_few_passes(flags):
    df, names = flags
    full = models.backward(df, names, "y0", "binomial", 1.0)
    result = models.backward(df, names, "y0", "binomial", 1e-6)
    assert full.passes <= 9 and len(result.dropped) >= 3
    assert result.passes - full.passes <= 4 * len(result.dropped)


def test_dependent_terms_are_set_aside_and_the_design_is_read_by_columns(spark, flags):
    df, names = flags
    wide = df.withColumn("copy", F.col("v0") * 2 - F.col("v4")).withColumn("const", F.lit(7.0))
    result = models.backward(wide, [*names, "copy", "const"], "y0", "binomial", 0.15)
    assert result.aliased == ["copy", "const"]
    design = newton.Design(wide, [*names, "copy", "const"], "y0")
    plan = design.frame.select("x0", "y")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<x0:double,y:double>" in plan


def test_separable_labels_end(spark):
    x = np.arange(40.0).reshape(-1, 1)
    df, names = frame(spark, x, x[:, 0] > 20)
    result = models.backward(df, names, "y0", "binomial", 0.15)
    assert result.passes <= newton.MAX_PASSES + 1
    scored = models.score(result, df)
    assert scored.filter((F.col("prediction") > 0.5) != (F.col("y0") == 1)).count() == 0


def test_labels_of_one_class_end(spark):
    df, names = frame(spark, np.random.default_rng(1).standard_normal((30, 2)), np.ones(30))
    result = models.backward(df, names, "y0", "binomial", 0.15)
    assert len(result.features) == 1 and math.isfinite(result.coefficients[0])


def test_no_rows_are_an_error(flags):
    df, names = flags
    with pytest.raises(ValueError):
        models.backward(df.where("false"), names, "y0", "binomial", 0.15)


def test_linear_elimination_is_one_pass_and_equals_fresh_fits(spark, flags):
    df, names = flags
    df = df.withColumn("y", F.col("v0") * 3 + F.col("v1") * 0.01 + F.hash("v4") / 2**31)
    result = models.backward(df, names, "y", "gaussian", 0.05)
    fresh, gone = stepwise(df, names, "y", "gaussian", 0.05)
    assert result.passes == 1 and result.features == fresh.features
    assert [n for n, _ in result.dropped] == [n for n, _ in gone]
    assert result.coefficients == pytest.approx(fresh.coefficients, rel=1e-8)
    assert result.intercept == pytest.approx(fresh.intercept, rel=1e-8)
    assert result.term_p_values == pytest.approx(fresh.term_p_values, abs=1e-6)
    rmse = [one(evaluate.rmse(models.score(f, df), "y"))["rmse"] for f in (result, fresh)]
    assert rmse[0] == pytest.approx(rmse[1])


def test_as_many_terms_as_rows_drop_nothing(spark):
    df, names = frame(spark, np.random.default_rng(2).standard_normal((4, 3)), np.arange(4))
    result = models.backward(df, names, "y0", "gaussian", 0.05)
    assert result.features == names and not result.dropped
    assert all(math.isnan(p) for p in result.term_p_values)
    assert math.isnan(models.two_sided(1.0, 0.0))


def test_triangle_of_many_blocks_is_that_of_all_rows(spark):
    x = np.random.default_rng(3).standard_normal((500, 4)) * [1, 1e6, 1e-6, 1] + [0, 1e9, 0, 3]
    df, names = frame(spark, x)
    full = np.column_stack([np.ones(500), x])
    for parts in (1, 40):
        r = triangles.column_triangle(df.repartition(parts), names)
        assert np.allclose(np.tril(r, -1), 0)
        assert np.allclose(np.abs(r), np.abs(np.linalg.qr(full, mode="r")), rtol=1e-8, atol=1e-12)
    weight = F.exp("v0")
    r = triangles.column_triangle(df, names, weight)
    weighted = full * np.exp(x[:, :1] / 2)
    assert np.allclose(r.T @ r, weighted.T @ weighted, rtol=1e-8)
    assert not triangles.column_triangle(df.where("false"), names).any()


def test_columns_that_are_nearly_dependent_are_told_from_those_that_are(spark):
    """Powers on 0..1, as in Hilbert's matrix: cross products lose them, triangles do not."""
    t = np.linspace(0, 1, 400)
    x = np.column_stack([t**k for k in range(1, 10)])
    x = np.column_stack([x, x @ np.arange(1.0, 10.0)])
    df, names = frame(spark, x)
    assert prep.aliased(prep.gram(df, names), names) != names[-1:]
    assert triangles.dependent_columns(triangles.column_triangle(df, names), names) == names[-1:]


def test_inflation_keeps_its_digits_where_columns_are_alike(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((800, 1))
    x = base + 1e-6 * rng.standard_normal((800, 3)) + 1e3
    df, names = frame(spark, x)
    got = triangles.inflation_factors(triangles.column_triangle(df, names))
    centred = x - x.mean(axis=0)
    inverse = np.linalg.pinv(centred, rcond=1e-15)
    true = (centred**2).sum(axis=0) * (inverse**2).sum(axis=1)
    assert got == pytest.approx(true, rel=1e-4)
    assert got.min() > 1e10
