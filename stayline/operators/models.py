"""Regression with backward elimination, scoring, odds ratios and clustering."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GeneralizedLinearRegression,
    GeneralizedLinearRegressionModel,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.operators.newton import Design, normal_p_value
from stayline.operators.triangles import column_triangle, dependent_columns, inflation_factors

LINKS = {"binomial": "logit", "gaussian": "identity"}
MAX_ITERATIONS = 50


@dataclass(frozen=True)
class Fit:
    """A fitted regression, its predictors in order, and what was left out on the way.

    ``term_p_values`` are those of the features and then the intercept. ``passes`` counts
    the readings of the training rows, where they are ours to count.
    """

    family: str
    features: list[str]
    coefficients: list[float]
    intercept: float
    term_p_values: list[float]
    dropped: list[tuple[str, float]] = field(default_factory=list)
    aliased: list[str] = field(default_factory=list)
    passes: int | None = None
    model: GeneralizedLinearRegressionModel | None = None

    @property
    def p_values(self) -> dict[str, float]:
        return dict(zip(self.features, self.term_p_values))


def assemble_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def fit(train: DataFrame, features: Sequence[str], label: str, family: str) -> Fit:
    """One fit of all features, which must not depend on each other."""
    glm = GeneralizedLinearRegression(
        family=family,
        link=LINKS[family],
        labelCol=label,
        featuresCol="features",
        maxIter=MAX_ITERATIONS,
    )
    data = assemble_features(train, features).select("features", F.col(label).cast("double"))
    model = glm.fit(data)
    return Fit(
        family,
        list(features),
        [float(b) for b in model.coefficients],
        float(model.intercept),
        [float(p) for p in model.summary.pValues],
        model=model,
    )


def backward(
    train: DataFrame, features: Sequence[str], label: str, family: str, level: float
) -> Fit:
    """Drop the predictor with the highest p-value until all are at or below the level.

    Linearly dependent predictors are removed first, since they have no p-value. The
    linear model's steps and its result all follow from one pass for a triangle of the
    columns. The logistic model stores its columns once; each of its steps starts where
    the one before puts the optimum without the dropped term. Only triangles, sums of the
    size of the Hessian and coefficients reach the driver.
    """
    if family == "gaussian":
        r = column_triangle(train, [*features, label])
        dependent = dependent_columns(r[:-1, :-1], features)
        names, dropped = linear_steps(r, features, dependent, level)
        return linear_fit(r, features, names, dropped, dependent)
    design = Design(train, features, label)
    names = list(design.names)
    dropped: list[tuple[str, float]] = []
    found = design.fit(names, design.start(names))
    while len(names) > 1:
        worst = int(np.argmin(found.sizes[1:]))
        p_value = normal_p_value(float(found.sizes[1 + worst]))
        if not p_value > level:
            break
        dropped.append((names.pop(worst), p_value))
        found = design.fit(names, found.without(1 + worst))
    return Fit(family, names, *design.unscaled(names, found), dropped, design.dependent, design.passes)


def _linear(r: np.ndarray, places: Sequence[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients of a constant and some columns, their sizes in standard errors, degrees of freedom."""
    own = np.linalg.qr(r[:, [0, *places, -1]], mode="r")
    k = len(places) + 1
    beta = np.linalg.solve(own[:k, :k], own[:k, -1])
    free = round(float(r[0, 0]) ** 2) - k
    error = np.linalg.norm(own[k:, -1]) / math.sqrt(max(free, 1))
    inverse = np.linalg.solve(own[:k, :k], np.eye(k))
    return beta, np.abs(beta) / np.maximum(error * np.linalg.norm(inverse, axis=1), 1e-300), float(free)


def linear_steps(
    r: np.ndarray, features: Sequence[str], dependent: Sequence[str], level: float
) -> tuple[list[str], list[tuple[str, float]]]:
    """Remaining names and dropped (name, p-value) of the linear model.

    ``r`` is the triangle of a constant, the features and then the label. With no more rows
    than terms nothing can be judged, and nothing is dropped.
    """
    place = {name: i for i, name in enumerate(features, start=1)}
    names = [f for f in features if f not in dependent]
    dropped: list[tuple[str, float]] = []
    while len(names) > 1:
        _, sizes, free = _linear(r, [place[n] for n in names])
        worst = int(np.argmin(sizes[1:]))
        p_value = two_sided(float(sizes[1 + worst]), free)
        if not p_value > level:
            break
        dropped.append((names.pop(worst), p_value))
    return names, dropped


def linear_fit(
    r: np.ndarray,
    features: Sequence[str],
    names: Sequence[str],
    dropped: list[tuple[str, float]],
    dependent: list[str],
) -> Fit:
    """The linear model of some of the features, from the triangle."""
    beta, sizes, free = _linear(r, [features.index(n) + 1 for n in names])
    p_values = [two_sided(float(s), free) for s in [*sizes[1:], sizes[0]]]
    return Fit("gaussian", list(names), [float(b) for b in beta[1:]], float(beta[0]), p_values, dropped, dependent, 1)


def two_sided(t: float, free: float) -> float:
    """Chance of a Student t at least as far from zero; by the angle whose tangent it is.

    NaN without a degree of freedom.
    """
    if free <= 0:
        return math.nan
    if free > 1e5:
        return math.erfc(t / math.sqrt(2))
    start = math.atan(t / math.sqrt(free))
    # the mass sits within a few multiples of 1 / sqrt(free)
    def mass(low: float) -> float:
        high = min(math.pi / 2, low + 60 / math.sqrt(free))
        angle = np.linspace(low, high, 200_001)
        return float(np.trapezoid(np.cos(angle) ** (free - 1), angle))

    return min(1.0, mass(start) / mass(0.0))


def predictor(result: Fit) -> Column:
    """The sum of the intercept and the weighted features."""
    terms = [F.col(f"`{n}`").cast("double") * b for n, b in zip(result.features, result.coefficients)]
    return reduce(Column.__add__, terms, F.lit(result.intercept))


def score(result: Fit, df: DataFrame) -> DataFrame:
    """Add ``prediction``: a probability for the logistic model, a value for the linear one.

    A row with a missing feature has none.
    """
    value = predictor(result)
    if result.family == "binomial":
        # written for either sign so that no exponential overflows
        tail = F.exp(-F.abs(value))
        value = F.when(value >= 0, 1 / (1 + tail)).otherwise(tail / (1 + tail))
    return df.withColumn("prediction", value)


def coefficients(spark: SparkSession, result: Fit) -> DataFrame:
    """Remaining terms with coefficient, p-value and odds ratio (exp of the coefficient)."""
    terms = [*result.features, "(Intercept)"]
    betas = [*result.coefficients, result.intercept]
    rows = [(t, float(b), math.exp(min(b, 700.0)), float(p)) for t, b, p in zip(terms, betas, result.term_p_values)]
    return spark.createDataFrame(
        rows, "term string, coefficient double, odds_ratio double, p_value double"
    )


def collinearity(
    spark: SparkSession, train: DataFrame, features: Sequence[str], label: str, family: str
) -> DataFrame:
    """Inflation factor per predictor; dependent predictors are marked and have none.

    Both come from triangles of the rows, which keep the condition of the columns.
    """
    dependent = dependent_columns(column_triangle(train, features), features)
    names = [f for f in features if f not in dependent]
    weight = None
    fitted = train
    if family == "binomial":
        fitted = score(fit(train, names, label, family), train)
        weight = F.col("prediction") * (1 - F.col("prediction"))
    factors = inflation_factors(column_triangle(fitted, names, weight))
    rows = [(n, float(v), False) for n, v in zip(names, factors)]
    rows += [(n, None, True) for n in dependent]
    return spark.createDataFrame(rows, "term string, vif double, is_aliased boolean")


def _clustered(df: DataFrame, features: Sequence[str], k: int, seed: int) -> tuple[DataFrame, list[np.ndarray]]:
    data = assemble_features(df, features)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(data)
    scaled = scaler.transform(data).drop("features")
    model = KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster").fit(scaled)
    return model.transform(scaled), model.clusterCenters()


def clusters(
    df: DataFrame, features: Sequence[str], k: int = 4, seed: int = 1234
) -> DataFrame:
    """Assign every row to one of ``k`` clusters over standardised columns."""
    return _clustered(df, features, k, seed)[0].drop("scaled")


def cluster_report(df: DataFrame, features: Sequence[str], k: int = 4, seed: int = 1234) -> DataFrame:
    """Per cluster of ``clusters``: rows, their squared distance from the centre, and rows nearer to another centre.

    Distances to the ``k`` centres are expressions; only one row per cluster is shuffled.
    """
    assigned, centres = _clustered(df, features, k, seed)
    place = vector_to_array("scaled")
    square = [
        reduce(Column.__add__, [(F.get(place, F.lit(i)) - float(c)) * (F.get(place, F.lit(i)) - float(c)) for i, c in enumerate(centre)])
        for centre in centres
    ]
    away = assigned.select("cluster", F.array(*square).alias("away"))
    own = F.get("away", "cluster")
    # distances that rounding alone sets apart are equal
    return away.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(own).alias("within"),
        F.count_if(F.array_min("away") < own * (1 - 1e-9)).alias("nearer_to_another"),
    )
