"""Logistic regression by Newton steps over one stored design.

The columns of the model are written once; every step reads those it needs and returns one
small sum per task. A fit that follows the loss of a term starts where the one before says
the optimum without the term is, so that elimination takes a few passes a term.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.operators.triangles import column_triangle, dependent_columns
from stayline.session import checkpointed

MAX_PASSES = 50
# half the gain of one more step, in units of the log likelihood, at which a fit is done
GAIN = 1e-12


@dataclass(frozen=True)
class Optimum:
    """Coefficients of a constant and standardised columns, and their covariance."""

    beta: np.ndarray
    covariance: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        """Distance of each coefficient from zero in standard errors."""
        return np.abs(self.beta) / np.sqrt(np.maximum(np.diag(self.covariance), 1e-300))

    def without(self, place: int) -> np.ndarray:
        """Where the optimum lies if one coefficient is zero, as the Hessian has it."""
        moved = self.beta - self.covariance[:, place] * self.beta[place] / self.covariance[place, place]
        return np.delete(moved, place)


class Design:
    """The stored rows of a logistic model; counts the passes over them."""

    def __init__(self, train: DataFrame, features: Sequence[str], label: str):
        """Rows must be complete and the label in 0..1. Dependent columns are set aside."""
        columns = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)]
        self.frame = checkpointed(train.select(*columns, F.col(f"`{label}`").cast("double").alias("y")))
        r = column_triangle(self.frame, [*(f"x{i}" for i in range(len(features))), "y"])
        self.rows = round(float(r[0, 0]) ** 2)
        if not self.rows:
            raise ValueError("a model needs rows")
        self.dependent = dependent_columns(r[:-1, :-1], features)
        self.names = [f for f in features if f not in self.dependent]
        self.place = {name: i for i, name in enumerate(features)}
        self.means = r[0, 1:] / r[0, 0]
        self.spreads = np.linalg.norm(r[1:, 1:], axis=0) / math.sqrt(self.rows)
        self.passes = 1

    def sums(self, names: Sequence[str], beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Hessian, gradient and deviance at some coefficients; one pass."""
        at = [self.place[n] for n in names]
        means, spreads = self.means[at], self.spreads[at]
        p = len(at) + 1

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(p * p + p + 1)
            for batch in batches:
                values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                y, n = values[-1], batch.num_rows
                x = np.column_stack([np.ones(n), *[(v - m) / s for v, m, s in zip(values, means, spreads)]])
                eta = x @ beta
                mu = 0.5 * (1 + np.tanh(eta / 2))
                total[: p * p] += (x.T @ (x * (mu * (1 - mu))[:, None])).ravel()
                total[p * p : -1] += x.T @ (y - mu)
                total[-1] += 2 * (np.logaddexp(0, eta) - y * eta).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

        data = self.frame.select(*[f"x{i}" for i in at], "y")
        found = data.mapInArrow(add, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(p * p + p + 1)
        for i, v in found:
            total[i] = v
        self.passes += 1
        return total[: p * p].reshape(p, p), total[p * p : -1], float(total[-1])

    def start(self, names: Sequence[str]) -> np.ndarray:
        """All coefficients zero but the constant, which gives the label's mean."""
        mean = min(max(self.means[-1], 1e-6), 1 - 1e-6)
        return np.array([math.log(mean / (1 - mean)), *[0.0] * len(names)])

    def fit(self, names: Sequence[str], beta: np.ndarray) -> Optimum:
        """Newton steps from some coefficients; a step that raises the deviance is halved.

        If the label can be told from the columns without error there is no optimum; the
        steps then end when the gain or ``MAX_PASSES`` is used up.
        """
        before, best = beta, math.inf
        for _ in range(MAX_PASSES):
            hessian, gradient, deviance = self.sums(names, beta)
            if deviance > best * (1 + 1e-10) + 1e-10:
                beta = (before + beta) / 2
                continue
            covariance = np.linalg.pinv(hessian, rcond=1e-14, hermitian=True)
            step = covariance @ gradient
            before, best = beta, deviance
            beta = beta + step
            if gradient @ step / 2 <= GAIN:
                break
        return Optimum(beta, covariance)

    def unscaled(self, names: Sequence[str], found: Optimum) -> tuple[list[float], float, list[float]]:
        """Coefficients of the columns as they are, the intercept, and p-values, the intercept's last."""
        at = [self.place[n] for n in names]
        shift = np.array([1.0, *(-self.means[at] / self.spreads[at])])
        intercept = float(shift @ found.beta)
        error = math.sqrt(max(float(shift @ found.covariance @ shift), 1e-300))
        sizes = [*found.sizes[1:], abs(intercept) / error]
        return list(found.beta[1:] / self.spreads[at]), intercept, [normal_p_value(float(s)) for s in sizes]


def normal_p_value(size: float) -> float:
    return math.erfc(size / math.sqrt(2))
