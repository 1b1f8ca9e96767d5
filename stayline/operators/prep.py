"""Train / test / validation split, class balance, up-sampling, collinearity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.numbers import ratio
from stayline.operators.ranking import exact_quantiles, hash_rank

TRAIN, TEST, VALIDATION = "train", "test", "validation"


def quantile_strata(df: DataFrame, column: str, groups: int = 5, name: str = "stratum") -> DataFrame:
    """Add the quantile bin of a numeric label; ``groups`` cut points give one bin fewer.

    Bins are closed on the right, the first one on both sides; equal cut points merge.
    """
    cuts = sorted(set(exact_quantiles(df, column, [i / (groups - 1) for i in range(groups)])))
    value = F.col(column).cast("double")
    stratum = F.lit(0)
    for position, cut in enumerate(cuts[1:-1], start=1):
        stratum = F.when(value > cut, position).otherwise(stratum)
    return df.withColumn(name, stratum)


def stratified_split(
    df: DataFrame,
    stratum: str,
    key: str,
    seed: int = 1234,
    train: float = 0.70,
    test: float = 0.50,
) -> DataFrame:
    """Add ``split``: train, test or validation, with exact sizes in every stratum.

    ``train`` is a share of the stratum and ``test`` a share of what remains; both round
    up. The order within a stratum is a seeded hash of the row's key, so the split is
    the same on every run and cluster.
    """
    in_train = F.ceil(F.col("group_size") * train)
    in_test = F.ceil((F.col("group_size") - in_train) * test)
    split = (
        F.when(F.col("rank") < in_train, TRAIN)
        .when(F.col("rank") < in_train + in_test, TEST)
        .otherwise(VALIDATION)
    )
    return (
        hash_rank(df, stratum, key, seed).withColumn("split", split).drop("rank", "group_size")
    )


def pick_split(df: DataFrame, validate: bool) -> tuple[DataFrame, DataFrame]:
    """The training rows and the held-out rows a model is judged on."""
    held_out = VALIDATION if validate else TEST
    return (
        df.filter(F.col("split") == TRAIN).drop("split"),
        df.filter(F.col("split") == held_out).drop("split"),
    )


def class_balance(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Rows and share per class, for all rows and for every split.

    The window runs over the counts, one row per class.
    """
    counts = (
        df.select(
            F.col(label).alias("label"), F.explode(F.array(F.lit("all"), split)).alias("part")
        )
        .groupBy("part", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("part"))
    return counts.withColumn("share", ratio(F.col("n"), total))


def upsample(df: DataFrame, label: str, key: str, seed: int = 1234) -> DataFrame:
    """Repeat rows of the smaller classes until every class has the largest one's size.

    Each row is repeated equally often, the remainder going to the rows that rank first
    by a seeded hash. Copies are made in two steps of about the square root of their
    number, so a single row standing for a whole class needs no long array; between the
    steps the rows are dealt out by key and block, so that one row's copies fill many tasks.
    """
    largest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    copies = F.floor(F.col("_target") / F.col("group_size")) + (
        F.col("rank") < F.col("_target") % F.col("group_size")
    ).cast("long")
    blocks = F.ceil(F.col("_copies") / F.col("_step"))
    in_block = F.least(F.col("_step"), F.col("_copies") - F.col("_block") * F.col("_step"))
    return (
        hash_rank(df, label, key, seed)
        .withColumn("_target", largest)
        .withColumn("_copies", copies)
        .withColumn("_step", F.ceil(F.sqrt("_copies")))
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .repartition(key, "_block")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), in_block)))
        .drop("rank", "group_size", "_target", "_copies", "_step", "_block", "_copy")
    )


def gram(df: DataFrame, columns: Sequence[str], weight: Column | None = None) -> np.ndarray:
    """Weighted cross products of a constant and the columns, each less its mean.

    The means come from one aggregation, so that columns far from zero keep their digits; a
    column whose deviation is only rounding is zero. Every task adds up one small matrix;
    only those sums are shuffled and collected.
    """
    p = len(columns) + 1
    numbers = [F.col(f"`{c}`").cast("double") for c in columns]
    found = df.agg(F.count(F.lit(1)), *[f(x) for x in numbers for f in (F.avg, F.stddev_pop)]).first()
    means = np.array([found[1 + 2 * i] or 0.0 for i in range(p - 1)])
    spread = np.array([found[2 + 2 * i] or 0.0 for i in range(p - 1)])
    moves = np.where(spread > 1e-9 * np.abs(means), 1.0, 0.0)
    data = df.select(
        *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)],
        (F.lit(1.0) if weight is None else weight).alias("w"),
    )

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p))
        for batch in batches:
            values = batch.to_numpy(dtype=float)
            x = np.column_stack([np.ones(len(values)), (values[:, :-1] - means) * moves])
            total += x.T @ (x * values[:, -1:])
        i, j = np.indices((p, p)).reshape(2, -1)
        yield pd.DataFrame({"i": i, "j": j, "v": total.reshape(-1)})

    sums = data.mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v"))
    matrix = np.zeros((p, p))
    for i, j, v in sums.collect():
        matrix[i, j] = v
    return matrix


def aliased(cross: np.ndarray, columns: Sequence[str], tolerance: float = 1e-8) -> list[str]:
    """Columns that are a linear combination of the constant and the columns before them.

    Works on the cross products of ``gram``: a column whose length outside the span of
    the earlier ones is negligible is dependent.
    """
    scale = np.sqrt(np.diag(cross))
    scale[scale == 0] = 1.0
    c = cross / np.outer(scale, scale)
    kept, dependent = [0], []
    for j, name in enumerate(columns, start=1):
        base = c[np.ix_(kept, kept)]
        inner = c[kept, j]
        left = c[j, j] - inner @ np.linalg.solve(base, inner)
        if left > tolerance:
            kept.append(j)
        else:
            dependent.append(name)
    return dependent


def variance_inflation(cross: np.ndarray) -> np.ndarray:
    """Inflation factor of each single-column term from weighted cross products.

    The covariance of the coefficients is the inverse of the matrix; without the
    constant and as a correlation matrix, its inverse has the factors on the diagonal.
    """
    scale = np.sqrt(np.diag(cross))
    cov = np.linalg.inv(cross / np.outer(scale, scale))[1:, 1:]
    sd = np.sqrt(np.diag(cov))
    return np.diag(np.linalg.inv(cov / np.outer(sd, sd)))
