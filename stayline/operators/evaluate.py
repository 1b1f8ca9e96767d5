"""How well predictions meet the held-out label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.numbers import ratio
from stayline.operators.ranking import running_totals
from stayline.session import checkpointed


def cutoff_sweep(df: DataFrame, score: str, label: str) -> DataFrame:
    """Confusion counts and metrics for every distinct score taken as the cutoff.

    A row counts as positive when its score is at or above the cutoff. Rows with equal
    scores share one cutoff. Metrics with an empty denominator are NULL, F1 is 0.
    Rows with a NULL or NaN score are in no cell; ``unscored`` says how many there are.
    """
    counts = checkpointed(
        df.groupBy(F.col(score).cast("double").alias("cutoff")).agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
            F.count(F.lit(1)).alias("rows"),
        )
    )
    without = counts.filter(F.col("cutoff").isNull() | F.isnan("cutoff"))
    unscored = without.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    counts = counts.drop("rows")
    cells = running_totals(counts, "cutoff", ["pos", "neg"], descending=True).select(
        "cutoff",
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        (F.col("all_pos") - F.col("cum_pos")).alias("fn"),
        (F.col("all_neg") - F.col("cum_neg")).alias("tn"),
        "pos",
        "neg",
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(
        "*",
        F.lit(unscored).cast("long").alias("unscored"),
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(tn, tn + fp).alias("specificity"),
        ratio(2 * tp, 2 * tp + fp + fn, fill=0).alias("f1"),
    )


def best_cutoff(sweep: DataFrame) -> DataFrame:
    """The sweep row with the highest F1; the higher cutoff on ties."""
    return sweep.orderBy(F.desc("f1"), F.desc("cutoff")).limit(1)


def auc(sweep: DataFrame) -> DataFrame:
    """Area under the ROC curve as the exact rank sum; NULL when a class is empty.

    Of all positive-negative pairs, the share ranked correctly; equal scores count half.
    """
    higher = F.col("tp") - F.col("pos") + F.col("pos") / 2.0
    right = F.sum(F.col("neg").cast("double") * higher)
    return sweep.agg(
        # as doubles: the number of pairs may exceed a long
        ratio(right, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    )


def rmse(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    error = F.pow(F.col(label) - F.col(prediction), F.lit(2))
    return df.agg(F.sqrt(F.avg(error)).alias("rmse"), F.count(F.lit(1)).alias("n"))
