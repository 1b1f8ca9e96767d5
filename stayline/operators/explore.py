"""The data behind the study's charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.numbers import round_even
from stayline.functions.periods import month_of_text, week_key
from stayline.operators.reshape import share_within
from stayline.sources.tables import hashed_sample


def count_by(df: DataFrame, *columns: str, name: str = "total") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def month_stats(months: DataFrame) -> DataFrame:
    """Total, mean and sample deviation of presentations per user, by month.

    Takes long rows (teacher, year_month, num_presentations). Whether idle months count
    as zero depends on the rows given.
    """
    per_user = months.groupBy("year_month", "teacher").agg(
        F.sum("num_presentations").alias("presentations")
    )
    return (
        per_user.groupBy("year_month")
        .agg(
            F.sum("presentations").alias("total_presentations"),
            round_even(F.avg("presentations"), 0).alias("presentations_avg"),
            round_even(F.stddev_samp("presentations"), 1).alias("presentations_sd"),
        )
        .withColumn("month", month_of_text(F.col("year_month")))
        .drop("year_month")
    )


def week_stats(sessions: DataFrame, iso_year: bool = False) -> DataFrame:
    """Mean and sample deviation of presentations per session row, by week.

    The grain of the rows is the caller's: one per presentation, or per teacher and hour.
    """
    return sessions.groupBy(week_key(F.col("date"), iso_year).alias("year_week")).agg(
        round_even(F.avg("num_presentations"), 0).alias("presentations_avg"),
        round_even(F.stddev_samp("num_presentations"), 1).alias("presentations_sd"),
    )


def histogram(
    df: DataFrame, column: str, width: float = 1, window: tuple[float, float] | None = None
) -> DataFrame:
    """Counts per bin. Bins are centred on multiples of the width and closed on the right."""
    centre = F.ceil(F.col(column).cast("double") / width - 0.5) * width
    bins = (
        df.filter(F.col(column).isNotNull())
        .groupBy(centre.cast("double").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return bins.filter(F.col("bin").between(*window)) if window else bins


def facet_share(df: DataFrame, facet: str, x: str) -> DataFrame:
    """Share of each x value inside its facet."""
    counts = df.groupBy(F.col(facet).alias("facet"), F.col(x).alias("x")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return share_within(counts, ["facet"], "n")


def scatter(
    df: DataFrame, x: str, y: str, label: str | None = None, sample: int | None = None, key: str = "teacher"
) -> DataFrame:
    """All points, or a repeatable sample of so many by the hash of a key, optionally with a label."""
    columns: Sequence[str] = [x, y] + ([label] if label else [])
    return (df if sample is None else hashed_sample(df, sample, [key])).select(*columns)
