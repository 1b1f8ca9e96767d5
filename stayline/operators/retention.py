"""Monthly activity, churn and retention of feature users."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.numbers import ratio
from stayline.functions.periods import (
    between_days,
    month_start,
    shift_months,
    timestamp_bound,
)


def monthly_activity(responded: DataFrame) -> DataFrame:
    """Distinct (month, user) pairs with activity."""
    return responded.select(
        month_start(F.to_date("timestamp")).alias("month"), F.col("teacher").alias("user_id")
    ).distinct()


def _month_in(month: Column, span: tuple[date, date]) -> Column:
    return month.between(F.lit(span[0]), F.lit(span[1]))


def _around(responded: DataFrame, first: date, last: date) -> DataFrame:
    """Rows of the months from ``first`` to ``last``, as a range of days for the scan."""
    end = shift_months(last.replace(day=1), 1) - timedelta(1)
    return between_days(responded, "timestamp", first.replace(day=1), end)


def active_in_months(responded: DataFrame, span: tuple[date, date]) -> DataFrame:
    """Monthly activity whose month starts inside the span, both ends included."""
    return monthly_activity(_around(responded, *span)).filter(_month_in(F.col("month"), span))


def presentations_per_user(
    responded: DataFrame, times: tuple[date, date], more_than: int
) -> DataFrame:
    """Users with more than so many distinct presentations between two moments."""
    return (
        responded.filter(
            (F.col("timestamp") >= timestamp_bound(responded, "timestamp", times[0]))
            & (F.col("timestamp") <= timestamp_bound(responded, "timestamp", times[1]))
        )
        .groupBy(F.col("teacher").alias("user_id"))
        .agg(F.count_distinct("presentation").alias("num_presentations"))
        .filter(F.col("num_presentations") > more_than)
    )


def churn_retention(
    responded: DataFrame,
    clicks: DataFrame,
    start_months: tuple[date, date],
    end_months: tuple[date, date],
) -> DataFrame:
    """Churn and retention of users who were active early and clicked the button.

    One row: the rates and the three counts. ``n_end`` counts everybody active in the
    later months, not only the cohort. Rates are NULL for an empty cohort.

    Both tables reduce to flags per user in one grouping, so there is no join to skew
    and the activity is read once for both spans.
    """
    month = month_start(F.to_date("timestamp"))
    early, late = _month_in(month, start_months), _month_in(month, end_months)
    low, high = min(start_months[0], end_months[0]), max(start_months[1], end_months[1])
    seen = _around(responded, low, high).select(
        F.col("teacher").alias("user_id"),
        early.alias("early"),
        late.alias("late"),
        F.lit(False).alias("clicked"),
    )
    used = clicks.select(
        "user_id",
        F.lit(False).alias("early"),
        F.lit(False).alias("late"),
        F.lit(True).alias("clicked"),
    )
    per_user = (
        seen.filter("early OR late")
        .unionByName(used)
        .filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(*[F.max(c).alias(c) for c in ("early", "late", "clicked")])
    )
    counts = per_user.agg(
        F.count_if(F.expr("early AND clicked")).alias("n_start"),
        F.count_if(F.expr("late")).alias("n_end"),
        F.count_if(F.expr("early AND clicked AND NOT late")).alias("n_churn"),
    )
    churn = ratio(F.col("n_churn"), F.col("n_start"))
    return counts.select(
        churn.alias("churn_rate"),
        (1.0 - churn).alias("retention_rate"),
        "n_start",
        "n_end",
        "n_churn",
    )
