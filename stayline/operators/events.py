"""Event-category profile of each user's initial period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.numbers import ratio, row_sum
from stayline.functions.periods import Period
from stayline.operators.cohort import Cohort, in_periods
from stayline.operators.joins import lookup_join


def event_profile(
    events: DataFrame,
    cohort: Cohort,
    period: Period,
    dictionary: DataFrame,
    categories: Sequence[str],
) -> DataFrame:
    """Share of each event category among a member's categorised events.

    Categories overlap: an event counts once in each category the dictionary lists it
    under, and the denominator is the sum over the categories. Members whose events
    match nothing have NULL shares; members without events have no row.

    The dictionary becomes one row per event with a 0/1 flag per category, so matching
    repeats no event row, and counts add up before anything is shuffled.
    """
    marks = {f"_c{i}": category for i, category in enumerate(categories)}
    flags = dictionary.groupBy("event").agg(
        *[F.max((F.col("category") == c).cast("long")).alias(mark) for mark, c in marks.items()]
    )
    inside = in_periods(events.select("user_id", "event", "timestamp"), "user_id", cohort, [period])
    counts = (
        lookup_join(inside.select("teacher", "event"), flags, ["event"], "left")
        .groupBy("teacher")
        .agg(*[F.sum(F.coalesce(F.col(m), F.lit(0))).alias(m) for m in marks])
    )
    total = row_sum([F.col(m) for m in marks])
    return counts.select(
        "teacher", *[ratio(F.col(m), total).alias(f"{c}_prop") for m, c in marks.items()]
    )
