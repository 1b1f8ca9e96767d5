"""Cohorts by first-seen date and the account status around them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.labels import account_status
from stayline.functions.periods import Period, between_days
from stayline.operators.joins import duplicate_keys, fits_broadcast, lookup_join
from stayline.session import checkpointed


def cohort_members(
    users: DataFrame, first_from: date, first_to: date, excluded_role: str
) -> DataFrame:
    """Users first seen in the range whose role is known and not the excluded one."""
    return (
        between_days(users, "first_seen", first_from, first_to)
        .filter(F.col("profile_role") != excluded_role)
        .select(F.col("external_id").alias("teacher"), "first_seen")
    )


@dataclass(frozen=True)
class Cohort:
    """Cohort members with the facts the activity operators plan with.

    The members are stored once, must be one row per user, and ``small``, which allows a
    broadcast into the event joins, is decided on the stored rows. The first-seen range bounds the days an event
    scan must read.
    """

    members: DataFrame
    first_from: date
    first_to: date
    small: bool

    @classmethod
    def select(
        cls, users: DataFrame, first_from: date, first_to: date, excluded_role: str
    ) -> Cohort:
        members = checkpointed(cohort_members(users, first_from, first_to, excluded_role))
        if not duplicate_keys(members).isEmpty():
            raise ValueError("the user table has several rows for one id")
        return cls(members, first_from, first_to, fits_broadcast(members))

    @property
    def first_days(self) -> DataFrame:
        """One column layout for all event joins, so one broadcast serves them all."""
        return self.members.select("teacher", F.to_date("first_seen").alias("first_day"))


def in_periods(
    events: DataFrame, user: str, cohort: Cohort, periods: Sequence[Period]
) -> DataFrame:
    """Events of cohort members inside each member's own windows.

    One scan serves all periods: a row is tagged with every period that holds it.
    The days any member's window can touch are put on the scan as a plain range.
    Adds ``period`` and ``date``; ``user`` becomes ``teacher``.
    """
    spans = [p.span(cohort.first_from, cohort.first_to) for p in periods]
    ranged = between_days(
        events, "timestamp", min(s[0] for s in spans), max(s[1] for s in spans)
    ).withColumnRenamed(user, "teacher")
    joined = lookup_join(ranged, cohort.first_days, ["teacher"], small=cohort.small).withColumn(
        "date", F.to_date("timestamp")
    )
    inside = [p.contains(F.col("date"), F.col("first_day")) for p in periods]
    kept = joined.filter(reduce(or_, inside))
    if len(periods) == 1:
        tagged = kept.withColumn("period", F.lit(periods[0].name))
    else:
        names = [F.when(hit, F.lit(p.name)) for hit, p in zip(inside, periods)]
        tagged = kept.withColumn("period", F.explode(F.array_compact(F.array(*names))))
    return tagged.drop("first_day")


def first_last_status(launches: DataFrame, cohort: Cohort, periods: Sequence[Period]) -> DataFrame:
    """Each member's account status at the first and last launch of every period.

    Members who never launched are kept with empty values; members who launched, but
    never inside the period, are not. Two launches at one time with different status
    resolve to the smaller known status for the first and the larger for the last.

    The statuses come from one scan of the days that any member's windows can touch.
    Launches are reduced to one row per member and status first, which is a plain hash
    aggregate on times; picking the status happens on that small result. Who launched at
    all is told by a scan of the ids and times alone.
    """
    day, first = F.to_date("timestamp"), F.col("first_day")
    spans = [p.span(cohort.first_from, cohort.first_to) for p in periods]
    ranged = between_days(
        launches.select(F.col("user_id").alias("teacher"), "timestamp", "account_status"),
        "timestamp",
        min(s[0] for s in spans),
        max(s[1] for s in spans),
    )
    joined = lookup_join(ranged, cohort.first_days, ["teacher"], small=cohort.small)
    ever = lookup_join(
        launches.select(F.col("user_id").alias("teacher"), "timestamp"),
        cohort.members.select("teacher"),
        ["teacher"],
        small=cohort.small,
    )
    ever = ever.groupBy("teacher").agg(F.count_if(F.col("timestamp").isNull()).alias("undated"))
    bounds = []
    for i, period in enumerate(periods):
        inside = F.when(period.contains(day, first), F.col("timestamp"))
        bounds += [F.min(inside).alias(f"lo{i}"), F.max(inside).alias(f"hi{i}")]
    per_status = joined.groupBy("teacher", "account_status").agg(*bounds)
    known, status = F.col("account_status").isNotNull(), F.col("account_status")
    picks = []
    for i, period in enumerate(periods):
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        picks.append(
            F.struct(
                F.lit(period.name).alias("period"),
                F.min(lo).alias("first_launch"),
                F.max(hi).alias("last_launch"),
                F.min_by(status, F.when(lo.isNotNull(), F.struct(lo, ~known, status))).alias(
                    "status_first"
                ),
                F.max_by(status, F.when(hi.isNotNull(), F.struct(hi, known, status))).alias(
                    "status_last"
                ),
            ).alias(f"p{i}")
        )
    per_user = per_status.groupBy("teacher").agg(*picks)
    never = F.array(
        *[
            F.struct(
                F.lit(p.name).alias("period"),
                F.col(f"p{i}.first_launch"),
                F.col(f"p{i}.last_launch"),
                F.col(f"p{i}.status_first"),
                F.col(f"p{i}.status_last"),
            )
            for i, p in enumerate(periods)
        ]
    )
    return (
        cohort.members.select("teacher")
        .join(ever, "teacher", "left")
        .join(per_user, "teacher", "left")
        .select("teacher", "undated", F.inline(never))
        .filter(
            F.col("first_launch").isNotNull() | F.col("undated").isNull() | (F.col("undated") > 0)
        )
        .select(
            "period",
            "teacher",
            "first_launch",
            "last_launch",
            F.lower("status_first").alias("status_first"),
            F.lower("status_last").alias("status_last"),
        )
    )


def status_rows(launches: DataFrame, cohort: Cohort, period: Period) -> DataFrame:
    """The launches at a member's first or last time in a period, one row each.

    The row form of ``first_last_status``: the status goes to the column of the end it
    belongs to, or to both when first and last coincide. Equal rows are merged.
    """
    inside = in_periods(
        launches.select("user_id", "timestamp", "account_status"), "user_id", cohort, [period]
    )
    times = inside.groupBy("teacher", "timestamp", "account_status").agg(
        F.count(F.lit(1)).alias("launches")
    )
    ends = times.groupBy("teacher").agg(
        F.min("timestamp").alias("first_launch"), F.max("timestamp").alias("last_launch")
    )
    at_first = F.col("timestamp") == F.col("first_launch")
    at_last = F.col("timestamp") == F.col("last_launch")
    return (
        lookup_join(times, ends, ["teacher"], small=cohort.small)
        .filter(at_first | at_last)
        .select(
            "teacher",
            "first_launch",
            "last_launch",
            "timestamp",
            F.when(at_first, F.col("account_status")).alias("account_status_min"),
            F.when(at_last, F.col("account_status")).alias("account_status_max"),
        )
    )


def account_later(
    users: DataFrame,
    first_from: date,
    first_to: date,
    excluded_role: str,
    null_trial_is_free: bool = True,
    recode: tuple[str, str] | None = None,
) -> DataFrame:
    """Current account status and type of the cohort, one type value optionally recoded."""
    kind = F.col("account_type")
    if recode:
        kind = F.when(kind == recode[0], recode[1]).otherwise(kind)
    return (
        between_days(users, "first_seen", first_from, first_to)
        .filter(F.col("profile_role") != excluded_role)
        .select(
            F.col("external_id").alias("teacher"),
            account_status(
                F.col("currently_premium"), F.col("currently_on_trial"), null_trial_is_free
            ).alias("account_status_later"),
            kind.alias("account_type_later"),
        )
    )
