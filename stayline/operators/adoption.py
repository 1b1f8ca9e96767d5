"""Who uses a feature, by account status, and who does not."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.labels import account_status
from stayline.functions.periods import timestamp_bound
from stayline.operators.joins import lookup_join


def recent_users(users: DataFrame, presented_from: date) -> DataFrame:
    """Distinct (user, status, account type) of users presenting since a day.

    Users without a defined status are left out.
    """
    return (
        users.filter(
            F.col("last_presented") >= timestamp_bound(users, "last_presented", presented_from)
        )
        .select(
            "external_id",
            account_status(F.col("currently_premium"), F.col("currently_on_trial")).alias(
                "account_status"
            ),
            "account_type",
        )
        .filter(F.col("account_status").isNotNull())
        .distinct()
    )


def feature_counts(slides: DataFrame, since: date, features: Mapping[str, str]) -> DataFrame:
    """Per user, how many slides of each feature type were shown since a day.

    ``features`` maps an output column to the slide type it counts.
    """
    return (
        slides.filter(F.col("timestamp") >= timestamp_bound(slides, "timestamp", since))
        .groupBy("user_id")
        .agg(
            *[
                F.count_if(F.col("slide_type") == kind).alias(name)
                for name, kind in features.items()
            ]
        )
    )


def feature_users(counts: DataFrame, users: DataFrame, group: str = "neither") -> DataFrame:
    """Users with their counts and status: those who used neither feature, or all of them.

    The two groups are not complements; users of only some of the features are in
    neither of them.
    """
    names = [c for c in counts.columns if c != "user_id"]
    if group == "neither":
        chosen = " AND ".join(f"{n} = 0" for n in names)
    elif group == "all":
        chosen = " AND ".join(f"{n} != 0" for n in names)
    else:
        raise ValueError(f"group must be 'neither' or 'all', not {group!r}")
    return (
        counts.filter(chosen)
        .join(users.withColumnRenamed("external_id", "user_id"), "user_id")
        .select("user_id", *names, "account_status")
    )


def users_by_status(df: DataFrame, user: str = "user_id", name: str = "num_users") -> DataFrame:
    return df.groupBy("account_status").agg(F.count_distinct(user).alias(name))


def feature_sums_by_status(df: DataFrame, names: list[str]) -> DataFrame:
    return df.groupBy("account_status").agg(*[F.sum(n).alias(f"sum_{n}") for n in names])


def button_clicks(clicks: DataFrame, button: str, first: date, last: date) -> DataFrame:
    """Clicks of one button between two moments (midnight of ``last`` included)."""
    return clicks.filter(
        (F.col("button") == button)
        & (F.col("timestamp") >= timestamp_bound(clicks, "timestamp", first))
        & (F.col("timestamp") <= timestamp_bound(clicks, "timestamp", last))
    ).select("user_id", "timestamp")


def adopters(clicks: DataFrame, users: DataFrame) -> DataFrame:
    """Each click with its user's status and account type."""
    return lookup_join(
        clicks, users.withColumnRenamed("external_id", "user_id"), ["user_id"]
    ).select(F.col("user_id").alias("external_id"), "account_status", "account_type", "timestamp")


def non_adopters(clicks: DataFrame, users: DataFrame) -> DataFrame:
    """Users without any click."""
    clicked = clicks.select(F.col("user_id").alias("external_id")).distinct()
    return users.join(clicked, "external_id", "left_anti")


def participated_before_presenting(
    responded: DataFrame, users: DataFrame, excluded_role: str
) -> DataFrame:
    """Presenters who took part as a student before they first presented.

    Every row counts for two ids, its presenter and its participant, so one scan and one
    grouping give both first times without a join.
    """
    time = F.col("timestamp")
    unknown = F.lit(None).cast(responded.schema["timestamp"].dataType)
    sides = F.array(
        F.struct(
            F.col("teacher").alias("teacher"), time.alias("taught"), unknown.alias("took_part")
        ),
        F.struct(
            F.col("student").alias("teacher"), unknown.alias("taught"), time.alias("took_part")
        ),
    )
    first_times = (
        responded.select(F.inline(sides))
        .groupBy("teacher")
        .agg(F.min("took_part").alias("first_as_student"), F.min("taught").alias("first_as_teacher"))
        .filter(F.col("first_as_student") < F.col("first_as_teacher"))
    )
    kept = users.filter(F.col("profile_role") != excluded_role).select(
        F.col("external_id").alias("teacher")
    )
    return first_times.join(kept, "teacher", "left_semi").withColumn(
        "participated_before", F.lit(1)
    )
