"""Bucket tables and the labels derived from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bucket:
    """An inclusive integer range; an open end is None."""

    name: str
    low: int | None = None
    high: int | None = None

    @property
    def column(self) -> str:
        return self.name.lower().replace("-", "_").replace(" ", "_")

    def holds(self, value: Column) -> Column:
        if self.low is None:
            return value <= self.high
        if self.high is None:
            return value >= self.low
        return value.between(self.low, self.high)


# Bucket names and edges the results must agree on.
ENGAGEMENT_5 = (
    Bucket("Testing", None, 1),
    Bucket("Low", 2, 10),
    Bucket("Low_Medium", 11, 19),
    Bucket("Medium", 20, 30),
    Bucket("High", 31, None),
)
ENGAGEMENT_6 = (
    Bucket("Testing", None, 1),
    Bucket("Low", 2, 5),
    Bucket("Low-Medium", 6, 10),
    Bucket("Medium", 11, 30),
    Bucket("Medium-High", 31, 40),
    Bucket("High", 41, None),
)
AUDIENCE = (
    Bucket("None", 0, 0),
    Bucket("Light", 1, 9),
    Bucket("Medium", 10, 19),
    Bucket("Heavy", 20, 34),
    Bucket("Superuser", 35, None),
)

# Label texts.
NEVER_USED = "Never Used"
TESTED_ONLY = "Tested Product Only"
USED = "Used Product"
TESTED_PROJECT_ONLY = "Tested Project Only"
STATUS_USED = {
    "free": "Used Product Free",
    "premium": "Used Product Premium",
    "premiumtrial": "Used Product PremiumTrial",
}
STATUS_UNKNOWN = "Used Product Unknown Status"


def bucket_label(value: Column, buckets) -> Column:
    """Name of the bucket holding the value; NULL outside every bucket."""
    label = F.lit(None).cast("string")
    for bucket in reversed(buckets):
        label = F.when(bucket.holds(value), bucket.name).otherwise(label)
    return label


def bucket_order(value: Column, buckets) -> Column:
    """Position of the bucket holding the value, from 0."""
    order = F.lit(None).cast("int")
    for position, bucket in reversed(list(enumerate(buckets))):
        order = F.when(bucket.holds(value), position).otherwise(order)
    return order


def usage_label(presentations: Column, students: Column) -> Column:
    """Three-level usage label; an unknown student count leaves it blank."""
    return (
        F.when(presentations == 0, NEVER_USED)
        .when((presentations > 0) & (students <= 1), TESTED_ONLY)
        .when((presentations > 0) & (students > 1), USED)
        .otherwise("")
    )


def status_label(presentations: Column, students: Column, status: Column) -> Column:
    """Usage label that also tells the last known account status of real users."""
    used = (presentations > 0) & (students > 1)
    label = F.when(presentations == 0, NEVER_USED).when(
        (presentations > 0) & (students <= 1), TESTED_PROJECT_ONLY
    )
    for value, text in STATUS_USED.items():
        label = label.when(used & (F.lower(status) == value), text)
    return label.when(used & status.isNull(), STATUS_UNKNOWN).otherwise("")


def account_status(premium: Column, on_trial: Column, null_trial_is_free: bool = False) -> Column:
    """free / premium / premiumtrial from two flags.

    Not premium but on trial has no status, and neither has an unknown flag, unless
    ``null_trial_is_free`` counts an unknown trial flag of a non-premium user as no trial.
    """
    no_trial = ~on_trial
    free_trial = (no_trial | on_trial.isNull()) if null_trial_is_free else no_trial
    return (
        F.when(~premium & free_trial, "free")
        .when(premium & no_trial, "premium")
        .when(premium & on_trial, "premiumtrial")
    )
