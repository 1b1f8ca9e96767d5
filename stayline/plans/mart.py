"""The feature mart: one row per cohort member and period."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.labels import (
    ENGAGEMENT_5,
    TESTED_ONLY,
    Bucket,
    status_label,
    usage_label,
)
from stayline.functions.numbers import flag
from stayline.functions.periods import Period
from stayline.operators.activity import (
    given_answers,
    sessions_of,
    shown_slides,
    special_use_of,
    type_counts_of,
)
from stayline.operators.cohort import Cohort, account_later, first_last_status
from stayline.operators.features import (
    audience,
    bucket_shares,
    month_totals,
    slide_diversity,
    usage_span,
    user_totals,
)
from stayline.operators.frames import scale
from stayline.operators.joins import assemble
from stayline.session import checkpointed


@dataclass(frozen=True)
class Study:
    """Everything that parameterises a study.

    ``usage`` and ``status`` hold the windows of each period under the same names; the
    first is the initial period. Status windows usually start after the trial.
    """

    first_from: date
    first_to: date
    excluded_role: str
    usage: Sequence[Period]
    status: Sequence[Period]
    as_of: date
    special_app: str
    buckets: Sequence[Bucket] = field(default=ENGAGEMENT_5)
    share_digits: int | None = None
    null_trial_is_free: bool = True
    account_type_recode: tuple[str, str] | None = None
    with_status_label: bool = False

    @property
    def initial(self) -> Period:
        return self.usage[0]

    def cohort(self, users: DataFrame) -> Cohort:
        return Cohort.select(users, self.first_from, self.first_to, self.excluded_role)


def feature_mart(
    study: Study,
    cohort: Cohort,
    users: DataFrame,
    slides: DataFrame,
    responses: DataFrame,
    launches: DataFrame,
) -> DataFrame:
    """Features of every cohort member for every period of the study.

    Members without activity keep their row. Slide diversity and the special app
    describe the initial period in all rows.

    Each event table is scanned once, for all periods and all features. What is left of
    slides and responses inside the members' windows, reduced to one row per slide and
    per student, is checkpointed; everything after works on that.
    """
    shown = checkpointed(shown_slides(slides, cohort, study.usage, with_type=True))
    answers = checkpointed(given_answers(responses, cohort, study.usage, study.special_app))
    counted = sessions_of(shown, answers)
    months = month_totals(counted, study.buckets)
    totals = usage_span(
        bucket_shares(user_totals(months, study.buckets), study.buckets, study.share_digits),
        study.as_of,
    )
    statuses = first_last_status(launches, cohort, study.status).drop(
        "first_launch", "last_launch"
    )
    initially = F.col("period") == study.initial.name
    diversity = slide_diversity(type_counts_of(shown.filter(initially)))
    special = special_use_of(answers, study.initial).drop("num_uses")
    account = account_later(
        users,
        study.first_from,
        study.first_to,
        study.excluded_role,
        study.null_trial_is_free,
        study.account_type_recode,
    )
    members = assemble(cohort.members, diversity, special, account)
    periods = F.explode(F.array(*[F.lit(p.name) for p in study.usage]))
    base = assemble(
        members.withColumn("period", periods), totals, statuses, on=("period", "teacher")
    )
    filled = base.na.fill(0, subset=["total_presentations", "special_app_use"])
    labelled = audience(filled, f"n_{study.buckets[0].column}").withColumn(
        "usage_label", usage_label(F.col("total_presentations"), F.col("total_students"))
    )
    if study.with_status_label:
        labelled = labelled.withColumn(
            "status_label",
            status_label(
                F.col("total_presentations"), F.col("total_students"), F.col("status_last")
            ),
        )
    return labelled.drop(*[f"n_{b.column}" for b in study.buckets])


def model_table(
    study: Study, mart: DataFrame, participated: DataFrame, profile: DataFrame
) -> DataFrame:
    """Initial features of each member next to what the member did a period later.

    Outcomes of the later period are ``usage_label_later``, ``subscription_later``,
    ``presentations_later`` and ``used_later``; the subscription falls back to the
    account status where no launch told it. Shares are percentages here.

    Both periods are rows of one mart and meet in a grouping by member, so the mart is
    computed once and not joined to itself.
    """
    initial, later = study.usage[0].name, study.usage[1].name
    outcomes = {
        "usage_label_later": F.col("usage_label"),
        "subscription_later": F.coalesce("status_last", "account_status_later"),
        "presentations_later": F.col("total_presentations"),
    }
    kept = [c for c in mart.columns if c not in ("period", "teacher", "account_status_later")]
    is_initial, is_later = F.col("period") == initial, F.col("period") == later
    paired = mart.groupBy("teacher").agg(
        F.max(F.when(is_initial, F.struct(*kept))).alias("f"),
        F.max(F.when(is_later, F.struct(*[c.alias(n) for n, c in outcomes.items()]))).alias("o"),
    )
    used = (F.col("total_presentations") > 0) & (F.col("usage_label") != TESTED_ONLY)
    used_later = (F.col("presentations_later") > 0) & (
        F.col("usage_label_later") != TESTED_ONLY
    )
    table = (
        paired.select("teacher", "f.*", "o.*")
        .withColumns(
            {
                "used_initial": flag(used),
                "used_later": flag(used_later),
                "premium_later": flag(F.col("subscription_later") == "premium"),
                "premiumtrial_later": flag(F.col("subscription_later") == "premiumtrial"),
                "free_later": flag(F.col("subscription_later") == "free"),
            }
        )
        .withColumnsRenamed(
            {"usage_label": "usage_label_initial", "status_last": "subscription_initial"}
        )
        .drop("status_first")
    )
    joined = assemble(table, participated.select("teacher", "participated_before"), profile)
    shares = [c for c in joined.columns if c.startswith("share_") or c.endswith("_prop")]
    return scale(
        joined.na.fill(0, subset=["total_students", "participated_before"]),
        [*shares, "responses_per_presentation", "slide_diversity"],
        100.0,
    )
