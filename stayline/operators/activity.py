"""Presentation sessions, slide-type counts and app use inside user windows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.periods import Period, between_days, year_month
from stayline.operators.cohort import Cohort, in_periods
from stayline.operators.joins import without_ids
from stayline.session import checkpointed

# Where a response belongs to a slide, apart from the period. Keys with many values come
# first, because joins sort by them in this order.
SLIDE_KEYS = ("presentation_id", "slide_id", "teacher", "date", "hour")


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.to_date("timestamp")).withColumn("hour", F.hour("timestamp"))


def _slide_columns(responses: DataFrame, *more: str) -> DataFrame:
    """Responses under the column names of the slides."""
    return responses.select(
        "teacher",
        F.col("presentation").alias("presentation_id"),
        F.col("slide").alias("slide_id"),
        "student",
        "timestamp",
        *more,
    )


def shown_slides(
    slides: DataFrame, cohort: Cohort, periods: Sequence[Period], with_type: bool = False
) -> DataFrame:
    """Slides shown by members, one row per slide, date and hour of a period.

    ``n_shown`` counts the showings. ``with_type`` keeps rows of different slide types
    apart.
    """
    kind = ["slide_type"] if with_type else []
    columns = ["user_id", "presentation_id", "slide_id", *kind, "timestamp"]
    inside = in_periods(slides.select(*columns), "user_id", cohort, periods)
    return (
        _dated(inside)
        .groupBy(*SLIDE_KEYS, "period", *kind)
        .agg(F.count(F.lit(1)).alias("n_shown"))
    )


def given_answers(
    responses: DataFrame, cohort: Cohort, periods: Sequence[Period], special_app: str
) -> DataFrame:
    """Responses to members' slides, one row per slide, student, date and hour of a period.

    ``special`` tells responses through a matching app from the others; responses
    through an unknown app are neither and are left out. ``n_answers`` counts them.
    """
    known = responses.filter(F.col("app").isNotNull()).withColumn(
        "special", F.col("app").like(special_app)
    )
    inside = in_periods(_slide_columns(known, "special"), "teacher", cohort, periods)
    return (
        _dated(inside)
        .groupBy(*SLIDE_KEYS, "period", "student", "special")
        .agg(F.count(F.lit(1)).alias("n_answers"))
    )


def count_sessions(
    shown: DataFrame, answered: DataFrame, match: Sequence[str], grain: Sequence[str]
) -> DataFrame:
    """Presentations, distinct students and responses per ``grain``.

    ``shown`` has one row per slide shown with ``n_shown`` and is read twice, so it
    should be checkpointed; ``answered`` has one row per slide and student with
    ``n_answers``. Both are already reduced, so the join moves no repeated rows. It is
    an inner join, whose student side the adaptive skew join can split when one slide
    has very many students; slides nobody answered come in through the union. The
    student level is kept through one more grouping, so that a large session is counted
    by many tasks; the last grouping only adds up their partial counts.
    """
    level = list(dict.fromkeys([*grain, "presentation_id"]))
    nobody = F.lit(None).cast(answered.schema["student"].dataType)
    responses = F.when(F.col("student").isNotNull(), F.col("n_shown") * F.col("n_answers"))
    unanswered = shown.select(
        *level, nobody.alias("student"), F.lit(0).cast("long").alias("n_responses")
    )
    met = shown.join(answered, list(match)).select(
        *level, "student", responses.alias("n_responses")
    )
    per_student = (
        unanswered.unionByName(met)
        .groupBy(*level, "student")
        .agg(F.coalesce(F.sum("n_responses"), F.lit(0)).alias("n_responses"))
    )
    if "presentation_id" in grain:
        presentations = F.max(F.col("presentation_id").isNotNull().cast("long"))
        students = F.count("student")
    else:
        presentations = F.count_distinct("presentation_id")
        students = F.count_distinct("student")
    return per_student.groupBy(*grain).agg(
        presentations.alias("num_presentations"),
        students.alias("num_students"),
        F.sum("n_responses").alias("num_responses"),
    )


def sessions_of(shown: DataFrame, answers: DataFrame, by_presentation: bool = True) -> DataFrame:
    """Sessions from checkpointed ``shown_slides`` and from ``given_answers``."""
    match = [*SLIDE_KEYS, "period"]
    grain = ["teacher", "date", "hour", "period"]
    if "slide_type" in shown.columns:
        # stored, so that the join's sides are plain shuffles, which can be split
        shown = checkpointed(shown.groupBy(*match).agg(F.sum("n_shown").alias("n_shown")))
    others = answers.filter(~F.col("special")).drop("special")
    counted = count_sessions(
        shown,
        others,
        match,
        [*grain, "presentation_id"] if by_presentation else grain,
    )
    return counted.withColumn("year_month", year_month(F.col("date")))


def sessions(
    slides: DataFrame,
    responses: DataFrame,
    cohort: Cohort,
    periods: Sequence[Period],
    app_not_like: str,
    by_presentation: bool = True,
) -> DataFrame:
    """One row per member, presentation, date and hour of each period.

    A response belongs to a session through teacher, slide, presentation, date and
    hour; slides shown without an id match no response. ``by_presentation=False`` drops
    the presentation from the grain.
    """
    shown = checkpointed(shown_slides(slides, cohort, periods))
    other_apps = responses.filter(~F.col("app").like(app_not_like))
    return sessions_of(
        shown, given_answers(other_apps, cohort, periods, app_not_like), by_presentation
    )


def sessions_in_place(
    slides: DataFrame,
    responses: DataFrame,
    cohort: Cohort,
    periods: Sequence[Period],
    app_not_like: str,
) -> DataFrame:
    """The rows of ``sessions`` by presentation, from events stored by user and presentation.

    Every grouping and the join have both among their keys, so with a cohort that can be
    broadcast nothing is exchanged; slides are read once, because slides nobody answered
    stay through a left join. Compute it inside ``stored.co_partitioned``.
    """
    shown = shown_slides(slides, cohort, periods)
    others = given_answers(responses.filter(~F.col("app").like(app_not_like)), cohort, periods, app_not_like)
    grain = ["teacher", "presentation_id", "date", "hour", "period"]
    met = shown.join(others, [*SLIDE_KEYS, "period"], "left")
    answers = F.when(F.col("student").isNotNull(), F.col("n_shown") * F.col("n_answers"))
    per_student = met.groupBy(*grain, "student").agg(F.coalesce(F.sum(answers), F.lit(0)).alias("n_responses"))
    counted = per_student.groupBy(*grain).agg(
        F.max(F.col("presentation_id").isNotNull().cast("long")).alias("num_presentations"),
        F.count("student").alias("num_students"),
        F.sum("n_responses").alias("num_responses"),
    )
    return counted.withColumn("year_month", year_month(F.col("date")))


def sessions_of_responses(
    responses: DataFrame, cohort: Cohort, periods: Sequence[Period], app_not_like: str
) -> DataFrame:
    """Sessions told by the responses alone: presentations somebody answered.

    The app filter ignores case. One row per member, date and hour of each period.
    """
    other_apps = responses.filter(~F.lower("app").like(app_not_like.lower()))
    inside = in_periods(_slide_columns(other_apps), "teacher", cohort, periods)
    grain = ["teacher", "date", "hour", "period"]
    answers = (
        _dated(inside)
        .groupBy(*grain, "presentation_id", "student")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return answers.groupBy(*grain).agg(
        F.count_distinct("presentation_id").alias("num_presentations"),
        F.count_distinct("student").alias("num_students"),
        F.sum("n").alias("num_responses"),
    )


def sessions_in_range(
    slides: DataFrame,
    responses: DataFrame,
    users: DataFrame,
    first: date,
    last: date,
    recent_from: date,
    app_not_like: str,
) -> DataFrame:
    """Sessions of a fixed date range without users first seen on or after ``recent_from``.

    Responses meet slides by slide, presentation, date and hour only.
    """
    recent = users.filter(F.to_date("first_seen") >= F.lit(recent_from)).select("external_id")
    match = [k for k in SLIDE_KEYS if k != "teacher"]

    def kept(df: DataFrame) -> DataFrame:
        ranged = between_days(df, "timestamp", first, last)
        return _dated(without_ids(ranged, "teacher", recent, "external_id"))

    columns = ["presentation_id", "slide_id", "timestamp"]
    shown = (
        kept(slides.select(F.col("user_id").alias("teacher"), *columns))
        .groupBy("teacher", *match)
        .agg(F.count(F.lit(1)).alias("n_shown"))
    )
    answered = (
        kept(_slide_columns(responses.filter(~F.col("app").like(app_not_like))))
        .groupBy(*match, "student")
        .agg(F.count(F.lit(1)).alias("n_answers"))
    )
    return count_sessions(
        checkpointed(shown), answered, match, ["teacher", "date", "hour"]
    ).drop("num_responses")


def type_counts_of(shown: DataFrame) -> DataFrame:
    """Slides per member and type from ``shown_slides`` with types."""
    return shown.groupBy("period", "teacher", "slide_type").agg(
        F.count(F.lit(1)).alias("slide_type_count")
    )


def slide_type_counts(slides: DataFrame, cohort: Cohort, periods: Sequence[Period]) -> DataFrame:
    """Slides shown per member and type, a slide counting once per date and hour."""
    return type_counts_of(shown_slides(slides, cohort, periods, with_type=True))


def special_use_of(answers: DataFrame, period: Period) -> DataFrame:
    """Uses of the special app in one period from ``given_answers``."""
    return (
        answers.filter(F.col("special") & (F.col("period") == period.name))
        .groupBy("teacher")
        .agg(F.sum("n_answers").alias("num_uses"))
        .withColumn("special_app_use", F.lit(1))
    )


def special_app_use(
    responses: DataFrame, cohort: Cohort, period: Period, app_like: str
) -> DataFrame:
    """Members with responses through a matching app, the number of uses and a flag of 1."""
    return (
        in_periods(
            responses.filter(F.col("app").like(app_like)).select("teacher", "timestamp"),
            "teacher",
            cohort,
            [period],
        )
        .groupBy("teacher")
        .agg(F.count(F.lit(1)).alias("num_uses"))
        .withColumn("special_app_use", F.lit(1))
    )


def facts_of_responders(
    users: DataFrame, responses: DataFrame, columns: Sequence[str], app_not_like: str
) -> DataFrame:
    """Distinct user facts of users who received responses through other apps."""
    responders = (
        responses.filter(~F.lower("app").like(app_not_like))
        .select(F.col("teacher").alias("external_id"))
        .distinct()
    )
    return users.join(responders, "external_id", "left_semi").select(*columns).distinct()
