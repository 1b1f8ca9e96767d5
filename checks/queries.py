"""One query per operator, over the test tables in the roles of ``FIXTURES.md``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.functions import labels, numbers, periods
from stayline.functions.labels import Bucket
from stayline.functions.periods import Period
from stayline.operators import (
    activity,
    adoption,
    bitmaps,
    cohort,
    evaluate,
    events,
    explore,
    features,
    frames,
    models,
    prep,
    ranking,
    reshape,
    retention,
)
from stayline.operators.cohort import Cohort
from stayline.operators.joins import assemble, without_ids
from stayline.plans import mart, presets
from stayline.session import checkpoint_folder, checkpointed, configure
from stayline.sources import stored, tables
from stayline.sources.roles import Roles

ROLE = "HOUSEHOLD"
APP = "%widget%"
INITIAL, LATER = Period("initial", 0, 12), Period("later", 0, 12, 12)
# Students per presentation only reach 12 in the test tables, so the edges are smaller.
BUCKETS_5 = (
    Bucket("Testing", None, 1),
    Bucket("Low", 2, 3),
    Bucket("Low_Medium", 4, 5),
    Bucket("Medium", 6, 8),
    Bucket("High", 9, None),
)
BUCKETS_6 = (
    Bucket("Testing", None, 1),
    Bucket("Low", 2, 3),
    Bucket("Low-Medium", 4, 4),
    Bucket("Medium", 5, 6),
    Bucket("Medium-High", 7, 9),
    Bucket("High", 10, None),
)
STUDY = mart.Study(
    first_from=date(1995, 1, 1),
    first_to=date(1995, 12, 31),
    excluded_role=ROLE,
    usage=(INITIAL, LATER),
    status=(Period("initial", 1, 12), Period("later", 1, 12, 12)),
    as_of=date(1999, 6, 30),
    special_app=APP,
    buckets=BUCKETS_5,
    account_type_recode=("MACHINERY", "BUILDING"),
)
OLDER_STUDY = mart.Study(
    first_from=STUDY.first_from,
    first_to=STUDY.first_to,
    excluded_role=ROLE,
    usage=(INITIAL,),
    status=STUDY.status[:1],
    as_of=STUDY.as_of,
    special_app=APP,
    buckets=BUCKETS_6,
    share_digits=2,
    null_trial_is_free=False,
    with_status_label=True,
)
EVENT_PERIOD = Period("initial", 0, 14, unit="day")
EVENT_DAYS = (date(2024, 1, 1), date(2024, 1, 31))
CATEGORIES = (
    "teacher_event",
    "student_event",
    "before_session",
    "during_session",
    "after_session",
    "before_signup",
)
SLIDE_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
FEATURES = {"drawing_count": "PROMO", "draggable_count": "LARGE"}
FEATURES_SINCE = date(2001, 1, 1)
BUTTON = "1-URGENT"
START_MONTHS = (date(1995, 1, 1), date(1995, 8, 1))
END_MONTHS = (date(1996, 1, 1), date(1996, 6, 1))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(build: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
    def run(spark: SparkSession, root: str) -> DataFrame:
        return frames.ids_as_text(build(Roles(configure(spark), root)))

    QUERIES[build.__name__] = run
    return build


def _cohort(r: Roles) -> Cohort:
    return STUDY.cohort(r.user_facts())


def _sessions(r: Roles, which=(INITIAL,), by_presentation: bool = True) -> DataFrame:
    return activity.sessions(
        r.slide_presented(with_type=False),
        r.student_responses(),
        _cohort(r),
        which,
        APP,
        by_presentation,
    )


# --- scans, projections, scalar functions ---------------------------------------------


@register
def scan_limit_sample(r: Roles) -> DataFrame:
    chosen = tables.query(
        r.spark,
        "SELECT user_id, event, timestamp FROM {events} WHERE timestamp >= :since",
        {"events": r.app_events()},
        since=date(2024, 1, 10),
    )
    renamed = chosen.withColumnRenamed("event", "event_name")
    return tables.sample_rows(renamed, 500, ["timestamp", "user_id"])


@register
def filters_basic(r: Roles) -> DataFrame:
    responses = r.student_responses()
    kept = responses.filter(
        F.col("app").like(APP)
        & ~F.lower("app").like("%red%")
        & (F.col("teacher") != F.col("student"))
        & F.col("slide").isNotNull()
        & (F.col("timestamp") >= periods.timestamp_bound(responses, "timestamp", "1996-01-01"))
        & (F.col("timestamp") <= periods.timestamp_bound(responses, "timestamp", "1999-01-01"))
    )
    in_days = periods.between_days(kept, "timestamp", date(1996, 3, 1), date(1998, 6, 30))
    return in_days.groupBy("app").agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.count_if(F.col("student").cast("double") < 50).alias("low_students"),
    )


@register
def recode_fill_scale(r: Roles) -> DataFrame:
    users = r.user_facts()
    status = labels.account_status(F.col("currently_premium"), F.col("currently_on_trial"))
    launched = (
        r.launch_presentation()
        .groupBy(F.col("user_id").alias("external_id"))
        .agg(F.count_if(F.col("account_status") == "premium").alias("premium_launches"))
        .filter("premium_launches >= 4")
        .withColumn("often_premium", F.lit(1))
    )
    kept = frames.drop_where(users, F.col("account_type") == "FURNITURE")
    joined = kept.join(launched, "external_id", "left").select(
        "external_id",
        F.when(F.col("account_type") == "MACHINERY", "BUILDING")
        .otherwise(F.col("account_type"))
        .alias("account_type"),
        F.coalesce(status, "account_type").alias("subscription"),
        numbers.flag(status == "premium").alias("is_premium"),
        F.nullif(F.col("profile_role"), F.lit("BUILDING")).alias("role_or_null"),
        "premium_launches",
        "often_premium",
    )
    filled = frames.fill(joined, {"often_premium": 0, "premium_launches": 0})
    return frames.scale(filled, ["premium_launches"], 100.0)


@register
def scalar_dates(r: Roles) -> DataFrame:
    day = F.to_date("timestamp")
    text = periods.year_month(day)
    return r.launch_presentation().select(
        "user_id",
        "timestamp",
        day.alias("day"),
        F.hour("timestamp").alias("hour"),
        F.add_months(day, 3).alias("plus_3"),
        F.add_months(F.add_months(day, 3), 12).alias("plus_3_12"),
        periods.month_start(day).alias("month"),
        text.alias("year_month"),
        periods.month_of_text(text).alias("month_of_text"),
        periods.months_inclusive(day, F.lit(STUDY.as_of)).alias("months_to_day"),
        periods.week_key(day).alias("week_key"),
        periods.week_key(day, iso_year=True).alias("iso_week_key"),
    )


@register
def scalar_text(r: Roles) -> DataFrame:
    name = F.col("c_name")
    named = r.table("customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.lower(name).alias("lowered"),
        F.substring(name, 10, 9).alias("number"),
        F.concat(F.lit("num_"), F.substring(name, 1, 8)).alias("prefixed"),
        F.regexp_replace(name, "#", "").alias("cleaned"),
        F.when(F.col("c_acctbal") > 5000, "rich").otherwise("").alias("left_part"),
        F.when(F.col("c_nationkey") < 10, "near").otherwise("").alias("right_part"),
    )
    return reshape.unite(named, "united", ["left_part", "right_part"])


@register
def scalar_numeric(r: Roles) -> DataFrame:
    balance = F.col("c_acctbal")
    nation = F.col("c_nationkey")
    return r.table("customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        numbers.ratio(nation, F.col("c_custkey") - 10).alias("guarded"),
        numbers.ratio(nation, nation - nation, fill=0).alias("zero"),
        numbers.round_even(nation / F.lit(8.0), 2).alias("rounded"),
        F.round(F.log(6.0, nation + 1), 6).alias("log_6"),
        F.round(F.exp(nation / F.lit(25.0)), 6).alias("odds"),
        F.round(F.sqrt(F.abs(balance)), 6).alias("root"),
        F.round(F.pow(balance / 1000, F.lit(2)), 6).alias("square"),
        (1 - nation / F.lit(25.0)).alias("complement"),
    )


# --- aggregation and joins --------------------------------------------------------------


@register
def first_last_event(r: Roles) -> DataFrame:
    return (
        r.app_events()
        .groupBy("user_id", F.to_date("timestamp").alias("date"))
        .agg(
            F.min("timestamp").alias("first_event"),
            F.max("timestamp").alias("last_event"),
            F.min(F.hour("timestamp")).alias("first_hour"),
            F.count_distinct(F.hour("timestamp")).alias("hours"),
        )
    )


@register
def group_totals(r: Roles) -> DataFrame:
    counts = activity.slide_type_counts(r.slide_presented(), _cohort(r), [INITIAL])
    per_type = counts.groupBy("slide_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("slide_type_count").alias("known"),
        F.sum("slide_type_count").alias("slides"),
        F.count_distinct("teacher").alias("teachers"),
    )
    totals = counts.groupBy("slide_type").agg(F.max("slide_type_count").alias("most"))
    return per_type.join(totals, "slide_type")


@register
def rownumber_widen(r: Roles) -> DataFrame:
    rows = cohort.status_rows(r.launch_presentation(), _cohort(r), STUDY.status[0])
    return reshape.number_rows(
        rows, ["teacher"], ["timestamp", "account_status_min", "account_status_max"]
    ).select("teacher", "position", "timestamp", "account_status_min", "account_status_max")


@register
def status_rows_widened(r: Roles) -> DataFrame:
    rows = cohort.status_rows(r.launch_presentation(), _cohort(r), STUDY.status[0])
    values = ["timestamp", "account_status_min", "account_status_max"]
    return reshape.widen_rows(rows, ["teacher"], values, values, positions=2)


@register
def left_assembly(r: Roles) -> DataFrame:
    slides = r.slide_presented(with_type=False).groupBy(F.col("user_id").alias("teacher")).agg(
        F.count(F.lit(1)).alias("slides")
    )
    launches = (
        r.launch_presentation()
        .filter(F.col("account_status") == "premium")
        .groupBy(F.col("user_id").alias("teacher"))
        .agg(F.count(F.lit(1)).alias("premium_launches"))
    )
    return assemble(_cohort(r).members, slides, launches)


# --- status and adoption ----------------------------------------------------------------


@register
def account_status(r: Roles) -> DataFrame:
    users = tables.flatten_user_facts(r.user_facts_nested())
    premium, trial = F.col("currently_premium"), F.col("currently_on_trial")
    return users.select(
        "external_id",
        "profile_role",
        "account_type",
        labels.account_status(premium, trial).alias("account_status"),
        labels.account_status(premium, F.when(trial, trial), True).alias("lenient_status"),
    )


def _feature_users(r: Roles, group: str) -> DataFrame:
    counts = adoption.feature_counts(r.slide_presented(), FEATURES_SINCE, FEATURES)
    users = adoption.recent_users(r.user_facts(), FEATURES_SINCE)
    return adoption.feature_users(counts, users, group)


@register
def feature_nonusers_by_status(r: Roles) -> DataFrame:
    return adoption.users_by_status(_feature_users(r, "neither"))


@register
def feature_sums_by_status(r: Roles) -> DataFrame:
    neither = adoption.feature_sums_by_status(_feature_users(r, "neither"), list(FEATURES))
    both = adoption.feature_sums_by_status(_feature_users(r, "all"), list(FEATURES))
    return neither.withColumn("used", F.lit("neither")).unionByName(
        both.withColumn("used", F.lit("all"))
    )


@register
def feature_both_users(r: Roles) -> DataFrame:
    return _feature_users(r, "all")


def _clicks(r: Roles) -> DataFrame:
    return adoption.button_clicks(r.presenter_button_clicked(), BUTTON, *START_MONTHS)


@register
def adopters_with_status(r: Roles) -> DataFrame:
    return adoption.adopters(_clicks(r), adoption.recent_users(r.user_facts(), FEATURES_SINCE))


@register
def nonadopters_by_status(r: Roles) -> DataFrame:
    users = adoption.recent_users(r.user_facts(), FEATURES_SINCE)
    left = adoption.non_adopters(_clicks(r), users)
    return adoption.users_by_status(left, "external_id", "distinct_users").orderBy(
        "account_status"
    )


@register
def participated_before_presenting(r: Roles) -> DataFrame:
    return adoption.participated_before_presenting(r.student_responded(), r.user_facts(), ROLE)


# --- activity months and retention ------------------------------------------------------


@register
def monthly_activity(r: Roles) -> DataFrame:
    return retention.monthly_activity(r.student_responded())


@register
def active_with_min_presentations(r: Roles) -> DataFrame:
    active = retention.active_in_months(r.student_responded(), START_MONTHS)
    often = retention.presentations_per_user(r.student_responded(), START_MONTHS, more_than=1)
    return active.join(often, "user_id")


@register
def churn_retention(r: Roles) -> DataFrame:
    return retention.churn_retention(r.student_responded(), _clicks(r), START_MONTHS, END_MONTHS)


ALL_MONTHS = bitmaps.Months(date(1995, 1, 1), date(1998, 12, 1))
SPANS = {
    "published": (START_MONTHS, END_MONTHS),
    "year_on_year": ((date(1995, 1, 1), date(1995, 12, 1)), (date(1996, 1, 1), date(1996, 12, 1))),
    "one_month": ((date(1996, 3, 1), date(1996, 3, 1)), (date(1997, 3, 1), date(1997, 3, 1))),
}


def _bitmaps(r: Roles) -> DataFrame:
    return bitmaps.activity_bitmaps(r.student_responded(), ALL_MONTHS)


@register
def churn_of_spans(r: Roles) -> DataFrame:
    return bitmaps.churn_of_spans(_bitmaps(r), _clicks(r), ALL_MONTHS, SPANS)


@register
def retention_matrix(r: Roles) -> DataFrame:
    return bitmaps.retention_matrix(_bitmaps(r), ALL_MONTHS)


@register
def cohort_matrix(r: Roles) -> DataFrame:
    return bitmaps.cohort_matrix(_bitmaps(r), ALL_MONTHS)


@register
def distinct_users_by_period(r: Roles) -> DataFrame:
    month = F.col("month")
    levels = {
        "month": F.date_format(month, "yyyy-MM"),
        "quarter": F.concat_ws("-", F.year(month), F.quarter(month)),
        "year": F.year(month),
        "total": F.lit("all"),
    }
    return bitmaps.distinct_by_period(r.launch_presentation(), "user_id", "timestamp", levels, ["account_status"])


# --- cohort pulls -----------------------------------------------------------------------


@register
def cohort_members(r: Roles) -> DataFrame:
    return cohort.cohort_members(r.user_facts(), STUDY.first_from, STUDY.first_to, ROLE)


@register
def first_last_status_initial(r: Roles) -> DataFrame:
    return cohort.first_last_status(r.launch_presentation(), _cohort(r), STUDY.status[:1])


@register
def first_last_status_later(r: Roles) -> DataFrame:
    return cohort.first_last_status(r.launch_presentation(), _cohort(r), STUDY.status[1:])


@register
def sessions_initial(r: Roles) -> DataFrame:
    return _sessions(r)


@register
def sessions_stored(r: Roles) -> DataFrame:
    """The initial sessions from events stored by year, user and presentation."""
    cohort, tag = _cohort(r), uuid.uuid4().hex
    first, last = INITIAL.span(cohort.first_from, cohort.first_to)
    buckets = int(r.spark.conf.get("spark.sql.shuffle.partitions"))
    slides, answers = f"slides_{tag}", f"answers_{tag}"
    stored.store_events(r.slide_presented(with_type=False), slides, ["user_id", "presentation_id"], buckets, "year")
    stored.store_events(r.student_responses(), answers, ["teacher", "presentation"], buckets, "year")
    pulled = [stored.stored_events(r.spark, name, first, last, "year") for name in (slides, answers)]
    with stored.co_partitioned(r.spark):
        return checkpointed(activity.sessions_in_place(*pulled, cohort, [INITIAL], APP))


@register
def sessions_later(r: Roles) -> DataFrame:
    return _sessions(r, (LATER,), by_presentation=False)


@register
def sessions_of_responses(r: Roles) -> DataFrame:
    return activity.sessions_of_responses(r.student_responses(), _cohort(r), [INITIAL], APP)


@register
def sessions_excluding_recent(r: Roles) -> DataFrame:
    return activity.sessions_in_range(
        r.slide_presented(with_type=False),
        r.student_responses(),
        r.user_facts(),
        date(1996, 1, 1),
        date(1998, 12, 31),
        date(1996, 1, 1),
        APP,
    )


@register
def user_facts_of_responders(r: Roles) -> DataFrame:
    users = r.user_facts()
    early = users.filter(
        F.col("first_seen") < periods.timestamp_bound(users, "first_seen", "1996-01-01")
    )
    responses = periods.between_days(
        r.student_responses(), "timestamp", date(1995, 1, 1), date(1997, 12, 31)
    )
    return activity.facts_of_responders(
        early, responses, ["external_id", "profile_role", "first_seen", "account_type"], APP
    )


@register
def slide_type_counts(r: Roles) -> DataFrame:
    return activity.slide_type_counts(r.slide_presented(), _cohort(r), [INITIAL])


@register
def slide_type_shares_wide(r: Roles) -> DataFrame:
    counts = activity.slide_type_counts(r.slide_presented(), _cohort(r), [INITIAL])
    return reshape.shares_wide(
        counts,
        ["teacher"],
        "slide_type",
        "slide_type_count",
        {f"share_{t.lower()}": t for t in SLIDE_TYPES},
    )


@register
def special_app_flag(r: Roles) -> DataFrame:
    members = _cohort(r)
    used = activity.special_app_use(r.student_responses(), members, INITIAL, APP)
    flagged = assemble(members.members.select("teacher"), used)
    return frames.fill(flagged, {"num_uses": 0, "special_app_use": 0})


@register
def account_later(r: Roles) -> DataFrame:
    return cohort.account_later(
        r.user_facts(),
        STUDY.first_from,
        STUDY.first_to,
        ROLE,
        recode=STUDY.account_type_recode,
    )


@register
def event_profile(r: Roles) -> DataFrame:
    members = Cohort.select(r.event_users(), *EVENT_DAYS, excluded_role="student")
    return events.event_profile(
        r.app_events(), members, EVENT_PERIOD, r.event_dictionary(), CATEGORIES
    )


@register
def excluded_ids_removed(r: Roles) -> DataFrame:
    members = _cohort(r).members
    return without_ids(members, "teacher", r.excluded_users(), "hashed_coach_id")


def _scratch_file(r: Roles, name: str) -> str:
    """A place for a file that a query writes and reads again."""
    return f"{checkpoint_folder(r.spark)}/{name}-{uuid.uuid4().hex}"


@register
def exclusion_file_read(r: Roles) -> DataFrame:
    path = _scratch_file(r, "excluded")
    listed = r.excluded_users().select(F.col("hashed_coach_id").cast("string"))
    # as in a list kept by hand, ids repeat and some are missing
    unknown = listed.limit(1).select(F.lit(None).cast("string").alias("hashed_coach_id"))
    tables.write_result(listed.unionByName(listed).unionByName(unknown), path, "csv")
    return without_ids(_cohort(r).members, "teacher", tables.excluded_ids(r.spark, path), "hashed_coach_id")


# --- reshape and features ---------------------------------------------------------------

MONTHS = periods.month_list(date(1995, 1, 1), date(1996, 12, 1))


def _months_wide(r: Roles) -> DataFrame:
    return reshape.widen(
        _sessions(r), ["teacher"], "year_month", "num_presentations", MONTHS
    )


@register
def presentations_by_month_wide(r: Roles) -> DataFrame:
    return _months_wide(r)


@register
def presentations_by_month_long(r: Roles) -> DataFrame:
    return reshape.lengthen(
        _months_wide(r), ["teacher"], MONTHS, "year_month", "num_presentations"
    )


@register
def low_engagement_counts(r: Roles) -> DataFrame:
    return frames.low_engagement(_sessions(r), at_most=4)


def _totals(r: Roles, buckets) -> DataFrame:
    months = features.month_totals(_sessions(r), buckets, ["teacher"])
    return features.user_totals(months, buckets, ["teacher"])


def _share_columns(buckets) -> list[str]:
    return [f"share_{b.column}" for b in buckets]


@register
def bucket_shares_5(r: Roles) -> DataFrame:
    shares = features.bucket_shares(_totals(r, BUCKETS_5), BUCKETS_5)
    return shares.select("teacher", *_share_columns(BUCKETS_5), "share_valid")


@register
def bucket_shares_6(r: Roles) -> DataFrame:
    shares = features.bucket_shares(_totals(r, BUCKETS_6), BUCKETS_6, digits=2)
    return shares.select("teacher", *_share_columns(BUCKETS_6))


@register
def teacher_totals(r: Roles) -> DataFrame:
    return _totals(r, ())


@register
def usage_span_intensity(r: Roles) -> DataFrame:
    return features.usage_span(_totals(r, ()), STUDY.as_of).select(
        "teacher",
        "first_month",
        "last_month",
        "months_spanned",
        "months_since_first",
        "months_used_share",
        "presentations_per_month_used",
        "presentations_per_month_spanned",
        "presentations_per_month_since",
    )


@register
def slide_diversity(r: Roles) -> DataFrame:
    return features.slide_diversity(
        activity.slide_type_counts(r.slide_presented(), _cohort(r), [INITIAL])
    )


def _mart(r: Roles, study: mart.Study = STUDY) -> DataFrame:
    users = r.user_facts()
    return mart.feature_mart(
        study,
        study.cohort(users),
        users,
        r.slide_presented(),
        r.student_responses(),
        r.launch_presentation(),
    )


def _labelled_totals(r: Roles) -> DataFrame:
    base = assemble(_cohort(r).members.select("teacher"), _totals(r, BUCKETS_5))
    return frames.fill(base, {"total_presentations": 0})


@register
def usage_label(r: Roles) -> DataFrame:
    return _labelled_totals(r).select(
        "teacher",
        "total_presentations",
        labels.usage_label(F.col("total_presentations"), F.col("total_students")).alias(
            "usage_label"
        ),
    )


@register
def status_label(r: Roles) -> DataFrame:
    statuses = cohort.first_last_status(r.launch_presentation(), _cohort(r), STUDY.status[:1])
    return assemble(_labelled_totals(r), statuses).select(
        "teacher",
        labels.status_label(
            F.col("total_presentations"), F.col("total_students"), F.col("status_last")
        ).alias("status_label"),
    )


@register
def audience_label(r: Roles) -> DataFrame:
    return features.audience(_labelled_totals(r)).select(
        "teacher", "audience_presentations", "testing_presentations", "audience_label"
    )


@register
def status_pair_counts(r: Roles) -> DataFrame:
    statuses = cohort.first_last_status(r.launch_presentation(), _cohort(r), STUDY.status[:1])
    return explore.count_by(statuses.distinct(), "status_first", "status_last")


@register
def feature_mart(r: Roles) -> DataFrame:
    return _mart(r)


@register
def feature_mart_older(r: Roles) -> DataFrame:
    return _mart(r, OLDER_STUDY)


def _profile(r: Roles) -> DataFrame:
    return events.event_profile(
        r.customer_events(), _cohort(r), INITIAL, r.event_dictionary(), CATEGORIES
    )


def _model_table(r: Roles) -> DataFrame:
    participated = adoption.participated_before_presenting(
        r.student_responded(), r.user_facts(), ROLE
    )
    return mart.model_table(STUDY, _mart(r), participated, _profile(r))


@register
def model_table(r: Roles) -> DataFrame:
    return _model_table(r)


# --- exploration ------------------------------------------------------------------------


@register
def count_by_label(r: Roles) -> DataFrame:
    return explore.count_by(
        _sessions(r).withColumns(
            {
                "label": labels.bucket_label(F.col("num_students"), BUCKETS_6),
                "position": labels.bucket_order(F.col("num_students"), BUCKETS_6),
            }
        ),
        "label",
        "position",
    )


@register
def month_stats_with_zeros(r: Roles) -> DataFrame:
    return explore.month_stats(
        reshape.lengthen(_months_wide(r), ["teacher"], MONTHS, "year_month", "num_presentations")
    )


@register
def month_stats_no_zeros(r: Roles) -> DataFrame:
    return explore.month_stats(_sessions(r))


@register
def week_stats(r: Roles) -> DataFrame:
    return explore.week_stats(_sessions(r, by_presentation=False))


@register
def week_stats_per_presentation(r: Roles) -> DataFrame:
    return explore.week_stats(_sessions(r))


@register
def histogram(r: Roles) -> DataFrame:
    counted = _sessions(r)
    narrow = explore.histogram(counted, "num_students", 1, (0, 10)).withColumn("width", F.lit(1))
    wide = explore.histogram(counted, "num_students", 5).withColumn("width", F.lit(5))
    return narrow.unionByName(wide)


@register
def facet_share(r: Roles) -> DataFrame:
    later = mart.feature_mart(
        STUDY,
        _cohort(r),
        r.user_facts(),
        r.slide_presented(),
        r.student_responses(),
        r.launch_presentation(),
    ).filter(F.col("period") == "later")
    return explore.facet_share(later, "usage_label", "total_presentations")


@register
def facet_share_initial(r: Roles) -> DataFrame:
    active = _model_table(r).filter(
        ~F.col("usage_label_initial").isin(labels.NEVER_USED, labels.TESTED_ONLY)
    )
    return explore.facet_share(active, "usage_label_later", "total_presentations")


@register
def scatter_points(r: Roles) -> DataFrame:
    return explore.scatter(
        _model_table(r), "slide_diversity", "presentations_later", "usage_label_later"
    )


@register
def scatter_sample(r: Roles) -> DataFrame:
    return explore.scatter(
        _model_table(r), "slide_diversity", "presentations_later", "usage_label_later", sample=100
    )


# --- preparation ------------------------------------------------------------------------


@register
def missing_cells(r: Roles) -> DataFrame:
    return frames.missing_cells(_labelled_totals(r))


@register
def complete_cases(r: Roles) -> DataFrame:
    return frames.complete_cases(_labelled_totals(r)).select(
        "teacher", "total_presentations", "total_students"
    )


@register
def dummies(r: Roles) -> DataFrame:
    labelled = features.audience(_labelled_totals(r)).select(
        "teacher", "total_presentations", "audience_presentations", "audience_label"
    )
    levels = {"audience_label": presets.CATEGORICAL_LEVELS["audience_label"]}
    return reshape.label_last(
        labelled,
        "audience_presentations",
        drop=["no_such_column"],
        categoricals=levels,
        base_cases=["audience_label_None"],
    )


def _correlations(r: Roles) -> DataFrame:
    columns = ["total_presentations", "total_students", "months_used", "n_testing", "n_low"]
    kept = frames.complete_cases(
        without_ids(_totals(r, BUCKETS_5), "teacher", r.excluded_users(), "hashed_coach_id")
    )
    return frames.correlations(kept, columns).withColumn("r", F.round("r", 6))


@register
def correlation_long(r: Roles) -> DataFrame:
    return _correlations(r)


@register
def correlation_file(r: Roles) -> DataFrame:
    path = _scratch_file(r, "correlations")
    tables.write_result(_correlations(r), path, "csv")
    return r.spark.read.schema("a string, b string, r double").option("header", True).csv(path)


@register
def correlation_screen(r: Roles) -> DataFrame:
    rows, numeric = presets.screening_frame(_model_table(r), r.excluded_users())
    return frames.correlations(rows, numeric).withColumn("r", F.round("r", 6))


def _documents_and_labels(r: Roles) -> DataFrame:
    return r.table("documents").select("doc_id", "n_chars").join(r.table("labels"), "doc_id", "left")


@register
def stratified_split_unknown(r: Roles) -> DataFrame:
    split = prep.stratified_split(_documents_and_labels(r), "quality", "doc_id")
    return explore.count_by(split, "quality", "split")


@register
def upsample_unknown(r: Roles) -> DataFrame:
    grown = prep.upsample(_documents_and_labels(r), "quality", "doc_id")
    return grown.groupBy("quality").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("documents")
    )


def _labelled_documents(r: Roles) -> DataFrame:
    return r.table("labels").join(r.table("documents").select("doc_id", "n_chars"), "doc_id")


@register
def stratified_split(r: Roles) -> DataFrame:
    split = prep.stratified_split(_labelled_documents(r), "quality", "doc_id")
    return explore.count_by(split, "quality", "split")


@register
def stratified_split_numeric(r: Roles) -> DataFrame:
    binned = prep.quantile_strata(r.table("customer"), "c_acctbal")
    return explore.count_by(prep.stratified_split(binned, "stratum", "c_custkey"), "stratum", "split")


@register
def class_balance(r: Roles) -> DataFrame:
    split = prep.stratified_split(_labelled_documents(r), "quality", "doc_id")
    return prep.class_balance(split, "quality")


@register
def upsample(r: Roles) -> DataFrame:
    grown = prep.upsample(_labelled_documents(r), "quality", "doc_id")
    return grown.groupBy("quality").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("documents")
    )


# --- models -----------------------------------------------------------------------------


def _model_rows(r: Roles, preset: presets.Preset) -> tuple[DataFrame, list[str]]:
    # the plan behind the table is long and every model step reads it again
    table = checkpointed(_model_table(r))
    return presets.model_frame(table, preset, r.excluded_users())


def _split_rows(r: Roles, preset: presets.Preset) -> tuple[DataFrame, DataFrame, list[str]]:
    rows, names = _model_rows(r, preset)
    train, held_out = presets.split_frame(rows, preset)
    return train, held_out, names


@register
def vif_alias(r: Roles) -> DataFrame:
    preset = presets.PRESETS["used_later"].keeping_collinear()
    train, _, names = _split_rows(r, preset)
    return models.collinearity(r.spark, train, names, "label", preset.family)


@register
def logit_backward(r: Roles) -> DataFrame:
    preset = presets.PRESETS["used_later"]
    train, held_out, names = _split_rows(r, preset)
    result = models.backward(train, names, "label", preset.family, preset.level)
    return models.score(result, held_out).select("teacher", "label", "prediction")


@register
def odds_ratios(r: Roles) -> DataFrame:
    preset = presets.PRESETS["premium_later"]
    train, _, names = _split_rows(r, preset)
    result = models.backward(train, names, "label", preset.family, preset.level)
    return models.coefficients(r.spark, result)


@register
def linear_backward(r: Roles) -> DataFrame:
    preset = presets.PRESETS["presentations_later"]
    train, held_out, names = _split_rows(r, preset)
    result = models.backward(train, names, "label", preset.family, preset.level)
    return evaluate.rmse(models.score(result, held_out), "label")


@register
def free_later_terms(r: Roles) -> DataFrame:
    return _terms(r, "free_later")


@register
def premiumtrial_later_terms(r: Roles) -> DataFrame:
    return _terms(r, "premiumtrial_later")


def _terms(r: Roles, name: str) -> DataFrame:
    preset = presets.PRESETS[name]
    train, _, names = _split_rows(r, preset)
    result = models.backward(train, names, "label", preset.family, preset.level)
    return models.coefficients(r.spark, result)


@register
def held_out_evaluation(r: Roles) -> DataFrame:
    preset = presets.PRESETS["used_later"]
    train, held_out, names = _split_rows(r, preset)
    result = models.backward(train, names, "label", preset.family, preset.level)
    sweep = evaluate.cutoff_sweep(models.score(result, held_out), "prediction", "label")
    best = evaluate.best_cutoff(sweep).select("cutoff", "accuracy", "precision", "recall", "f1")
    return best.join(evaluate.auc(sweep), F.lit(True))


@register
def picked_split(r: Roles) -> DataFrame:
    split = prep.stratified_split(_labelled_documents(r), "quality", "doc_id")
    parts = [
        part.withColumn("split", F.lit(name))
        for validate, held in ((False, prep.TEST), (True, prep.VALIDATION))
        for part, name in zip(prep.pick_split(split, validate), (prep.TRAIN, held))
    ]
    # the training rows come with either choice of the held-out ones
    rows = parts[0].unionByName(parts[1]).unionByName(parts[3])
    return explore.count_by(rows, "quality", "split")


def _balances(r: Roles) -> DataFrame:
    columns = ("c_acctbal", "c_nationkey", "c_custkey")
    return r.table("customer").select(*[F.col(c).cast("double").alias(c) for c in columns])


@register
def linear_line(r: Roles) -> DataFrame:
    fitted = models.fit(_balances(r), ["c_nationkey"], "c_acctbal", "gaussian").model
    line = [(round(float(fitted.coefficients[0]), 3), round(float(fitted.intercept), 1))]
    return r.spark.createDataFrame(line, "slope double, intercept double")


@register
def inflation_of_two(r: Roles) -> DataFrame:
    found = models.collinearity(
        r.spark, _balances(r), ["c_nationkey", "c_custkey"], "c_acctbal", "gaussian"
    )
    return found.select("term", F.round("vif", 6).alias("vif"), "is_aliased")


@register
def logit_score_equations(r: Roles) -> DataFrame:
    rows = _labelled_documents(r).select(
        F.col("quality").cast("double").alias("label"),
        F.log1p(F.col("n_chars").cast("double")).alias("log_chars"),
        (F.col("n_chars") % 7).cast("double").alias("chars_mod_7"),
    )
    names = ["log_chars", "chars_mod_7"]
    scored = models.score(models.fit(rows, names, "label", "binomial"), rows)
    error = F.col("label") - F.col("prediction")
    sums = [F.avg(error * F.col(n)).alias(n) for n in names]
    wide = scored.agg(*sums, F.avg(error).alias("(Intercept)"))
    long = wide.unpivot([], [*names, "(Intercept)"], "term", "score")
    return long.select("term", (F.abs("score") < 1e-6).alias("is_zero"))


@register
def kmeans_assign(r: Roles) -> DataFrame:
    rows, names = _model_rows(r, presets.PRESETS["clusters"])
    return models.clusters(rows, names).select("teacher", "cluster")


@register
def kmeans_check(r: Roles) -> DataFrame:
    columns = ["c_acctbal", "c_nationkey", "c_custkey"]
    report = models.cluster_report(_balances(r), columns)
    return report.agg(
        F.count(F.lit(1)).alias("clusters"),
        F.sum("rows").alias("rows"),
        F.sum("nearer_to_another").alias("nearer_to_another"),
        (F.sum("within") < F.lit(float(len(columns))) * F.sum("rows")).alias("closer_than_to_the_mean"),
    )


@register
def preset_columns(r: Roles) -> DataFrame:
    table = checkpointed(_model_table(r))
    parts = []
    for preset in presets.PRESETS.values():
        rows, names = presets.model_frame(table, preset, r.excluded_users())
        kept = [*names, *(["label"] if preset.label else [])]
        sums = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(f"`{c}`").cast("double")).alias(c) for c in kept])
        long = sums.unpivot(["rows"], [F.col(f"`{c}`") for c in kept], "term", "total")
        parts.append(long.select(F.lit(preset.name).alias("preset"), "term", "rows", F.round("total", 4).alias("total")))
    return reduce(DataFrame.unionByName, parts)


@register
def aliased_columns(r: Roles) -> DataFrame:
    rows = _balances(r).select(
        "c_nationkey",
        "c_custkey",
        (F.col("c_nationkey") * 2 - 3).alias("affine"),
        (F.col("c_custkey") / 7 + F.col("c_nationkey")).alias("combined"),
        F.lit(4.0).alias("constant"),
        # so near to the key that cross products cannot tell them apart
        (F.col("c_custkey") + F.col("c_acctbal") * 1e-7).alias("near_copy"),
        "c_acctbal",
    )
    names = [c for c in rows.columns if c != "c_acctbal"]
    found = models.collinearity(r.spark, rows, names, "c_acctbal", "gaussian")
    return found.select("term", "is_aliased")


@register
def linear_elimination(r: Roles) -> DataFrame:
    fitted = models.backward(_balances(r), ["c_nationkey", "c_custkey"], "c_acctbal", "gaussian", 0.05)
    steps = [(name, i, True) for i, (name, _) in enumerate(fitted.dropped, start=1)]
    steps += [(name, None, False) for name in fitted.features]
    return r.spark.createDataFrame(steps, "term string, step int, dropped boolean")


def _odd_lengths(r: Roles) -> DataFrame:
    odd = (F.col("n_chars") % 2).cast("double")
    return _labelled_documents(r).select("doc_id", F.col("quality").alias("label"), odd.alias("odd"))


def _odd_fit(r: Roles) -> models.Fit:
    return models.backward(_odd_lengths(r), ["odd"], "label", "binomial", 0.15)


@register
def flag_odds(r: Roles) -> DataFrame:
    found = models.coefficients(r.spark, _odd_fit(r))
    numbers = [F.round(c, 6).alias(c) for c in ("coefficient", "odds_ratio")]
    return found.select("term", *numbers, (F.col("p_value") <= 0.05).alias("significant"))


@register
def flag_scores(r: Roles) -> DataFrame:
    scored = models.score(_odd_fit(r), _odd_lengths(r))
    return scored.groupBy("odd").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("prediction"), 8).alias("prediction"))


@register
def order_statistics(r: Roles) -> DataFrame:
    chances = [i / 20 for i in range(21)]
    values = ranking.exact_quantiles(r.table("documents"), "n_chars", chances)
    return r.spark.createDataFrame(list(zip(chances, values)), "chance double, value double").withColumn("value", F.round("value", 6))


# --- evaluation -------------------------------------------------------------------------


def _scored(r: Roles) -> DataFrame:
    length = F.col("n_chars").cast("double")
    return _labelled_documents(r).withColumn("score", length / (length + 1000.0))


@register
def cutoff_sweep(r: Roles) -> DataFrame:
    return evaluate.cutoff_sweep(_scored(r), "score", "quality")


@register
def best_cutoff(r: Roles) -> DataFrame:
    return evaluate.best_cutoff(evaluate.cutoff_sweep(_scored(r), "score", "quality"))


@register
def auc(r: Roles) -> DataFrame:
    return evaluate.auc(evaluate.cutoff_sweep(_scored(r), "score", "quality"))
