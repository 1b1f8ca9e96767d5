from datetime import date

import pytest
from pyspark.sql import functions as F

from stayline.functions.periods import Period
from stayline.operators import activity, cohort, joins
from stayline.operators.cohort import Cohort
from tests.conftest import rows, ts

RANGE = (date(2018, 8, 1), date(2018, 8, 31))
INITIAL, LATER = Period("initial", 0, 3), Period("later", 0, 3, 12)
AFTER_TRIAL = Period("initial", 1, 3)


@pytest.fixture(params=[True, False], ids=["broadcast", "salted"])
def members(request, tables):
    users = tables.users(
        ("a", "2018-08-05T10:00", "teacher"),
        ("b", "2018-08-31T23:59", "teacher"),
        ("c", "2018-08-10T00:00", "teacher"),
        ("s", "2018-08-10T00:00", "student"),
        ("n", "2018-08-10T00:00", None),
        ("early", "2018-07-31T23:59", "teacher"),
        ("late", "2018-09-01T00:00", "teacher"),
    )
    frame = cohort.cohort_members(users, *RANGE, "student")
    return Cohort(frame, *RANGE, small=request.param)


def test_cohort_takes_whole_days_and_known_roles(members):
    assert [r[0] for r in rows(members.members, "teacher")] == ["a", "b", "c"]


def test_select_counts_the_members(tables):
    users = tables.users(("a", "2018-08-05T10:00", "teacher"))
    assert Cohort.select(users, *RANGE, "student").small


def test_in_periods_tags_and_drops(members, tables):
    events = tables.launches(
        ("a", "2018-08-05T00:00", "x"),  # same day, before the first second: still inside
        ("a", "2018-11-05T23:59", "x"),  # last day
        ("a", "2018-11-06T00:00", "x"),  # one day after
        ("a", "2019-08-05T00:00", "x"),  # year later, first day
        ("a", None, "x"),
        ("zz", "2018-08-06T00:00", "x"),  # not in the cohort
    )
    got = cohort.in_periods(events, "user_id", members, [INITIAL, LATER])
    assert rows(got, "teacher", "period", "date") == [
        ("a", "initial", date(2018, 8, 5)),
        ("a", "initial", date(2018, 11, 5)),
        ("a", "later", date(2019, 8, 5)),
    ]


def test_overlapping_periods_count_a_row_twice(members, tables):
    events = tables.launches(("a", "2018-09-05T00:00", "x"))
    both = [Period("p", 0, 3), Period("q", 1, 3)]
    got = cohort.in_periods(events, "user_id", members, both)
    assert rows(got, "period") == [("p",), ("q",)]


def test_first_last_status_keeps_idle_members_only(members, tables):
    launches = tables.launches(
        ("a", "2018-08-06T00:00", "free"),  # before the window starts
        ("a", "2018-09-05T08:00", "free"),
        ("a", "2018-10-01T08:00", "premiumTrial"),
        ("a", "2018-11-05T08:00", "Premium"),
        ("b", "2020-01-01T00:00", "free"),  # active, never inside
    )
    got = cohort.first_last_status(launches, members, [AFTER_TRIAL])
    assert rows(got) == [
        ("initial", "a", ts("2018-09-05T08:00"), ts("2018-11-05T08:00"), "free", "premium"),
        ("initial", "c", None, None, None, None),
    ]


def test_status_ties_and_unknown_status(members, tables):
    launches = tables.launches(
        ("a", "2018-10-01T08:00", "premium"),
        ("a", "2018-10-01T08:00", "free"),
        ("a", "2018-10-01T08:00", None),
        ("b", "2018-10-02T08:00", None),
        ("c", None, "free"),  # undated: counts as never launched
    )
    got = cohort.first_last_status(launches, members, [AFTER_TRIAL])
    assert rows(got, "teacher", "status_first", "status_last") == [
        ("a", "free", "premium"),
        ("b", None, None),
        ("c", None, None),
    ]


def test_status_rows_are_the_ends(members, tables):
    launches = tables.launches(
        ("a", "2018-09-05T08:00", "free"),
        ("a", "2018-09-05T08:00", "free"),
        ("a", "2018-10-01T08:00", "other"),
        ("a", "2018-11-05T08:00", "premium"),
    )
    got = cohort.status_rows(launches, members, AFTER_TRIAL)
    assert rows(got, "timestamp", "account_status_min", "account_status_max") == [
        (ts("2018-09-05T08:00"), "free", None),
        (ts("2018-11-05T08:00"), None, "premium"),
    ]


def test_account_later_recodes(tables):
    users = tables.users(
        ("a", "2018-08-05T10:00", "teacher", None, False, None, "individual - synthetic"),
        ("b", "2018-08-05T10:00", "teacher", None, False, True, "school"),
    )
    got = cohort.account_later(
        users, *RANGE, "student", recode=("individual - synthetic", "individual")
    )
    assert rows(got) == [("a", "free", "individual"), ("b", None, "school")]


SLIDES = [
    # the same slide twice in one hour, and a slide without an id
    ("a", "p1", "s1", "draw", "2018-08-06T09:05"),
    ("a", "p1", "s1", "draw", "2018-08-06T09:50"),
    ("a", "p1", "s2", "text", "2018-08-06T09:10"),
    ("a", "p1", None, "text", "2018-08-06T09:15"),
    ("a", "p1", "s1", "draw", "2018-08-06T10:00"),
    ("a", "p2", "s1", "draw", "2018-08-06T09:30"),
    ("a", None, "s1", "draw", "2018-08-06T11:30"),
    ("c", "p3", None, "draw", "2018-08-11T09:30"),
    ("c", "p4", "s1", "draw", "2019-08-11T09:30"),
]
RESPONSES = [
    ("a", "x", "p1", "s1", "web", "2018-08-06T09:06"),
    ("a", "x", "p1", "s1", "web", "2018-08-06T09:07"),
    ("a", "y", "p1", "s1", "web", "2018-08-06T09:07"),
    ("a", "x", "p1", "s2", "web", "2018-08-06T09:12"),
    ("a", None, "p1", "s2", "web", "2018-08-06T09:12"),
    ("a", "z", "p1", None, "web", "2018-08-06T09:12"),  # NULL slide matches nothing
    ("a", "w", "p1", "s1", "a flash app", "2018-08-06T09:12"),  # special app
    ("a", "v", "p1", "s1", None, "2018-08-06T09:12"),  # unknown app is rejected too
    ("a", "u", "p2", "s1", "web", "2018-08-06T10:12"),  # another hour
    ("c", "x", "p4", "s1", "web", "2019-08-11T09:35"),
]


def test_sessions_by_presentation(members, tables):
    got = activity.sessions(
        tables.slides(*SLIDES), tables.responses(*RESPONSES), members, [INITIAL], "%flash%"
    )
    columns = ["teacher", "presentation_id", "hour", "num_presentations", "num_students"]
    assert rows(got, *columns, "num_responses", "year_month") == [
        ("a", "p1", 10, 1, 0, 0, "2018-08"),
        # s1: three answers by two students, shown twice; s2: one known student
        ("a", "p1", 9, 1, 2, 2 * 3 + 1, "2018-08"),
        ("a", "p2", 9, 1, 0, 0, "2018-08"),
        ("a", None, 11, 0, 0, 0, "2018-08"),
        ("c", "p3", 9, 1, 0, 0, "2018-08"),
    ]


def test_sessions_by_hour_over_two_periods(members, tables):
    got = activity.sessions(
        tables.slides(*SLIDES),
        tables.responses(*RESPONSES),
        members,
        [INITIAL, LATER],
        "%flash%",
        by_presentation=False,
    )
    columns = ["period", "teacher", "hour", "num_presentations", "num_students", "num_responses"]
    assert rows(got, *columns) == [
        ("initial", "a", 10, 1, 0, 0),
        ("initial", "a", 11, 0, 0, 0),
        ("initial", "a", 9, 2, 2, 7),
        ("initial", "c", 9, 1, 0, 0),
        ("later", "c", 9, 1, 1, 1),
    ]


def test_sessions_in_range_leave_recent_users_out(tables):
    users = tables.users(("c", "2018-09-01T00:00", "teacher"), (None, "2019-01-01T00:00", "x"))
    got = activity.sessions_in_range(
        tables.slides(*SLIDES),
        tables.responses(*RESPONSES),
        users,
        date(2018, 8, 1),
        date(2018, 8, 31),
        date(2018, 9, 1),
        "%flash%",
    )
    assert rows(got, "teacher", "hour", "num_presentations", "num_students") == [
        ("a", 10, 1, 0),
        ("a", 11, 0, 0),
        ("a", 9, 2, 2),
    ]


def test_slide_types_count_a_slide_once_an_hour(members, tables):
    got = activity.slide_type_counts(tables.slides(*SLIDES), members, [INITIAL])
    assert rows(got, "teacher", "slide_type", "slide_type_count") == [
        ("a", "draw", 4),
        ("a", "text", 2),
        ("c", "draw", 1),
    ]


def test_special_app(members, tables):
    got = activity.special_app_use(tables.responses(*RESPONSES), members, INITIAL, "%flash%")
    assert rows(got) == [("a", 1, 1)]


def test_facts_of_responders(tables):
    users = tables.users(("a", "2018-08-05T10:00", "teacher"), ("q", "2018-08-05T10:00", "teacher"))
    got = activity.facts_of_responders(
        users, tables.responses(*RESPONSES), ["external_id", "profile_role"], "%flash%"
    )
    assert rows(got) == [("a", "teacher")]


def test_without_ids_ignores_null_and_foreign_ids(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    ids = spark.createDataFrame([("2",), (None,), ("not a number",)], "id string")
    for small in (True, False):
        assert rows(joins.without_ids(df, "k", ids, "id", small)) == [(1,)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    facts = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 20).alias("k"), "id"
    )
    lookup = spark.range(0, 15).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = facts.join(lookup, ["k"], how)
    for small in (True, False):
        assert rows(joins.lookup_join(facts, lookup, ["k"], how, small)) == rows(plain)


def test_fits_broadcast(spark):
    assert joins.fits_broadcast(spark.range(3), 3 * joins.row_bytes(spark.range(1)))
    assert not joins.fits_broadcast(spark.range(4), 3 * joins.row_bytes(spark.range(1)))


def test_duplicate_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "teacher string")
    assert rows(joins.duplicate_keys(df)) == [("a", 2)]


def test_a_user_with_two_rows_is_refused(tables):
    users = tables.users(("a", "2018-08-05T10:00", "teacher"), ("a", "2018-08-06T10:00", "teacher"))
    with pytest.raises(ValueError, match="several rows"):
        Cohort.select(users, date(2018, 8, 5), date(2018, 8, 18), "student")
