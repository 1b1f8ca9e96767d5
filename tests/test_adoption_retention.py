from datetime import date

import pytest
from pyspark.sql import functions as F

from stayline.functions.periods import Period
from stayline.operators import adoption, events, retention
from stayline.operators.cohort import Cohort
from tests.conftest import one, rows, ts

START, END = (date(2018, 1, 1), date(2018, 8, 1)), (date(2019, 1, 1), date(2019, 6, 1))


def users(tables):
    return tables.users(
        ("a", "2018-01-01T00:00", "teacher", ts("2019-09-01T00:00"), False, False, "x"),
        ("b", "2018-01-01T00:00", "teacher", ts("2019-09-01T00:00"), True, False, "x"),
        ("c", "2018-01-01T00:00", "teacher", ts("2019-09-01T00:00"), True, True, "y"),
        ("d", "2018-01-01T00:00", "teacher", ts("2019-09-01T00:00"), False, True, "y"),
        ("e", "2018-01-01T00:00", "teacher", ts("2019-07-01T00:00"), False, False, "y"),
    )


def test_recent_users_need_a_status(tables):
    got = adoption.recent_users(users(tables), date(2019, 8, 1))
    assert rows(got) == [("a", "free", "x"), ("b", "premium", "x"), ("c", "premiumtrial", "y")]


def counted(tables):
    slides = tables.slides(
        ("a", "p", "s", "text", "2019-08-02T00:00"),
        ("b", "p", "s", "draw", "2019-08-02T00:00"),
        ("b", "p", "s", "drag", "2019-08-03T00:00"),
        ("b", "p", "s", "drag", "2019-08-04T00:00"),
        ("c", "p", "s", "drag", "2019-08-04T00:00"),  # only one of the two
        ("a", "p", "s", "drag", "2019-07-04T00:00"),  # too early
    )
    return adoption.feature_counts(slides, date(2019, 8, 1), {"draws": "draw", "drags": "drag"})


def test_feature_groups_are_not_complements(tables):
    recent = adoption.recent_users(users(tables), date(2019, 8, 1))
    neither = adoption.feature_users(counted(tables), recent, "neither")
    both = adoption.feature_users(counted(tables), recent, "all")
    assert rows(neither) == [("a", 0, 0, "free")]
    assert rows(both) == [("b", 1, 2, "premium")]
    with pytest.raises(ValueError):
        adoption.feature_users(counted(tables), recent, "some")


def test_sums_over_non_users_are_zero(tables):
    recent = adoption.recent_users(users(tables), date(2019, 8, 1))
    neither = adoption.feature_users(counted(tables), recent, "neither")
    assert rows(adoption.feature_sums_by_status(neither, ["draws", "drags"])) == [("free", 0, 0)]
    both = adoption.feature_users(counted(tables), recent, "all")
    assert rows(adoption.feature_sums_by_status(both, ["draws", "drags"])) == [("premium", 1, 2)]


def test_adopters_and_non_adopters_cover_the_users(tables):
    clicks = tables.make(
        "presenter_button_clicked",
        [
            ("a", "ask", ts("2019-08-01T00:00")),
            ("a", "ask", ts("2019-12-01T00:00")),  # the last moment counts
            ("b", "ask", ts("2019-12-01T00:01")),  # one minute later does not
            ("c", "other", ts("2019-09-01T00:00")),
            (None, "ask", ts("2019-09-01T00:00")),
        ],
    )
    chosen = adoption.button_clicks(clicks, "ask", date(2019, 8, 1), date(2019, 12, 1))
    recent = adoption.recent_users(users(tables), date(2019, 8, 1))
    used, unused = adoption.adopters(chosen, recent), adoption.non_adopters(chosen, recent)
    assert rows(used, "external_id", "account_status") == [("a", "free"), ("a", "free")]
    ids = {r[0] for r in rows(used, "external_id")}, {r[0] for r in rows(unused, "external_id")}
    assert ids[0] | ids[1] == {r[0] for r in rows(recent, "external_id")}
    assert not ids[0] & ids[1]
    assert rows(adoption.users_by_status(unused, "external_id")) == [
        ("premium", 1),
        ("premiumtrial", 1),
    ]


def test_participated_before(tables):
    responded = tables.responded(
        ("a", "b", "p", "2018-01-05T00:00"),
        ("b", "a", "p", "2018-01-06T00:00"),
        ("c", "x", "p", "2018-01-01T00:00"),
        ("a", "c", "p", "2018-01-01T00:00"),  # same moment is not before
        ("s", "q", "p", "2018-03-01T00:00"),
        ("a", "s", "p", "2018-02-01T00:00"),  # a student by role
        ("a", None, "p", "2018-02-01T00:00"),
        (None, "q", "p", "2018-02-01T00:00"),
    )
    people = tables.users(
        ("a", None, "teacher"), ("b", None, "teacher"), ("c", None, "teacher"), ("s", None, "student")
    )
    got = adoption.participated_before_presenting(responded, people, "student")
    assert rows(got) == [("b", ts("2018-01-05T00:00"), ts("2018-01-06T00:00"), 1)]


def active(tables):
    return tables.responded(
        ("a", "x", "p1", "2018-01-31T00:00"),
        ("a", "x", "p2", "2018-08-31T00:00"),  # August counts by month
        ("b", "x", "p3", "2018-09-01T00:00"),
        ("a", "x", "p4", "2019-02-01T00:00"),
        ("c", "x", "p5", "2018-03-01T00:00"),
        ("c", "x", "p5", "2018-03-02T00:00"),
        ("d", "x", "p6", "2019-06-30T23:00"),
        (None, "x", "p7", "2019-06-30T23:00"),
    )


def clicks(tables, *ids):
    return tables.make(
        "presenter_button_clicked", [(i, "ask", ts("2018-02-01T00:00")) for i in ids]
    ).select("user_id", "timestamp")


def test_churn_counts(tables):
    got = one(
        retention.churn_retention(active(tables), clicks(tables, "a", "a", "c", "d"), START, END)
    )
    assert got == {
        "churn_rate": 0.5,
        "retention_rate": 0.5,
        "n_start": 2,
        "n_end": 2,  # everybody active later, not only the cohort
        "n_churn": 1,
    }


def test_churn_of_an_empty_cohort_has_no_rate(tables):
    got = one(retention.churn_retention(active(tables), clicks(tables, "zz"), START, END))
    assert got["churn_rate"] is None and got["retention_rate"] is None
    assert (got["n_start"], got["n_end"], got["n_churn"]) == (0, 2, 0)


def test_activity_months(tables):
    assert rows(retention.active_in_months(active(tables), START)) == [
        (date(2018, 1, 1), "a"),
        (date(2018, 3, 1), "c"),
        (date(2018, 8, 1), "a"),
    ]
    often = retention.presentations_per_user(
        active(tables), (date(2018, 1, 1), date(2018, 9, 1)), more_than=1
    )
    assert rows(often) == [("a", 2)]


def test_event_profile_counts_overlaps_and_keeps_unmatched(spark, tables):
    people = tables.users(("a", "2018-08-05T10:00", "t"), ("b", "2018-08-05T10:00", "t"),
                          ("c", "2018-08-05T10:00", "t"))
    members = Cohort.select(people, date(2018, 8, 1), date(2018, 8, 31), "student")
    log = tables.make(
        "app_events",
        [
            ("a", "open", ts("2018-08-06T00:00")),
            ("a", "open", ts("2018-08-07T00:00")),
            ("a", "vote", ts("2018-08-07T00:00")),
            ("a", "vote", ts("2019-08-07T00:00")),
            ("b", "unknown", ts("2018-08-07T00:00")),
            ("b", None, ts("2018-08-07T00:00")),
        ],
    )
    words = tables.make(
        "event_dictionary",
        [("teacher", "open"), ("before", "open"), ("student", "vote"), ("teacher", "open")],
    )
    for small in (True, False):
        cohort = Cohort(members.members, members.first_from, members.first_to, small)
        got = events.event_profile(
            log, cohort, Period("initial", 0, 3), words, ["teacher", "student", "before"]
        )
        # two opens count for two categories each, one vote for one: 2 + 1 + 2
        assert rows(got) == [("a", 0.4, 0.2, 0.4), ("b", None, None, None)]
        total = got.filter("teacher = 'a'").select(
            F.expr("teacher_prop + student_prop + before_prop")
        ).first()[0]
        assert total == pytest.approx(1.0)
