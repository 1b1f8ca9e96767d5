"""Events stored by time, user and presentation: the same sessions, without an exchange."""

import uuid
from datetime import date

import pytest

from stayline.functions.periods import Period
from stayline.operators import activity
from stayline.operators.cohort import Cohort
from stayline.sources import stored
from tests.conftest import rows

PERIODS = [Period("initial", 0, 1), Period("later", 0, 1, 12)]
APP = "%flash%"


@pytest.fixture(scope="module")
def events(tables):
    """A user with a third of all slides, slides without id or answer, events without a time."""
    slides, answers = [], []
    for k in range(240):
        user = "hot" if k % 3 == 0 else f"u{k % 7}"
        time = f"201{8 + k % 2}-0{8 + k % 2}-{10 + k % 17} {k % 5 + 8:02d}:00:00"
        shown = None if k % 11 == 0 else f"s{k % 13}"
        slides.append((user, f"p{k // 4}", shown, "text", time))
        for student in range(k % 4):
            app = "flash cards" if (k + student) % 9 == 0 else None if k % 31 == 0 else "web"
            who = None if (k + student) % 17 == 0 else f"st{student}"
            answers.append((user, who, f"p{k // 4}", shown, app, time))
    users = [(u, "2018-08-06T10:00", "teacher") for u in ("hot", "u1", "u2", "u5")]
    users += [("u3", "2018-08-06T10:00", "student")]
    cohort = Cohort.select(tables.users(*users), date(2018, 8, 5), date(2018, 8, 18), "student")
    undated = tables.make("slide_presented", [("hot", "p0", "s0", "text", None)])
    return cohort, tables.slides(*slides).unionByName(undated), tables.responses(*answers)


def pulled(spark, events, span, buckets=4):
    cohort, slides, answers = events
    names = [f"{kind}_{uuid.uuid4().hex}" for kind in ("slides", "answers")]
    stored.store_events(slides, names[0], ["user_id", "presentation_id"], buckets, span)
    stored.store_events(answers, names[1], ["teacher", "presentation"], buckets, span)
    spans = [p.span(cohort.first_from, cohort.first_to) for p in PERIODS]
    first, last = min(s[0] for s in spans), max(s[1] for s in spans)
    return [stored.stored_events(spark, n, first, last, span) for n in names], names


@pytest.mark.parametrize("span", ["day", "month", "year"])
def test_sessions_of_stored_events_are_the_same(spark, events, span):
    cohort, slides, answers = events
    (shown, given), _ = pulled(spark, events, span)
    plain = activity.sessions(slides, answers, cohort, PERIODS, APP)
    with stored.co_partitioned(spark):
        got = rows(activity.sessions_in_place(shown, given, cohort, PERIODS, APP), *plain.columns)
    assert got == rows(plain) and len(got) > 30


def test_no_event_is_exchanged(spark, events):
    (shown, given), _ = pulled(spark, events, "month")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with stored.co_partitioned(spark):
            built = activity.sessions_in_place(shown, given, events[0], PERIODS, APP)
            plan = built._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
    assert "PartitionFilters: [isnotnull(_part" in plan


def test_later_events_are_added_and_undated_kept(spark, events):
    _, names = pulled(spark, events, "day")
    n = spark.table(names[0]).count()
    assert spark.table(names[0]).where("timestamp IS NULL").count() == 1
    stored.store_events(events[1].limit(10), names[0], ["user_id", "presentation_id"], 4, "day", mode="append")
    assert spark.table(names[0]).count() == n + 10
    day = stored.stored_events(spark, names[0], date(2018, 8, 10), date(2018, 8, 10))
    assert {r.timestamp.date() for r in day.collect()} == {date(2018, 8, 10)}


def test_empty_events_and_wrong_spans(spark, events):
    name = f"none_{uuid.uuid4().hex}"
    stored.store_events(events[1].limit(0), name, ["user_id", "presentation_id"], 4)
    assert stored.stored_events(spark, name, date(2018, 1, 1), date(2020, 1, 1)).count() == 0
    with pytest.raises(ValueError, match="span"):
        stored.store_events(events[1], name, ["user_id"], 4, "week")


def test_the_setting_is_put_back(spark):
    before = spark.conf.get(stored.CO_PARTITIONED)
    with pytest.raises(RuntimeError), stored.co_partitioned(spark):
        assert spark.conf.get(stored.CO_PARTITIONED) == "false"
        raise RuntimeError
    assert spark.conf.get(stored.CO_PARTITIONED) == before
