from datetime import date

import pytest
from pyspark.sql import functions as F

from stayline.functions.labels import ENGAGEMENT_5
from stayline.functions.periods import Period
from stayline.operators import features, frames
from stayline.plans import mart
from tests.conftest import one, rows, ts

SESSIONS = "teacher string, date date, year_month string, num_presentations long, " \
    "num_students long, num_responses long"


def totals(spark, data, buckets=ENGAGEMENT_5):
    sessions = spark.createDataFrame(
        [(t, date.fromisoformat(d), d[:7], p, s, n) for t, d, p, s, n in data], SESSIONS
    )
    months = features.month_totals(sessions, buckets, ["teacher"])
    return features.user_totals(months, buckets, ["teacher"])


def test_totals_shares_and_span(spark):
    df = totals(
        spark,
        [
            ("a", "2018-08-06", 1, 1, 3),
            ("a", "2018-08-07", 1, 5, 10),
            ("a", "2018-08-07", 1, 40, 80),
            ("a", "2018-11-01", 1, None, 0),
            ("b", "2018-09-01", 1, 0, 0),
        ],
    )
    shares = features.bucket_shares(df, ENGAGEMENT_5)
    got = {r["teacher"]: r.asDict() for r in features.usage_span(shares, date(2019, 3, 15)).collect()}
    a, b = got["a"], got["b"]
    assert (a["total_presentations"], a["total_students"], a["total_responses"]) == (4, 46, 93)
    assert a["months_used"] == 2
    # an unknown student count falls into the testing bucket
    assert [a[f"share_{x}"] for x in ("testing", "low", "low_medium", "medium", "high")] == [
        0.5, 0.25, 0.0, 0.0, 0.25,
    ]
    assert a["share_valid"] == 0.5
    assert (a["first_month"], a["last_month"]) == (date(2018, 8, 1), date(2018, 11, 1))
    assert (a["months_spanned"], a["months_since_first"]) == (4, 8)
    assert a["months_used_share"] == 0.25
    assert a["presentations_per_month_used"] == 2.0
    assert a["presentations_per_month_spanned"] == 1.0
    assert a["responses_per_presentation"] == 93 / 4
    # no students: the ratio per student is zero, not an error
    assert b["responses_per_student"] == 0.0
    assert b["share_testing"] == 1.0


def test_shares_sum_to_one_per_user(spark):
    data = [(f"t{i % 7}", f"2018-0{i % 3 + 7}-01", 1, i % 45, i) for i in range(200)]
    shares = features.bucket_shares(totals(spark, data), ENGAGEMENT_5)
    total = sum((F.col(f"share_{b.column}") for b in ENGAGEMENT_5), F.lit(0.0))
    assert shares.filter(F.abs(total - 1) > 1e-12).count() == 0


def test_audience_is_a_whole_number_at_the_edge(spark):
    # ten presentations with one test run are nine for an audience, which is still Light
    df = totals(spark, [("a", "2018-08-01", 1, 1 if i == 0 else 5, 1) for i in range(10)])
    got = one(features.audience(df))
    assert (got["audience_presentations"], got["testing_presentations"]) == (9, 1)
    assert got["audience_label"] == "Light"


def counts(spark, data):
    return spark.createDataFrame(data, "teacher string, slide_type string, slide_type_count long")


def test_diversity_is_scaled_entropy(spark):
    df = counts(
        spark,
        [("a", "x", 3), ("a", "y", 3), ("a", "z", 3), ("b", "x", 9), ("c", "x", 1), ("c", "y", 3)],
    )
    got = dict(rows(features.slide_diversity(df)))
    assert got["a"] == 1.0
    assert got["b"] == 0.0 and str(got["b"]) == "0.0"
    assert got["c"] == 0.512


def test_diversity_with_one_type_is_unknown(spark):
    assert rows(features.slide_diversity(counts(spark, [("a", "x", 3)]))) == [("a", None)]


def study(**changes):
    values = dict(
        first_from=date(2018, 8, 1),
        first_to=date(2018, 8, 31),
        excluded_role="student",
        usage=(Period("initial", 0, 3), Period("later", 0, 3, 12)),
        status=(Period("initial", 1, 3), Period("later", 1, 3, 12)),
        as_of=date(2019, 12, 1),
        special_app="%flash%",
        with_status_label=True,
    )
    return mart.Study(**{**values, **changes})


@pytest.fixture(scope="module")
def built(tables):
    users = tables.users(
        ("a", "2018-08-05T10:00", "teacher", None, True, False, "school"),
        ("b", "2018-08-06T10:00", "teacher", None, False, None, "individual"),
        ("c", "2018-08-07T10:00", "teacher", None, False, True, "individual"),
        ("s", "2018-08-07T10:00", "student", None, False, True, "individual"),
    )
    slides = tables.slides(
        ("a", "p1", "s1", "draw", "2018-08-06T09:05"),
        ("a", "p1", "s2", "text", "2018-08-06T09:05"),
        ("b", "p2", "s1", "draw", "2018-08-06T10:05"),
        ("a", "p3", "s1", "draw", "2019-08-06T09:05"),
        ("s", "p4", "s1", "draw", "2018-08-08T09:05"),
    )
    responses = tables.responses(
        ("a", "x", "p1", "s1", "web", "2018-08-06T09:06"),
        ("a", "y", "p1", "s1", "web", "2018-08-06T09:06"),
        ("b", "x", "p2", "s1", "web", "2018-08-06T10:06"),
        ("b", "x", "p2", "s1", "my flash cards", "2018-08-06T10:06"),
        ("a", "y", "p3", "s1", "web", "2019-08-06T09:06"),
    )
    launches = tables.launches(
        ("a", "2018-09-06T00:00", "premiumTrial"),
        ("a", "2018-10-06T00:00", "Free"),
        ("b", "2018-08-07T00:00", "free"),
    )
    plan = study()
    cohort = plan.cohort(users)
    return plan, mart.feature_mart(plan, cohort, users, slides, responses, launches).cache()


def test_mart_has_one_row_per_member_and_period(built):
    _, df = built
    assert rows(df, "period", "teacher") == [
        (p, t) for p in ("initial", "later") for t in ("a", "b", "c")
    ]


def test_mart_values(built):
    _, df = built
    got = {(r["period"], r["teacher"]): r.asDict() for r in df.collect()}
    a, b, c = (got["initial", t] for t in "abc")
    assert a["usage_label"] == "Used Product" and a["status_label"] == "Used Product Free"
    assert (a["status_first"], a["status_last"]) == ("premiumtrial", "free")
    assert b["usage_label"] == "Tested Product Only"
    assert b["status_label"] == "Tested Project Only"
    assert b["status_first"] is None
    assert c["usage_label"] == "Never Used" and c["total_students"] is None
    assert c["share_testing"] is None and c["audience_label"] == "None"
    assert a["slide_diversity"] == 1.0 and b["slide_diversity"] == 0.0
    assert c["slide_diversity"] is None
    assert [got["initial", t]["special_app_use"] for t in "abc"] == [0, 1, 0]
    assert [got["initial", t]["account_status_later"] for t in "abc"] == ["premium", "free", None]
    later = got["later", "a"]
    assert later["usage_label"] == "Tested Product Only"
    assert later["slide_diversity"] == 1.0  # the initial value


def test_model_table_pairs_the_periods(spark, built):
    plan, df = built
    participated = spark.createDataFrame([("c", 1)], "teacher string, participated_before int")
    profile = spark.createDataFrame([("a", 0.25)], "teacher string, teacher_event_prop double")
    got = {
        r["teacher"]: r.asDict()
        for r in mart.model_table(plan, df, participated, profile).collect()
    }
    a, b, c = (got[t] for t in "abc")
    assert a["used_initial"] == 1 and a["used_later"] == 0
    assert (b["used_initial"], c["used_initial"]) == (0, 0)
    # no launch a year later: the subscription is today's account status
    assert [got[t]["subscription_later"] for t in "abc"] == ["premium", "free", None]
    assert [got[t]["premium_later"] for t in "abc"] == [1, 0, None]
    assert (a["presentations_later"], a["usage_label_later"]) == (1, "Tested Product Only")
    assert [got[t]["participated_before"] for t in "abc"] == [0, 0, 1]
    assert a["teacher_event_prop"] == 25.0 and b["teacher_event_prop"] is None
    assert a["slide_diversity"] == 100.0 and a["share_low"] == 100.0
    assert c["total_students"] == 0


def test_all_null_groups_propagate_like_missing_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "k string, v double")
    assert rows(df.groupBy("k").agg(F.sum("v"), F.avg("v"), F.stddev_samp("v"))) == [
        ("a", None, None, None),
        ("b", 1.0, 1.0, None),  # one value has no sample deviation
    ]


def test_low_engagement(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 5), ("b", 1), ("b", 0), ("c", None)], "teacher string, num_students long"
    )
    assert rows(frames.low_engagement(df, 1)) == [(3, 2, 1)]


def test_role_condition_that_matches_nothing_keeps_all_rows(spark):
    df = spark.createDataFrame([("a",), (None,)], "k string")
    assert frames.drop_where(df, F.col("k") == "zz").count() == 2
    assert rows(frames.drop_where(df, F.col("k") == "a")) == [(None,)]


def test_missing_cells_and_complete_cases(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "x"), (None, float("nan"), "y"), (3, 2.0, None)], "a int, b double, c string"
    )
    assert rows(frames.missing_cells(df)) == [(3, 3)]
    assert rows(frames.complete_cases(df)) == [(1, 1.0, "x")]
    assert rows(frames.missing_cells(df.limit(0))) == [(0, 0)]


def test_ids_as_text(spark):
    df = spark.createDataFrame([(1, 2)], "teacher long, n long")
    assert frames.ids_as_text(df).schema.simpleString() == "struct<teacher:string,n:bigint>"


def test_correlations_are_symmetric(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 5.0)], "a int, b double")
    got = {(a, b): r for a, b, r in rows(frames.correlations(df, ["a", "b"]))}
    assert got["a", "b"] == got["b", "a"] == pytest.approx(0.981980506)
    assert got["a", "a"] == pytest.approx(1.0) and len(got) == 4
    flat = frames.correlations(df.withColumn("k", F.lit(3)), ["a", "k"])
    assert rows(flat, "r")[1:] == [(None,), (None,), (None,)]


def test_fixture_helper():
    assert ts("2018-01-01").year == 2018
