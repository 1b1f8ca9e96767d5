from datetime import date

import pytest
from pyspark.sql import functions as F

from stayline.functions import labels, numbers, periods
from stayline.functions.labels import AUDIENCE, ENGAGEMENT_5, ENGAGEMENT_6
from stayline.functions.periods import Period
from tests.conftest import one, rows


def day(text):
    return F.lit(text).cast("date")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_window_is_inclusive_and_clamps_at_month_end(spark):
    initial = Period("initial", 0, 3)
    first = day("2018-11-30")
    assert value(spark, initial.contains(day("2018-11-30"), first))
    assert value(spark, initial.contains(day("2019-02-28"), first))
    assert not value(spark, initial.contains(day("2019-03-01"), first))
    assert not value(spark, initial.contains(day("2018-11-29"), first))


def test_year_later_moves_months_first_then_the_year(spark):
    later = Period("later", 0, 3, 12)
    # 30 Nov 2019 + 3 months = 29 Feb 2020, + 12 months = 28 Feb 2021
    assert value(spark, later.contains(day("2021-02-28"), day("2019-11-30")))
    # moving all 15 months at once would start from 30 Nov and also clamp to the 28th, but
    # 30 Nov 2018 + 3 = 28 Feb 2019, + 12 = 28 Feb 2020, where 15 months at once give the 29th
    assert not value(spark, later.contains(day("2020-02-29"), day("2018-11-30")))
    assert value(spark, F.add_months(day("2020-02-29"), 12)) == date(2021, 2, 28)


@pytest.mark.parametrize("period", [Period("a", 0, 3), Period("b", 1, 3, 12), Period("c", 0, 14, unit="day")])
def test_span_covers_every_window(spark, period):
    low, high = date(2018, 8, 5), date(2019, 2, 28)
    first, last = period.span(low, high)
    days = spark.sql(
        f"SELECT explode(sequence(date'{low}', date'{high}')) AS f"
    ).withColumn("d", F.explode(F.expr("sequence(f, f + 700)")))
    hit = days.filter(period.contains(F.col("d"), F.col("f"))).agg(F.min("d"), F.max("d")).first()
    assert (first, last) == tuple(hit)


def test_shift_months_matches_add_months(spark):
    for months in (1, 3, 12, 15, -2):
        got = value(spark, F.add_months(day("2019-12-31"), months))
        assert periods.shift_months(date(2019, 12, 31), months) == got


def test_unknown_unit_is_refused():
    with pytest.raises(ValueError):
        Period("x", unit="week")


def test_week_key_mixes_calendar_year_and_iso_week(spark):
    assert value(spark, periods.week_key(day("2018-12-31"))) == 201801
    assert value(spark, periods.week_key(day("2018-12-31"), iso_year=True)) == 201901


def test_month_distance_counts_both_ends(spark):
    assert value(spark, periods.months_inclusive(day("2018-08-31"), day("2018-11-01"))) == 4
    assert value(spark, periods.months_inclusive(day("2018-08-01"), day("2018-08-31"))) == 1


def test_month_list():
    assert periods.month_list(date(2018, 11, 5), date(2019, 2, 1)) == [
        "2018-11",
        "2018-12",
        "2019-01",
        "2019-02",
    ]


def test_rounding_ties_go_to_even(spark):
    assert value(spark, numbers.round_even(F.lit(0.125), 2)) == 0.12
    assert value(spark, numbers.round_even(F.lit(2.5), 0)) == 2.0


def test_division_by_zero_is_null_or_the_fill(spark):
    assert value(spark, numbers.ratio(F.lit(0), F.lit(0))) is None
    assert value(spark, numbers.ratio(F.lit(1), F.lit(0), fill=0)) == 0.0


def test_flag_keeps_unknown(spark):
    null = F.lit(None).cast("boolean")
    assert value(spark, numbers.flag(null)) is None
    assert value(spark, numbers.flag(F.lit(False))) == 0


def test_account_status_truth_table(spark):
    df = spark.createDataFrame(
        [(False, False), (True, False), (True, True), (False, True), (False, None), (None, False)],
        "p boolean, t boolean",
    )
    strict = labels.account_status(F.col("p"), F.col("t"))
    lenient = labels.account_status(F.col("p"), F.col("t"), null_trial_is_free=True)
    got = [tuple(r) for r in df.select(strict, lenient).collect()]
    assert got == [
        ("free", "free"),
        ("premium", "premium"),
        ("premiumtrial", "premiumtrial"),
        (None, None),
        (None, "free"),
        (None, None),
    ]


@pytest.mark.parametrize("buckets", [ENGAGEMENT_5, ENGAGEMENT_6])
def test_every_count_has_one_bucket(spark, buckets):
    numbers_ = spark.range(0, 60).select(F.col("id").cast("int").alias("n"))
    hits = sum((b.holds(F.col("n")).cast("int") for b in buckets), F.lit(0))
    assert numbers_.filter(hits != 1).count() == 0
    labelled = numbers_.select(
        labels.bucket_label(F.col("n"), buckets).alias("l"),
        labels.bucket_order(F.col("n"), buckets).alias("o"),
    ).distinct()
    assert rows(labelled, "o", "l") == [(i, b.name) for i, b in enumerate(buckets)]


def test_published_edges(spark):
    edges = [(1, "Testing"), (2, "Low"), (10, "Low"), (11, "Low_Medium"), (19, "Low_Medium")]
    edges += [(20, "Medium"), (30, "Medium"), (31, "High")]
    for n, name in edges:
        assert value(spark, labels.bucket_label(F.lit(n), ENGAGEMENT_5)) == name
    audience = [(0, "None"), (1, "Light"), (9, "Light"), (10, "Medium"), (19, "Medium")]
    audience += [(20, "Heavy"), (34, "Heavy"), (35, "Superuser")]
    for n, name in audience:
        assert value(spark, labels.bucket_label(F.lit(n), AUDIENCE)) == name


def test_labels_leave_unknown_counts_blank(spark):
    df = spark.createDataFrame(
        [(0, None, None), (3, None, None), (3, 1, "free"), (3, 2, "premiumTrial"), (3, 2, None),
         (3, 2, "other")],
        "p long, s long, status string",
    )
    got = df.select(
        labels.usage_label(F.col("p"), F.col("s")).alias("u"),
        labels.status_label(F.col("p"), F.col("s"), F.col("status")).alias("v"),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("Never Used", "Never Used"),
        ("", ""),
        ("Tested Product Only", "Tested Project Only"),
        ("Used Product", "Used Product PremiumTrial"),
        ("Used Product", "Used Product Unknown Status"),
        ("Used Product", ""),
    ]


def test_row_sum_is_null_with_a_null(spark):
    df = spark.createDataFrame([(1, 2), (1, None)], "a int, b int")
    got = df.select(numbers.row_sum([F.col("a"), F.col("b")]).alias("s"))
    assert rows(got) == [(3,), (None,)]


def test_one_helper(spark):
    assert one(spark.range(1)) == {"id": 0}
