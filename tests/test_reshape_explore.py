from datetime import date

import pytest
from pyspark.sql import functions as F

from stayline.operators import explore, reshape
from tests.conftest import rows


def test_widen_and_lengthen_are_inverse(spark):
    df = spark.createDataFrame(
        [("a", "2018-08", 2), ("a", "2018-08", 1), ("b", "2018-09", 4), ("b", None, 9)],
        "teacher string, year_month string, n long",
    )
    months = ["2018-08", "2018-09", "2018-10"]
    wide = reshape.widen(df, ["teacher"], "year_month", "n", months)
    assert rows(wide) == [("a", 3, 0, 0), ("b", 0, 4, 0)]
    long = reshape.lengthen(wide, ["teacher"], months, "year_month", "n")
    assert long.count() == 6
    assert rows(long.filter("n <> 0")) == [("a", "2018-08", 3), ("b", "2018-09", 4)]


def test_shares_wide(spark):
    df = spark.createDataFrame(
        [("a", "x", 1), ("a", "y", 3), ("b", "z", 2)], "teacher string, kind string, n long"
    )
    got = reshape.shares_wide(df, ["teacher"], "kind", "n", {"share_x": "x", "share_y": "y"})
    # z is not listed but counts in the total
    assert rows(got) == [("a", 4, 0.25, 0.75), ("b", 2, None, None)]


@pytest.mark.parametrize("small", [True, False, None])
def test_share_within_keeps_null_groups(spark, small):
    df = spark.createDataFrame(
        [("f", 1, 1), ("f", 2, 3), (None, 1, 5)], "facet string, x int, n long"
    )
    got = reshape.share_within(df, ["facet"], "n", small=small)
    assert rows(got, "facet", "x", "total", "share") == [
        ("f", 1, 4, 0.25),
        ("f", 2, 4, 0.75),
        (None, 1, 5, 1.0),
    ]


def test_widen_rows_keeps_every_row_of_a_key(spark):
    df = spark.createDataFrame(
        [("a", k, v) for k, v in enumerate("zyxwv")] + [("b", 1, None)], "t string, o int, v string"
    )
    got = reshape.widen_rows(df, ["t"], ["o"], ["v"])
    assert rows(got) == [("a", "z", "y", "x", "w", "v", 5), ("b", None, None, None, None, None, 1)]
    named = reshape.widen_rows(df, ["t"], ["o"], ["v"], positions=2)
    assert rows(named) == [("a", "z", "y", 5), ("b", None, None, 1)]
    assert reshape.widen_rows(df.limit(0), ["t"], ["o"], ["v"]).collect() == []
    assert sorted(r["position"] for r in reshape.number_rows(df, ["t"], ["o"]).collect()) == [1, 1, 2, 3, 4, 5]


def test_unite_skips_nulls_and_blanks_become_null(spark):
    df = spark.createDataFrame(
        [(1, "free", None), (2, "", ""), (3, "a", "b")], "k int, p string, q string"
    )
    assert rows(reshape.unite(df, "u", ["p", "q"])) == [(1, "free"), (2, None), (3, "ab")]


def test_levels_and_dummies(spark):
    df = spark.createDataFrame(
        [("x", 1, "s"), ("y", 0, "s"), (None, 1, "r")], "kind string, y int, spare string"
    )
    assert reshape.levels_of(df, "kind") == ["x", "y"]
    many = spark.range(1500).selectExpr("CAST(id AS string) AS kind")
    assert len(reshape.levels_of(many, "kind")) == 1500
    got = reshape.label_last(
        df, "y", drop=["spare"], categoricals={"kind": ["x", "y"]}, base_cases=["kind_x"]
    )
    assert got.columns == ["kind_y", "label"]
    assert rows(got) == [(0, 1), (0, 1), (1, 0)]
    bare = reshape.label_last(df, "y", categoricals={"kind": ["x"]}, with_dummies=False)
    assert bare.columns == ["spare", "label"]


def test_month_stats_with_and_without_idle_months(spark):
    df = spark.createDataFrame(
        [("a", "2018-08", 4), ("a", "2018-08", 1), ("b", "2018-08", 2), ("a", "2018-09", 3)],
        "teacher string, year_month string, num_presentations long",
    )
    assert rows(explore.month_stats(df)) == [
        (3, 3.0, None, date(2018, 9, 1)),
        (7, 4.0, 2.1, date(2018, 8, 1)),  # the mean 3.5 rounds to the even 4
    ]
    wide = reshape.widen(df, ["teacher"], "year_month", "num_presentations", ["2018-08", "2018-09"])
    zeros = reshape.lengthen(
        wide, ["teacher"], ["2018-08", "2018-09"], "year_month", "num_presentations"
    )
    assert rows(explore.month_stats(zeros)) == [
        (3, 2.0, 2.1, date(2018, 9, 1)),
        (7, 4.0, 2.1, date(2018, 8, 1)),
    ]


def test_week_stats(spark):
    df = spark.createDataFrame(
        [(date(2018, 12, 31), 1), (date(2018, 1, 2), 1)], "date date, num_presentations long"
    )
    assert rows(explore.week_stats(df)) == [(201801, 1.0, 0.0)]
    assert rows(explore.week_stats(df, iso_year=True), "year_week") == [(201801,), (201901,)]


def test_histogram_bins_are_centred_and_closed_right(spark):
    df = spark.createDataFrame([(0,), (2,), (3,), (7,), (8,), (None,)], "n int")
    assert rows(explore.histogram(df, "n", 5)) == [(0.0, 2), (10.0, 1), (5.0, 2)]
    edges = spark.createDataFrame([(2.5,), (2.6,)], "n double")
    assert rows(explore.histogram(edges, "n", 5)) == [(0.0, 1), (5.0, 1)]
    assert rows(explore.histogram(df, "n", 1, (0, 3))) == [(0.0, 1), (2.0, 1), (3.0, 1)]


def test_facet_share_sums_to_one(spark):
    df = spark.createDataFrame([("f", 1), ("f", 1), ("f", 2), ("g", 1)], "l string, n int")
    got = explore.facet_share(df, "l", "n")
    assert rows(got, "facet", "x", "share") == [
        ("f", 1, 2 / 3),
        ("f", 2, 1 / 3),
        ("g", 1, 1.0),
    ]


def test_scatter_and_counts(spark):
    df = spark.range(1000).select(F.col("id").alias("x"), (F.col("id") % 3).alias("y"))
    assert explore.scatter(df, "x", "y").count() == 1000
    assert rows(explore.count_by(df, "y"))[0] == (0, 334)
