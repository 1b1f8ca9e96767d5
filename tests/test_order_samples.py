"""Prefix scans, order statistics, samples and the check of clusters against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.operators import explore, models, ranking
from stayline.sources import tables
from tests.conftest import rows


@pytest.mark.parametrize("fan", [2, 7, 1024])
def test_prefix_sums_have_as_many_levels_as_needed(spark, fan):
    draw = random.Random(fan)
    data = [(g, p, draw.randint(-5, 9), p) for g in ("a", "b", None) for p in range(300) if draw.random() < 0.7]
    df = spark.createDataFrame(data, "g string, place int, v long, w long").repartition(3)
    got = ranking.prefix_sums(df, "place", ["v", "w"], 299, ["g"], fan)
    expected = [
        (g, p, v, w, *(sum(r[k] for r in data if r[0] == g and r[1] < p) for k in (2, 3))) for g, p, v, w in data
    ]
    assert rows(got, "g", "place", "v", "w", "before_v", "before_w") == sorted(
        expected, key=lambda r: [(x is None, str(x)) for x in r]
    )
    alone = ranking.prefix_sums(df.where("g = 'a'"), "place", ["v"], 299, fan=fan)
    assert alone.agg(F.max("place")).first() is not None and alone.count() == df.where("g = 'a'").count()


def test_no_window_of_a_prefix_scan_is_over_all_rows(spark):
    plan = ranking.prefix_sums(spark.range(10).withColumn("v", F.lit(1)), "id", ["v"], 5000, fan=64)
    text = plan._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert len(windows) == 3 and all("_block" in line.rsplit("], [", 2)[-2] for line in windows)


@pytest.mark.parametrize("kind", ["uniform", "copies", "wide", "tiny", "one", "huge"])
def test_order_statistics_are_those_of_a_sort(spark, kind):
    draw = np.random.default_rng(3)
    values = {
        "uniform": draw.random(5000),
        "copies": np.repeat([1.0, 2.0, 3.0], [10, 4000, 500]),
        "wide": np.exp(draw.normal(0, 60, 3000)) * draw.choice([-1, 1], 3000),
        "tiny": 1.0 + draw.integers(0, 50, 2000) * np.finfo(float).eps,
        "one": np.array([4.5]),
        "huge": np.array([-1.7e308, -1.0, 0.0, -0.0, 1e-300, 1.7e308]),
    }[kind]
    data = [(float(v),) for v in values] + [(None,), (math.nan,)]
    df = spark.createDataFrame(data, "v double").repartition(4)
    places = sorted({0, len(values) // 3, len(values) // 2, len(values) - 1})
    found = ranking.order_statistics(df, "v", [*places, len(values), -1])
    assert found == {p: float(np.sort(values)[p]) for p in places}


def test_infinite_values_have_places_and_quantiles_interpolate(spark):
    df = spark.createDataFrame([(math.inf,), (-math.inf,), (-math.inf,), (1.0,), (2.0,)], "v double")
    assert ranking.order_statistics(df, "v", range(5)) == {0: -math.inf, 1: -math.inf, 2: 1.0, 3: 2.0, 4: math.inf}
    assert ranking.exact_quantiles(df, "v", [0.0, 0.5, 0.625]) == [-math.inf, 1.0, 1.5]
    assert ranking.exact_quantiles(df.where("v > 5 AND v < 6"), "v", [0.5]) == []


def test_order_statistics_sort_nothing(spark, monkeypatch):
    plans = []
    df = spark.createDataFrame([(float(i * 37 % 1000),) for i in range(1000)], "v double")
    collect = type(df).collect

    def watched(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return collect(frame)

    monkeypatch.setattr(type(df), "collect", watched)
    assert ranking.order_statistics(df, "v", [10, 500]) == {10: 10.0, 500: 500.0}
    assert plans and not any("Sort" in p for p in plans)


def test_samples_do_not_depend_on_the_partitioning_and_merge(spark):
    df = spark.range(5000).selectExpr("id", "id * 2 AS v")
    one = rows(tables.hashed_sample(df.coalesce(1), 40, ["id"], seed=3))
    assert one == rows(tables.hashed_sample(df.repartition(17), 40, ["id"], seed=3)) and len(one) == 40
    parts = [tables.hashed_sample(df.where(p), 40, ["id"], seed=3) for p in ("id < 1700", "id >= 1700")]
    assert rows(tables.hashed_sample(parts[0].unionByName(parts[1]), 40, ["id"], seed=3)) == one
    assert rows(tables.hashed_sample(df, 40, ["id"], seed=4)) != one
    assert tables.hashed_sample(df.limit(3), 40, ["id"]).count() == 3
    points = explore.scatter(df, "id", "v", sample=5, key="id")
    assert points.columns == ["id", "v"] and points.count() == 5
    assert explore.scatter(df, "id", "v").count() == 5000


def test_cluster_report_sees_strays(spark, monkeypatch):
    draw = np.random.default_rng(1)
    data = [(float(a + 10 * (i % 3)), float(b)) for i, (a, b) in enumerate(draw.normal(size=(300, 2)))]
    df = spark.createDataFrame(data, "a double, b double").repartition(3)
    report = models.cluster_report(df, ["a", "b"], k=3, seed=1).collect()
    assert sum(r["rows"] for r in report) == 300 and len(report) == 3
    assert all(r["nearer_to_another"] == 0 for r in report)
    scaled = np.array(data)
    scaled = (scaled - scaled.mean(axis=0)) / scaled.std(axis=0, ddof=1)
    assert sum(r["within"] for r in report) < 0.6 * (scaled**2).sum()
    whole = models._clustered

    def swapped(*args):
        assigned, centres = whole(*args)
        return assigned, centres[::-1]

    monkeypatch.setattr(models, "_clustered", swapped)
    assert sum(r["nearer_to_another"] for r in models.cluster_report(df, ["a", "b"], k=3, seed=1).collect()) > 0
