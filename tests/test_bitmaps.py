"""Bitmaps of months and of members against plain counting."""

import random
from collections import defaultdict
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stayline.operators import bitmaps, retention
from tests.conftest import one, rows

MONTHS = bitmaps.Months(date(2014, 1, 15), date(2020, 6, 1))


def day(month, of=1):
    return datetime(2014 + month // 12, month % 12 + 1, of)


@pytest.fixture(scope="module")
def responded(spark):
    draw = random.Random(1)
    data = [(f"u{draw.randint(0, 60)}", "s", "p", day(draw.randint(0, 77), draw.randint(1, 28))) for _ in range(900)]
    data += [("hot", "s", "p", day(m, 28)) for m in range(78) for _ in range(5)]
    data += [("outside", "s", "p", datetime(2013, 12, 31, 23)), ("outside", "s", "p", datetime(2020, 7, 1))]
    data += [("edge", "s", "p", datetime(2014, 1, 1)), ("edge", "s", "p", datetime(2020, 6, 30, 23, 59))]
    data += [(None, "s", "p", day(3)), ("u1", "s", "p", None)]
    return spark.createDataFrame(data, "teacher string, student string, presentation string, timestamp timestamp")


def by_user(df):
    """Month numbers of each user, by hand."""
    found = defaultdict(set)
    for r in df.where("teacher IS NOT NULL AND timestamp IS NOT NULL").collect():
        number = (r["timestamp"].year - 2014) * 12 + r["timestamp"].month - 1
        if 0 <= number <= 77:
            found[r["teacher"]].add(number)
    return found


def test_bits_are_the_months_of_activity(responded):
    expected = by_user(responded)
    for r in bitmaps.activity_bitmaps(responded, MONTHS).collect():
        bits = {w * bitmaps.WORD_MONTHS + i for w, word in enumerate(r["months"]) for i in range(60) if word >> i & 1}
        assert bits == expected.pop(r["user_id"])
    assert not expected


def test_batches_merge_to_the_bitmaps_of_all_events(responded):
    odd = F.dayofmonth("timestamp") % 2 == 1
    parts = [bitmaps.activity_bitmaps(responded.where(p), MONTHS) for p in (odd, ~odd)]
    merged = bitmaps.merge_activity(parts, MONTHS)
    assert rows(merged) == rows(bitmaps.activity_bitmaps(responded, MONTHS))


def test_spans_are_read_across_words(responded):
    found = bitmaps.activity_bitmaps(responded, MONTHS)
    expected = by_user(responded)
    for low, high in ((0, 0), (58, 61), (60, 77), (0, 77)):
        span = day(low).date(), day(high).date()
        got = found.select("user_id", bitmaps.active_in(MONTHS, span).alias("a"), bitmaps.months_active(MONTHS, span).alias("n"))
        for r in got.collect():
            n = sum(low <= m <= high for m in expected[r["user_id"]])
            assert (r["a"], r["n"]) == (n > 0, n)
    with pytest.raises(ValueError):
        bitmaps.active_in(MONTHS, (date(2013, 12, 1), date(2014, 2, 1)))
    with pytest.raises(ValueError):
        bitmaps.Months(date(2014, 2, 1), date(2014, 1, 1))


def test_matrices_are_those_of_plain_counting(responded):
    users = by_user(responded)
    bits = bitmaps.activity_bitmaps(responded, MONTHS)
    matrix = {(r["start_month"], r["month"]): r for r in bitmaps.retention_matrix(bits, MONTHS).collect()}
    cohorts = {(r["cohort_month"], r["month"]): r for r in bitmaps.cohort_matrix(bits, MONTHS).collect()}
    for s in range(78):
        active = [u for u in users.values() if s in u]
        joined = [u for u in users.values() if min(u) == s]
        for e in range(s, 78):
            for found, chosen in ((matrix, active), (cohorts, joined)):
                row = found.pop((day(s).date(), day(e).date()), None)
                if not chosen:
                    assert row is None
                    continue
                n = sum(e in u for u in chosen)
                assert (row["n_users"], row["n_active"]) == (len(chosen), n)
                assert row["share"] == pytest.approx(n / len(chosen))
    assert not matrix and not cohorts


def test_churn_equals_the_direct_one(spark, responded):
    clicks = spark.createDataFrame([("u1",), ("u2",), ("u2",), ("hot",), ("nobody",), (None,)], "user_id string")
    spans = {f"{a}-{b}": ((day(a).date(), day(a + 3).date()), (day(b).date(), day(b + 2).date())) for a in (0, 30, 57) for b in (20, 75)}
    got = {r["span"]: r for r in bitmaps.churn_of_spans(bitmaps.activity_bitmaps(responded, MONTHS), clicks, MONTHS, spans).collect()}
    for name, (start, end) in spans.items():
        expected = one(retention.churn_retention(responded, clicks, start, end))
        assert {k: got[name][k] for k in expected} == expected
    empty = bitmaps.activity_bitmaps(responded.where("false"), MONTHS)
    nothing = bitmaps.churn_of_spans(empty, clicks.where("false"), MONTHS, {"x": spans["0-20"]}).collect()
    assert [(r["n_start"], r["churn_rate"]) for r in nothing] == [(0, None)]
    assert bitmaps.retention_matrix(empty, MONTHS).count() == 0


def test_distinct_counts_of_all_levels_come_from_one_scan(spark, tmp_path):
    draw = random.Random(5)
    data = [(f"k{int(draw.expovariate(0.002))}", f"g{draw.randint(0, 2)}", day(draw.randint(0, 20))) for _ in range(4000)]
    data += [(None, "g0", day(1)), ("k1", None, day(2)), ("k2", "g1", None)]
    df = spark.createDataFrame(data, "key string, g string, ts timestamp")
    ids = bitmaps.dense_ids(df, "key")
    numbers = sorted(r["dense_id"] for r in ids.collect())
    assert numbers == list(range(df.select("key").where("key IS NOT NULL").distinct().count()))
    bitmaps.with_dense_ids(df, "key", ids).write.parquet(str(tmp_path / "events"))
    stored = spark.read.parquet(str(tmp_path / "events"))
    levels = {"month": F.col("month"), "year": F.year("month"), "total": F.lit("all")}
    counted = bitmaps.distinct_by_period(stored, "dense_id", "ts", levels, ["g"])
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" not in plan
    expected = defaultdict(set)
    for key, g, ts in data:
        if key is not None:
            month = ts and str(ts.date().replace(day=1))
            for level, period in (("month", month), ("year", ts and str(ts.year)), ("total", "all")):
                expected[g, level, period].add(key)
    assert {tuple(r)[:3]: r["n_distinct"] for r in counted.collect()} == {k: len(v) for k, v in expected.items()}


def test_members_merge_over_batches_and_buckets(spark):
    df = spark.range(100_000).selectExpr("id * 3 AS id", "id % 2 AS g").unionByName(spark.range(50).selectExpr("id", "0 AS g"))
    parts = [bitmaps.member_bitmaps(df.where(p), "id", ["g"]) for p in ("id % 5 < 3", "id % 5 >= 2")]
    merged = parts[0].unionByName(parts[1])
    assert rows(bitmaps.count_members(merged, ["g"])) == rows(df.groupBy("g").agg(F.count_distinct("id")))
    assert one(bitmaps.count_members(merged))["n_distinct"] == df.select("id").distinct().count()
