"""The bit filter in front of salted joins: no member is lost, most others are."""

import pytest
from pyspark.sql import functions as F

from stayline.operators import joins
from tests.conftest import rows


@pytest.fixture(scope="module")
def facts(spark):
    hot = spark.range(20_000).selectExpr("7L AS k", "id AS v")
    return spark.range(60_000).selectExpr("id % 6000 AS k", "id AS v").unionByName(hot)


def members(spark, n=300):
    return spark.range(n).selectExpr("id * 11 AS k", "id AS m")


def test_members_stay_and_most_others_go(spark, facts):
    lookup = members(spark)
    kept = joins.member_filter(facts, lookup, ["k"])
    assert kept.columns == facts.columns
    right = facts.join(lookup, "k", "left_semi")
    assert rows(kept.join(lookup, "k", "left_semi")) == rows(right)
    # a place is shared with about one in sixteen
    others = facts.count() - right.count()
    assert kept.count() - right.count() < 0.12 * others


def test_a_bounded_table_loses_no_member(spark, facts):
    lookup = members(spark, 5000)
    kept = joins.member_filter(facts, lookup, ["k"], most_bits=joins.BLOCK_BITS)
    assert kept.join(lookup, "k").count() == facts.join(lookup, "k").count()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_joins_give_the_same_rows(spark, facts, how, kind):
    left = facts.withColumn("k", F.when(F.col("v") % 50 != 0, F.col("k")).cast(kind))
    lookup = members(spark).withColumn("k", F.col("k").cast(kind)).unionByName(
        spark.createDataFrame([(None, 1)], f"k {kind}, m long")
    )
    got = joins.lookup_join(left, lookup, ["k"], how, small=False)
    plain = left.join(lookup, "k", how)
    columns = sorted(plain.columns)
    assert sorted(got.columns) == columns
    differ = got.select(columns).exceptAll(plain.select(columns)).count(), plain.select(columns).exceptAll(got.select(columns)).count()
    assert differ == (0, 0)


def test_keys_of_two_types_or_two_columns(spark, facts):
    whole = members(spark).withColumn("k", F.col("k").cast("int"))
    assert joins.lookup_join(facts, whole, ["k"], small=False).count() == facts.join(whole, "k").count()
    pairs = facts.selectExpr("k", "v % 3 AS j", "v").distinct()
    lookup = spark.range(400).selectExpr("id * 5 AS k", "id % 3 AS j").distinct()
    assert joins.lookup_join(pairs, lookup, ["k", "j"], small=False).count() == pairs.join(lookup, ["k", "j"]).count()
    assert joins.lookup_join(facts, members(spark, 0), ["k"], small=False).count() == 0


def test_the_facts_are_filtered_before_they_move(spark, tmp_path):
    spark.range(1000).selectExpr("id AS k", "id AS v").write.parquet(str(tmp_path / "facts"))
    stored = spark.read.parquet(str(tmp_path / "facts"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = joins.lookup_join(stored, members(spark), ["k"], small=False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [line.lstrip(" :+-*(0123456789)") for line in text.splitlines()]
    exchange = next(i for i, line in enumerate(lines) if line.startswith("Exchange hashpartitioning(k"))
    below = lines[exchange : next(i for i, line in enumerate(lines) if "FileScan" in line)]
    assert any(line.startswith("BroadcastHashJoin") for line in below)
