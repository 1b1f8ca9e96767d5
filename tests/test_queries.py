"""Registered queries against their SQL on the smallest test tables, and their plans."""

import importlib.util
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_point
from checks.compare import connect, difference, spark_table, sql_table
from checks.oracles import ORACLES
from checks.queries import QUERIES

ROOT = "/root/testdata/sf0.001"
ROWS_ONLY = {"vif_alias", "logit_backward", "odds_ratios", "linear_backward", "kmeans_assign",
             "free_later_terms", "premiumtrial_later_terms", "held_out_evaluation"}

pytestmark = pytest.mark.skipif(not Path(ROOT).exists(), reason="test tables are missing")


@pytest.fixture(scope="module")
def duck():
    return connect(ROOT)


def test_every_query_has_sql_or_is_rows_only():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    mine = spark_table(entry_point.queries()[name](spark, ROOT))
    assert difference(mine, sql_table(duck, entry_point.oracle_sql()[name])) is None


def test_entry_stands_without_the_corpus_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    spec = importlib.util.spec_from_file_location("bare_entry", entry_point.__file__)
    bare = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(bare)
    assert set(bare.queries()) == set(QUERIES) and set(bare.oracle_sql()) == set(ORACLES)


def test_entry_gives_rows(spark):
    assert entry_point.entry(spark).limit(1).count() == 1


def plan(spark, name):
    df = entry_point.queries()[name](spark, ROOT)
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["sessions_initial", "slide_type_counts", "event_profile",
                                  "churn_retention", "first_last_status_initial"])
def test_plans_have_no_python_and_no_cross_join(spark, name):
    text = plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in text


def test_user_windows_reach_the_scan_as_a_range(spark, capsys):
    entry_point.queries()["slide_type_counts"](spark, ROOT).explain("formatted")
    text = capsys.readouterr().out
    assert "GreaterThanOrEqual(o_orderdate,1995-01-01T00:00)" in text
    assert "LessThan(o_orderdate,1997-01-01T00:00)" in text


def test_the_marts_session_join_stands_on_shuffles(spark):
    """A join of plain shuffles is one that the adaptive skew join can split."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, "feature_mart")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [line.lstrip(" :+-") for line in text[text.index("== Physical Plan ==") :].splitlines()]
    joins = [i for i, line in enumerate(lines) if line.startswith("SortMergeJoin [presentation_id")]
    assert joins
    for i in joins:
        assert lines[i + 1].startswith("Sort ") and lines[i + 2].startswith("Exchange hashpartitioning")


def test_churn_needs_no_join(spark):
    text = plan(spark, "churn_retention")
    physical = text[text.index("== Physical Plan ==") :]
    # one join per fixture view only: line items with their orders
    assert physical.count("Join") == 1
