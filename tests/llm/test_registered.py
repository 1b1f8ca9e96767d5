"""The registered corpus queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest
from corpus_helpers import counted

from stayline.llm.oracles import ORACLES
from stayline.llm.queries import QUERIES

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(ROOT).exists(), reason="test tables are missing")


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, by_sql, name):
    tables = {t: spark.read.parquet(f"{ROOT}/{t}.parquet") for t in ("documents", "embeddings", "pages")}
    assert counted(QUERIES[name](spark, ROOT)) == by_sql(name, **tables)
