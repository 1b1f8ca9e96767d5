from collections import Counter

import duckdb
import pytest
from corpus_helpers import CLASHES, DOC

from stayline.llm.oracles import ORACLES

@pytest.fixture
def docs(spark):
    """Makes documents of (id, text[, source]), with extra columns whose names clash."""

    def make(*rows, clash=True):
        padded = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(padded, DOC)
        for name in CLASHES if clash else ():
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture
def by_sql():
    """The multiset of rows that a query's SQL gives over Arrow tables."""

    def run(name, **tables):
        connection = duckdb.connect()
        for table, df in tables.items():
            connection.register(table, df.toArrow())
        found = connection.sql(ORACLES[name])
        names = sorted(found.columns)
        places = [found.columns.index(n) for n in names]
        return Counter(tuple(str(r[p]) for p in places) for r in found.fetchall())

    return run
