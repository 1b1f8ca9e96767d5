from datetime import datetime

import pytest

from stayline.session import local_session
from stayline.sources import schemas


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def ts(text):
    return datetime.fromisoformat(text)


class Tables:
    """Hand-made frames of the logical tables; missing trailing values are NULL."""

    def __init__(self, spark):
        self.spark = spark

    def make(self, name, rows):
        schema = schemas.TABLES[name]
        width = len(schema)
        padded = [tuple(r) + (None,) * (width - len(r)) for r in rows]
        return self.spark.createDataFrame(padded, schema)

    def users(self, *rows):
        """(id, first_seen, role, last_presented, premium, trial, type)"""
        return self.make("user_facts", [(r[0], ts(r[1]) if r[1] else None, *r[2:]) for r in rows])

    def launches(self, *rows):
        return self.make(
            "launch_presentation", [(u, ts(t) if t else None, s) for u, t, s in rows]
        )

    def slides(self, *rows):
        return self.make("slide_presented", [(*r[:4], ts(r[4])) for r in rows])

    def responses(self, *rows):
        return self.make("student_responses", [(*r[:5], ts(r[5])) for r in rows])

    def responded(self, *rows):
        return self.make("student_responded", [(*r[:3], ts(r[3])) for r in rows])


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark)


def rows(df, *columns):
    """All rows as tuples, sorted as text with NULL last."""
    picked = df.select(*columns) if columns else df
    return sorted(
        (tuple(r) for r in picked.collect()), key=lambda r: [(v is None, str(v)) for v in r]
    )


def one(df):
    (row,) = df.collect()
    return row.asDict()
