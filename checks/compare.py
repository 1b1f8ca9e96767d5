"""Run registered queries next to their SQL and report the differences.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

from checks.oracles import ORACLES
from checks.queries import QUERIES


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(root).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def spark_table(df):
    return _table(df.columns, [tuple(r) for r in df.collect()])


def sql_table(con, sql: str):
    result = con.execute(sql)
    return _table([d[0] for d in result.description], result.fetchall())


def difference(mine, theirs) -> str | None:
    """What differs first, or None when columns and rows agree."""
    if mine[0] != theirs[0]:
        return f"columns {sorted(set(mine[0]) ^ set(theirs[0]))}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows, expected {len(theirs[1])}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"{[(n, x, y) for n, x, y in zip(mine[0], a, b) if x != y]} in {a[:6]}"
    return None


def main(root: str, names: list[str]) -> int:
    from stayline.session import local_session

    spark, con, bad = local_session("compare"), connect(root), 0
    for name in names or list(ORACLES):
        started = time.time()
        problem = difference(
            spark_table(QUERIES[name](spark, root)), sql_table(con, ORACLES[name])
        )
        bad += problem is not None
        print(f"{name:34s} {time.time() - started:6.2f}s {problem or 'ok'}"[:600], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
