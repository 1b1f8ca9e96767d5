"""Guarded arithmetic. Division never raises: an empty denominator gives NULL or a fill."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column, fill: float | None = None) -> Column:
    value = F.try_divide(top.cast("double"), bottom.cast("double"))
    return value if fill is None else F.coalesce(value, F.lit(float(fill)))


def round_even(value: Column, digits: int) -> Column:
    """Ties go to the even digit: 0.125 becomes 0.12."""
    return F.bround(value, digits)


def row_sum(columns: list[Column]) -> Column:
    """Sum across columns of one row; NULL when any of them is NULL."""
    return reduce(add, columns)


def flag(condition: Column) -> Column:
    """1 or 0, and NULL where the condition itself is unknown."""
    return F.when(condition, 1).when(~condition, 0)


def is_missing(column: Column, is_float: bool) -> Column:
    return column.isNull() | F.isnan(column) if is_float else column.isNull()
