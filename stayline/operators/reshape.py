"""Long to wide and back, shares of a total, and indicator columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.numbers import ratio
from stayline.operators.joins import fits_broadcast
from stayline.session import checkpointed

def share_within(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "share", small: bool | None = None
) -> DataFrame:
    """Add each group's ``total`` and the row's share of it.

    The totals are a grouping joined back on the key (NULL is a group of its own), not
    a window, so no group is gathered in one task. The rows, usually counts, are read
    again for the totals and therefore checkpointed first. ``small`` says whether the
    totals may be broadcast; when it is not given they are counted.
    """
    df = checkpointed(df)
    totals = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum(value).alias("total"))
    if fits_broadcast(totals) if small is None else small:
        totals = F.broadcast(totals)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return (
        df.join(totals, same)
        .drop(*[f"_{k}" for k in keys])
        .withColumn(name, ratio(F.col(value), F.col("total")))
    )


def shares_wide(
    counts: DataFrame, keys: Sequence[str], category: str, value: str, columns: Mapping[str, str]
) -> DataFrame:
    """One column per category with its share of the group's total; absent ones are NULL.

    ``columns`` maps an output column to the category it shows. Total and shares come
    out of a single grouping.
    """
    picked = {
        name: F.sum(F.when(F.col(category) == level, F.col(value)))
        for name, level in columns.items()
    }
    sums = counts.groupBy(*keys).agg(
        F.sum(value).alias("total"), *[c.alias(n) for n, c in picked.items()]
    )
    return sums.select(*keys, "total", *[ratio(F.col(n), F.col("total")).alias(n) for n in picked])


def widen(
    df: DataFrame, keys: Sequence[str], category: str, value: str, levels: Sequence[str]
) -> DataFrame:
    """Sum of ``value`` per key with one column per listed level; missing ones are 0."""
    wide = df.groupBy(*keys).pivot(category, list(levels)).agg(F.sum(value))
    return wide.na.fill(0, subset=list(levels))


def lengthen(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str
) -> DataFrame:
    """One row per key and listed column."""
    return df.unpivot(list(keys), list(columns), name, value)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position"
) -> DataFrame:
    """Add each row's number within its key, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def widen_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    positions: int | None = None,
) -> DataFrame:
    """Number the rows of each key and put them side by side.

    Columns are ``<value>_1``, ``<value>_2``, ...; ``rows_in_group`` tells how many rows
    the key has. There are as many columns as the largest key has rows, which one count
    tells, unless the caller names the number of positions wanted.
    """
    if positions is None:
        widest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        positions = widest or 0
    numbered = number_rows(df, keys, order, "_row").filter(F.col("_row") <= positions)
    wide = numbered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[
            F.max(F.when(F.col("_row") == i, F.col(v))).alias(f"{v}_{i}")
            for v in values
            for i in range(1, positions + 1)
        ]
    )
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_in_group"))
    return wide.drop("_n").join(sizes, list(keys))


def unite(df: DataFrame, name: str, parts: Sequence[str], separator: str = "") -> DataFrame:
    """Join text columns into one and drop the parts; an empty result becomes NULL."""
    joined = F.nullif(F.concat_ws(separator, *parts), F.lit(""))
    kept = [c for c in df.columns if c not in parts]
    return df.select(*kept, joined.alias(name))


def levels_of(df: DataFrame, column: str) -> list:
    """Sorted distinct values of a categorical column, each of which becomes a column."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().collect()
    return sorted(r[0] for r in rows)


def dummies(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add one 0/1 column ``<column>_<level>`` per listed level."""
    added = {
        f"{column}_{level}": F.when(F.col(column) == level, 1).otherwise(0)
        for column, values in levels.items()
        for level in values
    }
    return df.withColumns(added) if added else df


def label_last(
    df: DataFrame,
    label: str,
    drop: Sequence[str] = (),
    categoricals: Mapping[str, Sequence[str]] | None = None,
    base_cases: Sequence[str] = (),
    with_dummies: bool = True,
) -> DataFrame:
    """Reduce a frame to predictors followed by the label, renamed ``label``.

    Categorical columns are replaced by indicators (or only dropped), minus the base
    cases. Everything is by name; names that are absent are ignored.
    """
    categoricals = categoricals or {}
    base = df.drop(*drop)
    if with_dummies:
        base = dummies(base, categoricals).drop(*base_cases)
    base = base.drop(*categoricals)
    predictors = [c for c in base.columns if c != label]
    return base.select(*[F.col(f"`{c}`") for c in predictors], F.col(label).alias("label"))
