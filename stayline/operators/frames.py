"""Row and cell clean-up on whole frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.functions.numbers import is_missing, ratio


ID_COLUMNS = ("teacher", "user_id", "external_id", "presentation_id")


def ids_as_text(df: DataFrame) -> DataFrame:
    """Cast id columns to text. Meant for the edge: inside, ids keep their own type."""
    present = [c for c in ID_COLUMNS if c in df.columns]
    return df.withColumns({c: F.col(c).cast("string") for c in present}) if present else df


def drop_where(df: DataFrame, condition: Column) -> DataFrame:
    """Remove rows for which the condition is true; unknown and false rows stay."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def _missing(df: DataFrame) -> dict[str, Column]:
    floats = (T.DoubleType, T.FloatType)
    return {f.name: is_missing(F.col(f.name), isinstance(f.dataType, floats)) for f in df.schema}


def missing_cells(df: DataFrame) -> DataFrame:
    """Number of rows and of NULL or NaN cells, in one pass."""
    per_row = sum((c.cast("long") for c in _missing(df).values()), F.lit(0).cast("long"))
    return df.agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.coalesce(F.sum(per_row), F.lit(0)).alias("missing_cells"),
    )


def complete_cases(df: DataFrame) -> DataFrame:
    """Rows without any NULL or NaN."""
    return df.na.drop()


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace NULL in the named columns."""
    return df.na.fill(dict(values))


def scale(df: DataFrame, columns: Sequence[str], factor: float) -> DataFrame:
    return df.withColumns({c: F.col(c) * factor for c in columns})


def low_engagement(sessions: DataFrame, at_most: int = 1) -> DataFrame:
    """Distinct teachers before and after dropping sessions with few students, one row.

    A session with an unknown student count stays.
    """
    low = F.coalesce(F.col("num_students") <= at_most, F.lit(False))
    per_teacher = sessions.groupBy("teacher").agg(F.bool_or(~low).alias("stays"))
    return per_teacher.agg(
        F.count("teacher").alias("teachers_before"),
        F.count(F.when(F.col("stays"), F.col("teacher"))).alias("teachers_after"),
    ).withColumn("teachers_removed", F.col("teachers_before") - F.col("teachers_after"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns as rows (a, b, r), in one pass.

    Expects complete rows. A column without variation has NULL correlations.
    """
    x = {c: F.col(c).cast("double") for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(
        *[F.covar_pop(x[a], x[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs)],
        *[F.stddev_pop(x[c]).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    deviation = {c: F.col(f"s{i}") for i, c in enumerate(columns)}
    cells = [
        F.struct(
            F.lit(left).alias("a"),
            F.lit(right).alias("b"),
            ratio(F.col(f"c{i}"), deviation[a] * deviation[b]).alias("r"),
        )
        for i, (a, b) in enumerate(pairs)
        for left, right in sorted({(a, b), (b, a)})
    ]
    return one.select(F.inline(F.array(*cells)))
