"""Scans, parameterised SQL, the exclusion list, and result tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.sources.schemas import EVENT_DICTIONARY, EXCLUDED_USERS, TABLES


def scan(
    spark: SparkSession, root: str, table: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Read one logical table with its declared types; only ``columns`` leave the scan.

    A column the files do not have is an error, not a column of NULLs.
    """
    path, declared = f"{root}/{table}", TABLES[table]
    there = set(spark.read.parquet(path).columns)
    missing = [c for c in declared.names if c not in there]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    df = spark.read.schema(declared).parquet(path)
    return df.select(*columns) if columns else df


def query(
    spark: SparkSession,
    sql: str,
    views: Mapping[str, DataFrame] | None = None,
    **params: Any,
) -> DataFrame:
    """Run SQL text over the given frames; ``:name`` markers take bound values.

    Frames are passed by name in braces (``FROM {events}``), so no temporary view is
    left behind and no value is ever spliced into the text.
    """
    return spark.sql(sql, args=params or None, **(views or {}))


def sample_rows(df: DataFrame, rows: int, order_by: Sequence[str] = ()) -> DataFrame:
    """The first ``rows`` rows; repeatable only with ``order_by``."""
    return (df.orderBy(*order_by) if order_by else df).limit(rows)


def hashed_sample(df: DataFrame, rows: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """The ``rows`` rows with the smallest hash of their key, in its order; the key identifies a row.

    The same rows whatever the partitioning: every task keeps its smallest ones and those
    meet, so samples of parts of a table merge by sampling their union again.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in key])
    return df.withColumn("_hash", F.md5(text)).orderBy("_hash", *key).limit(rows).drop("_hash")


def flatten_user_facts(df: DataFrame) -> DataFrame:
    """Bring the nested and the flat layout of the user table to the flat one.

    A struct's field ``b`` becomes ``a_b`` for the profile and plain ``b`` for the
    account details; columns that are flat already pass through. Names in camel case get
    this library's form (``externalId`` becomes ``external_id``).
    """
    columns = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StructType):
            prefix = "profile_" if field.name == "profile" else ""
            columns += [
                F.col(f"`{field.name}`.`{inner}`").alias(prefix + _snake(inner))
                for inner in field.dataType.names
            ]
        else:
            columns.append(F.col(f"`{field.name}`").alias(_snake(field.name)))
    return df.select(*columns)


def _snake(name: str) -> str:
    return re.sub("(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def excluded_ids(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """The list of users to leave out, all text, one id per row."""
    reader = spark.read.schema(EXCLUDED_USERS)
    if format == "csv":
        reader = reader.option("header", True)
    return reader.format(format).load(path).filter(F.col("hashed_coach_id").isNotNull()).distinct()


def event_dictionary(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """Which events count toward which category; an event may be in several."""
    reader = spark.read.schema(EVENT_DICTIONARY)
    if format == "csv":
        reader = reader.option("header", True)
    return reader.format(format).load(path).distinct()


def write_result(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Write a result table, replacing an earlier one."""
    writer = df.write.mode("overwrite")
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)
