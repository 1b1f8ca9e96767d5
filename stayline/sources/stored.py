"""Storage of events by time and by user and presentation, for pulls that are repeated.

A stored table is split by day, month or year and, within that, into buckets by a hash of
its keys. A pull reads only the spans its windows touch, and groupings and joins by keys
that include the stored ones need no exchange. Storing by user and presentation, not by
user alone, spreads a user who holds a large part of all events over the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.session import checkpoint_folder

PART = "_part"
CO_PARTITIONED = "spark.sql.requireAllClusterKeysForCoPartition"
# how a span is named; the names are in the order of time
SPANS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def store_events(
    events: DataFrame, name: str, keys: Sequence[str], buckets: int, span: str = "day", mode: str = "overwrite"
) -> None:
    """Write events as the table ``name``; with ``mode="append"`` later ones are added to it.

    Tables to be joined need the same number of buckets and keys of the same types in the
    same order. There are at most ``buckets`` files a span and write, each from one task, so
    the span should hold a few hundred MB a bucket. Events without a time are kept, in a span of their own
    that no pull of a range reads; empty events make an empty table.
    """
    if span not in SPANS:
        raise ValueError(f"span must be one of {', '.join(SPANS)}, not {span!r}")
    folder = f"{checkpoint_folder(events.sparkSession)}/stored/{name}"
    writer = (
        events.withColumn(PART, F.date_format("timestamp", SPANS[span]))
        .repartition(buckets, *keys)
        .write.mode(mode)
        .partitionBy(PART)
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
    )
    writer.option("path", folder).saveAsTable(name)


def stored_events(spark: SparkSession, name: str, first: date, last: date, span: str = "day") -> DataFrame:
    """The events of the spans that the days ``first`` to ``last`` touch."""
    length = len(SPANS[span])
    part = F.col(PART).between(first.isoformat()[:length], last.isoformat()[:length])
    return spark.table(name).where(part).drop(PART)


@contextmanager
def co_partitioned(spark: SparkSession) -> Iterator[None]:
    """Let joins use a partitioning by some of their keys; frames must be computed inside."""
    before = spark.conf.get(CO_PARTITIONED)
    spark.conf.set(CO_PARTITIONED, "false")
    try:
        yield
    finally:
        spark.conf.set(CO_PARTITIONED, before)
