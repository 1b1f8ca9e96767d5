"""Bitmaps that can be merged: months of activity per user, and users per period.

Both are built in one pass over the events and added to by merging, and every later
question (any start and end span, a whole retention matrix, months, quarters and totals
without counting anybody twice) is answered by bit operations over the bitmaps alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.numbers import ratio
from stayline.functions.periods import between_days, shift_months
from stayline.operators.joins import lookup_join
from stayline.operators.ranking import hash_rank

# five years a word; the sign bit stays free
WORD_MONTHS = 60
Span = tuple[date, date]


def _number(day: date) -> int:
    return day.year * 12 + day.month - 1


class Months:
    """The months that a bitmap covers, both ends included."""

    def __init__(self, first: date, last: date):
        self.first, self.last = first.replace(day=1), last.replace(day=1)
        self.count = _number(self.last) - _number(self.first) + 1
        if self.count < 1:
            raise ValueError("the last month is before the first")
        self.words = -(-self.count // WORD_MONTHS)

    def place(self, day: Column) -> Column:
        """The bit of a day's month."""
        return F.year(day) * 12 + F.month(day) - 1 - _number(self.first)

    def at(self, place: Column) -> Column:
        """The first day of the month of a bit."""
        return F.add_months(F.lit(self.first), place)

    def masks(self, span: Span) -> list[int]:
        """The bits of a span of months, by word; months outside the bitmap are an error."""
        low, high = (_number(day) - _number(self.first) for day in span)
        if low < 0 or high >= self.count:
            raise ValueError(f"{span} is not within {self.first} to {self.last}")
        bits = sum(1 << i for i in range(low, high + 1))
        return [(bits >> (WORD_MONTHS * w)) & ((1 << WORD_MONTHS) - 1) for w in range(self.words)]


def _merge_words(words: int, of: str = "months") -> Column:
    return F.array(*[F.bit_or(F.get(of, F.lit(w))) for w in range(words)]).alias("months")


def activity_bitmaps(responded: DataFrame, months: Months) -> DataFrame:
    """One row per user active in the months: ``user_id`` and ``months``, words of bits.

    Rows without a user or a time, and activity outside the months, are not in it.
    """
    end = shift_months(months.last, 1)
    inside = between_days(responded, "timestamp", months.first, date.fromordinal(end.toordinal() - 1))
    bit = F.expr(f"shiftleft(1L, _place % {WORD_MONTHS})")
    word = F.expr(f"_place div {WORD_MONTHS}")
    placed = inside.where(F.col("teacher").isNotNull()).select(
        F.col("teacher").alias("user_id"), months.place(F.to_date("timestamp")).alias("_place")
    )
    each = [F.bit_or(F.when(word == w, bit).otherwise(F.lit(0).cast("long"))) for w in range(months.words)]
    return placed.groupBy("user_id").agg(F.array(*each).alias("months"))


def merge_activity(bitmaps: Sequence[DataFrame], months: Months) -> DataFrame:
    """Bitmaps of several batches of events (of the same months) as one."""
    return reduce(DataFrame.unionByName, bitmaps).groupBy("user_id").agg(_merge_words(months.words))


def active_in(months: Months, span: Span, bitmap: str = "months") -> Column:
    """Whether any month of the span is set."""
    tests = [F.get(bitmap, F.lit(w)).bitwiseAND(F.lit(m)) != 0 for w, m in enumerate(months.masks(span)) if m]
    return reduce(Column.__or__, tests)


def months_active(months: Months, span: Span, bitmap: str = "months") -> Column:
    """How many months of the span are set."""
    counts = [F.bit_count(F.get(bitmap, F.lit(w)).bitwiseAND(F.lit(m))) for w, m in enumerate(months.masks(span))]
    return reduce(Column.__add__, counts)


def _is_set(place: Column | int, bitmap: str = "months") -> Column:
    if isinstance(place, int):
        word, bit = place // WORD_MONTHS, place % WORD_MONTHS
        return F.get(bitmap, F.lit(word)).bitwiseAND(F.lit(1 << bit)) != 0
    word, bit = F.floor(place / WORD_MONTHS).cast("int"), (place % WORD_MONTHS).cast("int")
    return F.getbit(F.get(bitmap, word), bit) == 1


def _patterns(bitmaps: DataFrame, *others: str) -> DataFrame:
    """Equal bitmaps as one row with their number; few users have a pattern of their own."""
    return bitmaps.groupBy("months", *others).agg(F.count(F.lit(1)).alias("_users"))


def churn_of_spans(
    bitmaps: DataFrame, clicks: DataFrame, months: Months, spans: Mapping[str, tuple[Span, Span]]
) -> DataFrame:
    """Churn and retention of users who clicked, one row per named pair of start and end spans.

    The columns are those of ``retention.churn_retention``; all pairs come from one grouping.
    """
    nothing = F.array(*[F.lit(0).cast("long")] * months.words)
    seen = bitmaps.select("user_id", "months", F.lit(False).alias("clicked"))
    used = clicks.select("user_id", nothing.alias("months"), F.lit(True).alias("clicked"))
    users = (
        seen.unionByName(used)
        .where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(_merge_words(months.words), F.max("clicked").alias("clicked"))
    )
    sums, rows = [], []
    for i, (name, (start, end)) in enumerate(spans.items()):
        early, late, clicked = active_in(months, start), active_in(months, end), F.col("clicked")
        for column, test in (("n_start", early & clicked), ("n_end", late), ("n_churn", early & clicked & ~late)):
            sums.append(F.coalesce(F.sum(F.when(test, F.col("_users"))), F.lit(0)).cast("long").alias(f"{column}_{i}"))
        columns = [F.col(f"{c}_{i}").alias(c) for c in ("n_start", "n_end", "n_churn")]
        rows.append(F.struct(F.lit(name).alias("span"), *columns))
    counts = _patterns(users, "clicked").agg(*sums).select(F.inline(F.array(*rows)))
    churn = ratio(F.col("n_churn"), F.col("n_start"))
    return counts.select(
        "span", churn.alias("churn_rate"), (1.0 - churn).alias("retention_rate"), "n_start", "n_end", "n_churn"
    )


def _by_month(patterns: DataFrame, months: Months, key: Column, name: str) -> DataFrame:
    """Users of each pattern's ``key`` months, and how many of them are active in every month."""
    keyed = patterns.withColumn("_key", key)
    sums = [F.sum(F.when(_is_set(i), F.col("_users")).otherwise(0)).alias(f"_m{i}") for i in range(months.count)]
    wide = keyed.groupBy("_key").agg(*sums)
    each = F.posexplode(F.array(*[f"_m{i}" for i in range(months.count)])).alias("_place", "n_active")
    size = F.get(F.array(*[f"_m{i}" for i in range(months.count)]), F.col("_key").cast("int")).alias("n_users")
    long = wide.select("_key", size, each).where("_place >= _key")
    return long.select(
        months.at(F.col("_key").cast("int")).alias(name),
        months.at(F.col("_place")).alias("month"),
        "n_users",
        "n_active",
        ratio(F.col("n_active"), F.col("n_users")).alias("share"),
    )


def retention_matrix(bitmaps: DataFrame, months: Months) -> DataFrame:
    """For every month with activity and every month from it on: users of the first active in the second.

    ``start_month, month, n_users, n_active, share``.
    """
    every = F.explode(F.filter(F.sequence(F.lit(0), F.lit(months.count - 1)), lambda i: _is_set(i)))
    return _by_month(_patterns(bitmaps), months, every, "start_month")


def cohort_matrix(bitmaps: DataFrame, months: Months) -> DataFrame:
    """Users by their first active month, and how many of them are active in it and every later one.

    ``cohort_month, month, n_users, n_active, share``.
    """
    first = F.lit(None).cast("int")
    for w in reversed(range(months.words)):
        word = F.get("months", F.lit(w))
        lowest = F.bit_count(word.bitwiseAND(-word) - 1) + w * WORD_MONTHS
        first = F.when(word != 0, lowest).otherwise(first)
    patterns = _patterns(bitmaps).where(reduce(Column.__or__, [F.get("months", F.lit(w)) != 0 for w in range(months.words)]))
    return _by_month(patterns, months, first, "cohort_month")


def dense_ids(keys: DataFrame, column: str) -> DataFrame:
    """``column`` and ``dense_id``: the distinct non-null keys, numbered from 0 in the order of a hash."""
    known = keys.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_all", F.lit(0))
    return hash_rank(known, "_all", column, seed=0).select(column, F.col("rank").cast("long").alias("dense_id"))


def with_dense_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Add ``dense_id`` to the rows whose key the list of ``dense_ids`` holds."""
    return lookup_join(df, ids, [column], "inner")


def member_bitmaps(df: DataFrame, number: str, by: Sequence[str] = ()) -> DataFrame:
    """The distinct whole numbers of every group as bitmaps: ``by, bucket, members``.

    A bitmap covers 32,768 consecutive numbers, so numbers should be dense. A large group
    has many bitmaps, so it is spread over tasks; rows without a number are not in it.
    """
    known = df.where(F.col(number).isNotNull())
    bucket = F.bitmap_bucket_number(number).alias("bucket")
    return known.groupBy(*by, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("members"))


def merge_members(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bitmaps of smaller groups or several batches as bitmaps of the groups ``by``."""
    return bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("members").alias("members"))


def count_members(bitmaps: DataFrame, by: Sequence[str] = (), name: str = "n_distinct") -> DataFrame:
    """Distinct numbers per group, from bitmaps of it or of smaller groups."""
    counted = merge_members(bitmaps, by).select(*by, F.bitmap_count("members").alias("_n"))
    return counted.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias(name))


def distinct_by_period(
    df: DataFrame, number: str, timestamp: str, levels: Mapping[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Distinct numbers per group and period, for several kinds of periods from one pass.

    ``levels`` name each kind with its key, a text made of the column ``month`` (the first
    day of the row's month), such as quarters, years or a constant for the total. Bitmaps
    are built per month and merged upward: nothing is counted twice, no row is read twice.
    Returns ``by, level, period, n_distinct``.
    """
    monthly = member_bitmaps(df.withColumn("month", F.trunc(F.to_date(timestamp), "MM")), number, [*by, "month"])
    keys = F.array(*[F.struct(F.lit(k).alias("level"), v.cast("string").alias("period")) for k, v in levels.items()])
    raised = monthly.select(*by, "bucket", "members", F.inline(keys))
    return count_members(raised, [*by, "level", "period"])
