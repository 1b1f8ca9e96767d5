"""One row per user and period: totals, bucket shares, usage span, diversity, labels."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.labels import AUDIENCE, Bucket, bucket_label
from stayline.functions.numbers import ratio, round_even
from stayline.functions.periods import month_of_text, months_inclusive

USER_PERIOD = ("period", "teacher")


def month_totals(
    sessions: DataFrame, buckets: Sequence[Bucket] = (), keys: Sequence[str] = USER_PERIOD
) -> DataFrame:
    """Sums per user and month, with the number of sessions in each engagement bucket.

    An unknown student count falls into the bucket of zero.
    """
    students = F.coalesce(F.col("num_students"), F.lit(0))
    return sessions.groupBy(*keys, "year_month").agg(
        F.sum("num_presentations").alias("presentations"),
        F.sum("num_students").alias("students"),
        F.sum("num_responses").alias("responses"),
        *[F.count_if(b.holds(students)).alias(f"n_{b.column}") for b in buckets],
    )


def user_totals(
    months: DataFrame, buckets: Sequence[Bucket] = (), keys: Sequence[str] = USER_PERIOD
) -> DataFrame:
    """Totals, ratios, months used and first/last month per user, from monthly sums."""
    sums = months.groupBy(*keys).agg(
        F.sum("presentations").alias("total_presentations"),
        F.sum("students").alias("total_students"),
        F.sum("responses").alias("total_responses"),
        F.count("year_month").alias("months_used"),
        month_of_text(F.min("year_month")).alias("first_month"),
        month_of_text(F.max("year_month")).alias("last_month"),
        *[F.sum(f"n_{b.column}").alias(f"n_{b.column}") for b in buckets],
    )
    return sums.withColumns(
        {
            "responses_per_presentation": ratio(
                F.col("total_responses"), F.col("total_presentations")
            ),
            "responses_per_student": ratio(
                F.col("total_responses"), F.col("total_students"), fill=0
            ),
        }
    )


def bucket_shares(totals: DataFrame, buckets: Sequence[Bucket], digits: int | None = None):
    """Turn the bucket counts of ``user_totals`` into shares of the presentations.

    The first bucket holds test runs; ``share_valid`` is what it leaves over.
    """

    def share(bucket: Bucket) -> Column:
        value = ratio(F.col(f"n_{bucket.column}"), F.col("total_presentations"), fill=0)
        return value if digits is None else round_even(value, digits)

    shared = totals.withColumns({f"share_{b.column}": share(b) for b in buckets})
    return shared.withColumn("share_valid", 1 - F.col(f"share_{buckets[0].column}"))


def usage_span(totals: DataFrame, as_of: date) -> DataFrame:
    """Months from first to last use and up to a day, and how intensely they were used."""
    first, last = F.col("first_month"), F.col("last_month")
    spans = totals.withColumns(
        {
            "months_spanned": months_inclusive(first, last),
            "months_since_first": months_inclusive(first, F.lit(as_of)),
        }
    )
    presentations = F.col("total_presentations")

    def rate(top: Column, months: str) -> Column:
        return round_even(ratio(top, F.col(months)), 2)

    return spans.withColumns(
        {
            "months_used_share": rate(F.col("months_used"), "months_since_first"),
            "presentations_per_month_used": rate(presentations, "months_used"),
            "presentations_per_month_spanned": rate(presentations, "months_spanned"),
            "presentations_per_month_since": rate(presentations, "months_since_first"),
        }
    )


def slide_diversity(counts: DataFrame, keys: Sequence[str] = ("teacher",)) -> DataFrame:
    """Shannon entropy of each user's slide types, scaled to 0..1, three decimals.

    The scale is the number of slide types anybody in the frame used; with a single
    type the value is NULL. Written over the counts n as ln N - sum(n ln n) / N, so the
    shares need no second pass.
    """
    n = F.col("slide_type_count")
    # asking for the count keeps both uses of the counts on one shuffle, which is reused
    types = counts.filter(n > 0).agg(F.count_distinct("slide_type").alias("types")).scalar()
    sums = counts.groupBy(*keys).agg(
        F.sum(n).alias("slides"), F.sum(n * F.ln(n.cast("double"))).alias("weighted")
    )
    entropy = F.ln(F.col("slides").cast("double")) - F.col("weighted") / F.col("slides")
    scaled = F.when(F.col("types") > 1, entropy / F.ln(F.col("types").cast("double")))
    # a user of one type has exactly zero; the sum may leave a rounding residue
    return sums.withColumn("types", types).select(
        *keys, F.abs(round_even(scaled, 3)).alias("slide_diversity")
    )


def audience(df: DataFrame, testing: str = "n_testing") -> DataFrame:
    """Split presentations into those for an audience and test runs, and label the former.

    Counted in whole presentations, so no value can fall between two label ranges.
    """
    tests = F.coalesce(F.col(testing), F.lit(0))
    total = F.coalesce(F.col("total_presentations"), F.lit(0))
    return df.withColumns(
        {"testing_presentations": tests, "audience_presentations": total - tests}
    ).withColumn("audience_label", bucket_label(F.col("audience_presentations"), AUDIENCE))
